"""One small case per settled finding of the third round."""

from __future__ import annotations

from pyspark.sql import functions as F


def test_long_texts_are_read_once(spark, capsys):
    from tracelight.functions.values import contains_any
    from tracelight.sources.host_events import parse_windows_xml

    words = spark.createDataFrame([("xx Hidden",), ("plain a.b",), (None,)], "t string")
    seen = words.select("t", contains_any(F.col("t"), ["bypass", "hidden", "a+b", "-enc"]).alias("hit"))
    assert [r.hit for r in seen.collect()] == [True, False, False]
    seen.explain()
    assert capsys.readouterr().out.lower().count("lower(") == 1  # once per needle before
    blocks = [
        'x\n<event><System><Provider Name = "P"/><EVENTID q="1"> 1102 </EVENTID></System><DATA Name="a">x &lt;b> <i>y</i></DATA><Data Name=\'A\'>two  z</data>',
        '<Event><System><EventID></EventID></System><Data Name="k"></Data>', "<Events>", "<Event><EventID>7</EventID><Data Name=\"q>1</Data><Data Name='z'>2</Data>",
    ]
    rows = spark.createDataFrame([("f", b, 10 * i) for i, b in enumerate(blocks, 1)], "source_file string, value string, start_line long")
    parsed = parse_windows_xml(rows)
    events = {r.line_number: r for r in parsed.events.collect()}
    assert sorted(events) == [11, 40] and (events[11].event_code, events[11].provider) == ("1102", "P")
    assert [r.line_number for r in parsed.rejects.collect()] == [20]


def _related(spark):
    """Findings in one crowded minute and around the borders of the windows."""
    import random

    from tracelight.schema import FINDING, conform

    pick, kinds = random.Random(7), ["access_log", "access_log", "waf_log", "app_log", "db_log", "process", "linux_event", "account", "file"]
    rows = [(f"F-{i:08d}", pick.choice(kinds), pick.choice(["sqli", "rce", "db_auth_failure", "db_delay", "other"]), pick.choice([200, 500]),
             pick.choice([None, "8.8.8.8", "9.9.9.9"]), pick.choice([None, "/a", "/b"]), pick.choice([0, 1, 2, 119, 120, 121, 300, 301, 600, 601, 900, 1800, 5000]) + pick.randrange(2))
            for i in range(1, 260)]
    df = spark.createDataFrame(rows, "finding_id string, source_type string, category string, status int, remote_ip string, uri_path string, s long")
    return conform(df.withColumn("timestamp", F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).drop("s"), FINDING)


def test_summaries_list_no_pairs(spark, monkeypatch):
    from tracelight.operators import relations as R
    from tracelight.plans import correlation_queries as Q

    findings = _related(spark)
    pairs = R.relation_pairs(findings)
    number = F.substring("related_id", 3, 20).cast("bigint")
    whole = pairs.groupBy("relation", "dst_type").agg(F.count(F.lit(1)).alias("pairs"), F.sum("boost_src").alias("points_src"), F.sum("boost_dst").alias("points_dst"),
                                                      F.min(F.concat("src", "dst")).alias("first_pair"), F.max(F.concat("src", "dst")).alias("last_pair"))
    ids = R.related_ids(pairs).groupBy("finding_id").agg(F.count(F.lit(1)).alias("related"), F.min("related_id").alias("first_related"),
                                                         F.max("related_id").alias("last_related"), F.bit_xor(number).alias("mixed"))
    wanted = [{tuple(r) for r in df.collect()} for df in (whole, ids)]
    monkeypatch.setattr(Q, "derived_findings", lambda *_: findings)
    monkeypatch.setattr(R, "relation_pairs", None)  # the queries called it before
    assert {tuple(r) for r in Q.band_join_relations(spark, "").collect()} == wanted[0]
    assert {tuple(r) for r in Q.related_id_table(spark, "").collect()} == wanted[1]


def test_scores_leave_in_small_parts():
    import numpy as np
    import pyarrow as pa

    from tracelight.llm import toxicity as T

    model = T.ToxicityModel(T.Features.of(np.array([int.from_bytes(b"bad", "big") | 3 << 56], np.uint64)), np.array([2.0]), -1.0)
    texts = ["a bad one", None, "good", ""] * 200
    batch = pa.record_batch([pa.array(range(800)), pa.array(texts), pa.array(texts)], names=["id", "carried", "text"])
    parts = list(T.scored_parts(batch, 2, model))
    assert [len(s) for _, s in parts] == [256, 256, 256, 32]  # one part of all rows before
    assert np.array_equal(np.concatenate([s for _, s in parts]), model.scores(texts))
    assert pa.concat_arrays([c[0] for c, _ in parts]).to_pylist() == list(range(800))


def test_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    from tracelight.plans import registry

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setitem(registry.ROWS_PER_TASK, "events", 50)
    found = registry.table(spark, str(tmp_path), "events")
    assert found.rdd.getNumPartitions() == 20 and found.count() == 1000  # one per core before


def test_small_ranges_share_tasks(tmp_path):
    """each range was a task of its own and read a megabyte."""
    from tracelight.sources import ranges

    text = b"".join(b"<e>%d\n</e>\n" % i for i in range(20_000))
    (tmp_path / "a.xml").write_bytes(text)
    (tmp_path / "b.xml").write_bytes(text[:50_000])
    options = {"paths": str(tmp_path), "terminator": b"</e>".hex(), "rangeBytes": "4096", "record": "384"}
    rows = lambda reader: [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    for mode in ("terminated", "newlines", "records"):
        alone, shared = ranges.RangeReader(options | {"mode": mode}), ranges.RangeReader(options | {"mode": mode, "tasks": "4"})
        assert len(alone.partitions()) > 60 and len(shared.partitions()) <= 6
        assert rows(shared) == rows(alone)

    class Counted:
        read = 0

        def read_at(self, n, at):
            Counted.read += n
            return text[at : at + n]

    list(ranges.RangeReader(options | {"mode": "terminated"})._terminated(Counted(), len(text), 8192, 12_288))
    assert Counted.read < 20_000


def test_lines_of_one_file_are_not_shuffled_by_file(spark, lines):
    """the first event of a file was joined by a shuffle on the file's name."""
    import re

    from tracelight.sources import app

    texts = ["  at a.b(C.java:1)", "NullPointerException: x", "  at c.d", "2026-05-15 08:00:00 ERROR boom", "  at e.f"]
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        events = app.parse_app(lines(texts)).events
        plan = events._jdf.queryExecution().executedPlan().toString()
        found = {r.line_number: r.message_summary for r in events.collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert not re.search(r"SortMergeJoin \[source_file#\d+\]", plan)
    assert sorted(found) == [2, 4] and found[2].endswith("at c.d") and found[4].endswith("at e.f")


def test_long_app_lines_are_passed_few_times(spark, capsys):
    """a long line was cut into all its words, and each of its letters was tried as the start of an exception's name."""
    from tracelight.sources import app

    texts = {"2026-05-15 08:00:00, x": "2026-05-15T08:00:00Z", "2026-05-15T08:00:00Z": "2026-05-15T08:00:00Z", "[2026-05-15 08:00:00] x": "2026-05-15T08:00:00Z",
             "\t2026-05-15 08:00:00 x": None, "2026-05-15": None, "": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    seen = rows.select("t", app.leading_stamp(F.col("t"), "+00:00").alias("s"))
    assert {r.t: r.s for r in seen.collect()} == texts
    seen.explain()
    assert "split(ltrim(" not in capsys.readouterr().out.lower()
    long = "a" * 60_000 + " b.1x.IOError: y"  # quadratic before
    names = spark.createDataFrame([(long,), (long * 3,), ("1.Error",), ("plain",)], "t string").select(app.exception_type(F.col("t")).alias("e"))
    assert [r.e for r in names.collect()] == ["b.1x.IOError", "b.1x.IOError", None, None]


def test_relation_entries_are_made_once_per_combination(spark, monkeypatch):
    """Some fifty conditions were evaluated for every finding, and terms without a partner were kept."""
    from tracelight.operators import relations as R

    findings = _related(spark)
    asked = []
    shapes = R._shapes
    monkeypatch.setattr(R, "_shapes", lambda df, positive: asked.append(df.count()) or shapes(df, positive))
    ready = R.prepared(findings.unionByName(findings.withColumn("finding_id", F.concat(F.lit("G"), "finding_id"))))
    entries = R._entries(ready)
    once = R._entries(R.prepared(findings))
    assert asked[0] == asked[1] < 200 and entries.count() == 2 * once.count()
    alone = R._entries(R.prepared(findings.withColumn("source_type", F.lit("access_log"))))
    assert {r.term for r in alone.select("term").distinct().collect()} == {"origin"}


def test_lines_of_part_are_sorted_in_many_tasks(spark, tmp_path, monkeypatch):
    """all lines of a file of parts were sorted in the one task that read it."""
    import re

    from tracelight.plans import all_queries, registry

    spark.range(1000).selectExpr("id as p_partkey", "'b' as p_brand", "concat('n', id) as p_name").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setitem(registry.ROWS_PER_TASK, "part", 50)
    units = all_queries()["systemd_units"].run(spark, str(tmp_path))
    plan = units._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"RoundRobinPartitioning\(20\)", plan)  # read by one task before
    assert {tuple(r) for r in units.collect()} == {(f"svc{i}.service", "/opt/b; /bin/pre", "enabled_target:multi-user.target", f"n{i}") for i in range(1000)}


def test_strings_leave_in_small_parts():
    """all runs of ten thousand contents were held before the first left."""
    import pyarrow as pa

    from tracelight.sources import binary

    texts = [b"\x00".join(b"run %05d of %03d" % (i, k) for i in range(500)) for k in range(60)] + [b"", b"h\x00i\x00d\x00d\x00e\x00n\x00 \x00w\x00o\x00"]
    batch = pa.record_batch([pa.array([f"f{k}" for k in range(len(texts))]), pa.array([10] * len(texts), pa.int64()), pa.array(texts)], names=["path", "base", "piece"])
    parts = list(binary._find_strings(1 << 20)(iter([batch])))
    assert len(parts) > 5 and max(p.num_rows for p in parts) <= binary._HELD // 256  # one part before
    rows = [r for p in parts for r in p.to_pylist() if r["encoding"] == "ascii"]
    assert [r["raw"] for r in rows if len(r["raw"]) > 1] == [t.decode() for k in range(60) for t in texts[k].split(b"\x00")]
    assert {r["offset"] for r in rows if r["raw"] == "run 00001 of 007"} == {10 + 17}
    assert [(r["raw"], r["offset"], r["stop"]) for p in parts for r in p.to_pylist() if r["encoding"] == "utf16le" and len(r["raw"]) > 1] == [("hidden wo", 10, 28)]


def test_offsets_leave_in_small_parts():
    """the offsets of ten thousand contents were held as Python numbers before the first left."""
    import pyarrow as pa

    from tracelight.sources import signatures

    class Chunks:
        select = lambda self, *_: self
        mapInArrow = lambda self, scan, _: scan

    rules = [signatures.LiteralRule("n", "dense", (), (("a", False), ("A", True))), signatures.LiteralRule("n", "rare", (), (("xyz", False),))]
    texts = [b"a" * 50_000] * 6 + [b"none", b"xyz a xyz"]
    batch = pa.record_batch([pa.array([f"f{i}" for i in range(8)]), pa.array([0] * 7 + [100_000], pa.int64()), pa.array(texts)], names=["path", "offset", "content"])
    parts = list(signatures.chunk_hits(Chunks(), rules, 100_000)(iter([batch])))
    assert len(parts) >= 3  # one part before
    rows = [r for p in parts for r in p.to_pylist()]
    assert [(r["path"], r["rule_no"]) for r in rows[:6]] == [(f"f{i}", 0) for i in range(6)] and all(r["offsets"] == list(range(50_000)) for r in rows[:6])
    assert {(r["path"], r["rule_no"], r["base"], tuple(r["offsets"])) for r in rows[6:]} == {("f7", 0, 100_000, (100_004,)), ("f7", 1, 100_000, (100_000, 100_006))}


def test_logs_are_written_in_parts(spark, monkeypatch):
    """a file of a fleet was sorted and written by one task."""
    import os

    import pytest

    from tools.check_queries import compare, duck
    from tracelight.plans import all_queries, file_queries

    sf = os.environ.get("TRACELIGHT_TEST_SF", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("tables not present")
    folders, fresh = [], file_queries.fresh_folder
    monkeypatch.setattr(file_queries, "fresh_folder", lambda s: folders.append(fresh(s)) or folders[-1])
    monkeypatch.setattr(file_queries, "LINES_PER_PART", 40, raising=False)
    con = duck(sf)
    for name in ("mixed_files", "iis_files", "history_files", "talk_files", "xml_files", "xml_file_lines"):
        q = all_queries()[name]
        ok, detail, _ = compare(spark, con, name, q.run, q.sql, sf)
        assert ok is True, (name, detail)
        found = [f for _, _, files in os.walk(folders[-1].removeprefix("file:")) for f in files if f.endswith(".txt")]
        assert len(found) > 20 or name == "talk_files", (name, len(found))  # one for each log before
        assert len({f.split("-")[1] for f in found}) > 1, name


def test_numbering_sorts_in_tasks_by_rows(spark, monkeypatch):
    """wide rows that compress well were joined into few large ranges before they were sorted."""
    from tracelight.operators import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 50, raising=False)
    rows = spark.range(1000).select(((F.col("id") * 7) % 1000).alias("k"), F.when(F.col("id") % 3 > 0, F.lit("same" * 50)).alias("wide"))
    found = ordered.global_index(rows, ["k"], "no")
    assert found.rdd.getNumPartitions() == 20  # one before
    assert [r.no for r in found.orderBy("k").collect()] == list(range(1, 1001))
    assert ordered.global_index(rows.where("false"), ["k"], "no").count() == 0


def test_a_line_is_read_by_its_case_alone(spark, lines):
    """the fields of every format were worked out for every line, from NULL text where it had another."""
    import re

    from tracelight.sources import web

    texts = ['1.2.3.4 - - [15/May/2026:08:00:00 +0000] "GET /a?b HTTP/1.1" 200 5 "-" "x"', '{"remote_ip": "1.2.3.5", "method": "GET", "uri": "/b"}']
    events = web.parse_web(lines(texts[:1], "one.log").unionByName(lines(texts[1:], "two.log"))).events
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert {m for m in re.findall(r"CASE WHEN \(_case#\d+ = (\d)\) THEN struct\(", plan)} == {"0", "1", "2"}  # none before
    assert {(r.remote_ip, r.uri_path, r.parser_name) for r in events.collect()} == {("1.2.3.4", "/a", "common_access"), ("1.2.3.5", "/b", "json_access")}
