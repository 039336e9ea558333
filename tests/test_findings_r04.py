"""One small case per settled finding of the fourth round: related findings on bounded disk."""

from __future__ import annotations

import os
import random
import time

from pyspark.sql import functions as F

from tracelight.schema import FINDING, conform


def _findings(spark):
    pick, kinds = random.Random(11), ["access_log", "access_log", "waf_log", "app_log", "db_log", "process", "linux_event", "account", "file", "ioc"]
    rows = [(f"F-{i:08d}", pick.choice(kinds), pick.choice(["sqli", "rce", "db_auth_failure", "db_delay", "other"]), pick.choice([200, 500]),
             pick.choice([None, "8.8.8.8", "9.9.9.9"]), pick.choice([None, "/a", "/b"]), pick.choice(["m", None]),
             pick.choice([0, 1, 2, 119, 121, 300, 601, 900, 1800, 5000]) + pick.randrange(3)) for i in range(1, 260)]
    df = spark.createDataFrame(rows, "finding_id string, source_type string, category string, status int, remote_ip string, uri_path string, machine string, s long")
    return conform(df.withColumn("timestamp", F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).drop("s"), FINDING)


def _spied(monkeypatch):
    from tracelight import session

    sizes, write = [], session.Scratch.write

    def spy(self, df):
        done = write(self, df)
        sizes.append((done.columns, done.count()))
        return done

    monkeypatch.setattr(session.Scratch, "write", spy)
    return sizes


def _entries_per_write(sizes):
    return [n for columns, n in sizes if "term" in columns and "is_http" in columns]


def test_nearest_lists_in_passes(spark, monkeypatch):
    from tracelight.operators import relations as R

    findings = _findings(spark)
    pairs = [(r.src, r.dst) for r in R.relation_pairs(findings).collect()]
    at = {r.id: r.at for r in R.prepared(findings).collect()}
    want = {}
    for a, b in pairs + [(b, a) for a, b in pairs]:
        want.setdefault(a, []).append((abs(at[a] - at[b]), b))
    kinds = {r.finding_id: r.source_type for r in findings.collect()}
    monkeypatch.setattr(R, "cut_lineage", None)  # all entries were kept, and a moment sought 2k + 2 places as rows
    sizes = _spied(monkeypatch)
    for per_pass in (1_000_000, 100):
        monkeypatch.setattr(R, "FINDINGS_PER_PASS", per_pass)
        sizes.clear()
        near = R.nearest_lists(R.prepared(findings), 4).collect()
        assert {r.id: [(p.apart, p.partner) for p in r.near] for r in near} == {a: sorted(p)[:4] for a, p in want.items()}
        assert all(p.kind == kinds[p.partner] and p.n == n for r in near for n, p in enumerate(r.near, 1))
        entries = _entries_per_write(sizes)
        assert len(entries) == (1 if per_pass > 100 else 3)
        whole = entries[0] if per_pass > 100 else whole  # noqa: F821
        assert sum(entries) == whole
    ids = {r.finding_id: r.related_ids for r in R.with_nearest_ids(findings, k=3).collect()}
    assert ids == {i: [p for _, p in sorted(want.get(i, []))[:3]] for i in kinds}


def test_summary_counts_and_edges_in_passes(spark, monkeypatch):
    from tracelight.operators import relations as R
    from tracelight.operators.components import connected_components

    findings = _findings(spark)
    pairs = {(r.src, r.dst) for r in R.relation_pairs(findings).collect()}
    want, kinds = {}, {r.finding_id: r.source_type for r in findings.collect()}
    for a, b in pairs | {(b, a) for a, b in pairs}:
        want.setdefault(a, []).append(b)
    root = {i: i for i in want}
    for _ in want:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    monkeypatch.setattr(R, "cut_lineage", None)  # the entries of all findings were kept at once
    sizes = _spied(monkeypatch)
    monkeypatch.setattr(R, "FINDINGS_PER_PASS", 130)
    summary = {r.finding_id: (r.related, r.first_related, r.last_related, r.mixed) for r in R.related_summary(findings, F.substring("finding_id", 3, 20).cast("bigint")).collect()}
    assert len(_entries_per_write(sizes)) == 2
    for i, others in want.items():
        mixed = 0
        for o in others:
            mixed ^= int(o[2:])
        assert summary.pop(i) == (len(others), min(others), max(others), mixed)
    assert not summary
    counts = {(r.id, r.partner_type): r.partners for r in R.partner_counts(R.prepared(findings)).collect()}
    assert counts == {(i, k): n for i, o in want.items() for k in set(kinds.values()) if (n := sum(kinds[p] == k for p in o))}
    edges = R.component_edges(R.prepared(findings))
    assert {r.member: r.component for r in connected_components(edges).collect()} == root


def test_rounds_and_shuffles_leave_the_disk(spark):
    from tracelight.operators.components import connected_components
    from tracelight.session import ensure_checkpoint_dir, written

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    tables = lambda: {d for d in os.listdir(folder) if d.startswith("tracelight-") and os.path.isdir(f"{folder}/{d}")}
    chain = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(300)], "src string, dst string")
    before = tables()
    assert {r.component for r in connected_components(chain).collect()} == {"0000"}
    assert len(tables() - before) == 1  # a checkpoint per round before

    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {str(f) for f in _java_list(files.getAllFiles()) if "shuffle_" in str(f)}
    before = shuffles()
    assert written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    for _ in range(50):
        left = {f for f in shuffles() - before if f.endswith(".data")}
        if len(left) <= 1:  # that of the last count
            break
        time.sleep(0.2)
    assert len(left) <= 1


def _java_list(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_groups_longer_than_a_batch(monkeypatch):
    import pyarrow as pa

    from tracelight.operators import neighbours as N

    pick = random.Random(5)
    rows = sorted((pick.randrange(12), [pick.randrange(9) << N.APART_SHIFT | pick.randrange(30) << N.NUMBER_SHIFT | 5 for _ in range(3)]) for _ in range(200))
    schema = pa.schema([("number", pa.int64()), pa.field("partners", pa.list_(pa.field("element", pa.int64())))])
    batches = [pa.record_batch([[n for n, _ in rows[i : i + 7]], [p for _, p in rows[i : i + 7]]], schema=schema) for i in range(0, 200, 7)]
    wanted = {}
    for n, packed in rows:
        for p in packed:
            other = p >> N.NUMBER_SHIFT & (1 << N.NUMBER_BITS) - 1
            if other != n:
                wanted.setdefault(n, {})[other] = min(p, wanted.get(n, {}).get(other, N.NONE))
    for at_once in (10, 40, 1000):
        monkeypatch.setattr(N, "ROWS_AT_ONCE", at_once)
        got = [(r["number"], r["partners"]) for b in N.nearest_of_lists(4)(iter(batches)) for r in b.to_pylist()]
        assert got == [(n, sorted(p.values())[:4]) for n, p in sorted(wanted.items())]
