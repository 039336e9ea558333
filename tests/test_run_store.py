"""Runs kept version by version."""

from __future__ import annotations

import random
from collections import Counter

from tracelight.operators.run_store import RunStore


def test_diff_reads_changed_buckets_only(spark, tmp_path):
    random.seed(3)
    schema = "host string, path string, digest string, size long"
    row = lambda i: (f"h{i % 5}" if i % 40 else None, f"/srv/{i}", f"d{i}", i if i % 7 else None)
    first = [row(i) for i in range(500)]
    second = [r if i not in (10, 11, 480) else (*r[:2], "other", r[3]) for i, r in enumerate(first)]
    second = second[:495] + [("new", f"/n{i}", None, 1) for i in range(3)] + [second[20]] * 2 + [(None, "/srv/0", "d0", 9)]
    random.shuffle(second)
    store = RunStore(spark, str(tmp_path / "store"), ["host", "path"], buckets=64)
    assert store.runs() == []
    store.write(spark.createDataFrame(first, schema).repartition(7), "a")
    store.write(spark.createDataFrame(second, schema), "b")
    store.write(spark.createDataFrame(first[::-1], schema), "c")
    assert store.runs() == ["a", "b", "c"] and store.changed_buckets("a", "c") == [] and store.diff("a", "c").count() == 0
    changed = store.changed_buckets("a", "b")
    assert 5 <= len(changed) <= 20
    got = Counter((r.change, r.host, r.path, r.digest, r.size) for r in store.diff("a", "b").collect())
    old, new = Counter(first), Counter(second)
    gone, fresh = list((old - new).elements()), list((new - old).elements())
    want = Counter()
    for key in {r[:2] for r in gone + fresh}:
        a, b = [r for r in gone if r[:2] == key], [r for r in fresh if r[:2] == key]
        kinds = Counter({"changed": min(len(a), len(b)), "new": max(0, len(b) - len(a)), "gone": max(0, len(a) - len(b))})
        assert Counter(c for (c, h, p, *_), n in got.items() for _ in range(n) if (h, p) == key) == +kinds
        want += Counter(r for r in b)
    assert Counter({r[1:]: n for r, n in got.items() if r[0] != "gone"}) == want
    plan = store.read("b", changed)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    store.write(spark.createDataFrame(first, schema), "b")
    assert store.changed_buckets("a", "b") == []
    spark.createDataFrame(first, schema).write.parquet(str(tmp_path / "store" / "rows" / "run=died"))
    assert store.runs() == ["a", "b", "c"]  # a run without its summary does not count
    empty = RunStore(spark, str(tmp_path / "empty"), ["host"], buckets=4)
    empty.write(spark.createDataFrame([], schema), "x")
    empty.write(spark.createDataFrame(first[:3], schema), "y")
    assert Counter(r.change for r in empty.diff("x", "y").collect()) == {"new": 3}
