"""Prefix forest and URL cascade against plain versions."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_forest_with_copies_and_bad_rows(spark):
    from tracelight.llm.forest import nearest

    random = np.random.default_rng(8)
    vectors = random.normal(size=(400, 12)).astype(np.float32)
    vectors[50:130] = vectors[20]  # many copies, two queries among them
    rows = [(i, v.tolist(), 1, float(i)) for i, v in enumerate(vectors)]
    bad = [(400, None), (420, [0.0] * 12), (440, [float("nan")] + [1.0] * 11), (460, [1.0] * 11 + [None]), (480, [1.0] * 5), (None, [1.0] * 12), (500, []), (520, [float("inf")] + [0.0] * 11)]
    df = spark.createDataFrame(rows + [(i, v, 1, 0.0) for i, v in bad] + rows[:3], "vec_id long, embedding array<float>, rank int, score double")
    got, want = found(nearest(df, trees=6, reach=10_000, block_rows=64)), brute.nearest(list(range(400)), vectors)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-9)
    assert found(nearest(df.limit(0))) == {}
    assert found(nearest(df.where("vec_id < 5"))).get(0) is not None and len(found(nearest(df.where("vec_id < 5")))[0]) == 4


def exact(spark, vectors, every=20):
    return spark.createDataFrame([(q, i) for q, best in brute.nearest(list(range(len(vectors))), vectors, every).items() for i, _ in best], "query_id long, vec_id long")


@pytest.mark.parametrize("kind", ["groups", "none", "tight"])
def test_forest_recall(spark, kind):
    """What the trees offer, and nothing else, holds nine tenths of the true neighbours: in groups, without structure, with a third of all rows almost equal."""
    from tracelight.llm.forest import nearest, recall

    random = np.random.default_rng(9)
    n, d = 5000, 32
    vectors = random.normal(size=(n, d))
    if kind == "groups":
        vectors = (random.normal(size=(40, d))[random.integers(0, 40, n)] + 0.4 * vectors) * random.uniform(0.5, 2, (n, 1))
    if kind == "tight":
        vectors[: n // 3] = vectors[0] + 1e-9 * vectors[: n // 3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = nearest(df, block_rows=256)
    rows = found(got)
    assert len(rows) == n // 20 and all(len(r) == 20 for r in rows.values())
    for q, best in rows.items():
        assert [s for _, s in best] == pytest.approx([float((vectors[i] * vectors[q]).sum()) for i, _ in best], rel=1e-12)
        assert best == sorted(best, key=lambda b: (-b[1], b[0])) and q not in [i for i, _ in best]
    if kind == "tight":  # which of the equal ones is nearest is a matter of the last digits: compare by score
        want = brute.nearest(list(range(n)), vectors)
        assert np.mean([b[1] >= w[-1][1] - 1e-9 for q, w in want.items() for b in rows[q]]) >= 0.9
    else:
        assert recall(got, exact(spark, vectors)) >= 0.9


def test_forest_searches_few_rows_of_groups(spark):
    """In grouped vectors the fitted search offers a small share of all rows."""
    from tracelight.llm import forest

    random = np.random.default_rng(12)
    vectors = random.normal(size=(200, 24))[random.integers(0, 200, 6000)] + 0.2 * random.normal(size=(6000, 24))
    entries = spark.createDataFrame([(int(random.integers(-(1 << 62), 1 << 62)), v.tolist(), i % 20 == 0) for i, v in enumerate(vectors)], "rep long, v array<double>, asks boolean")
    fitted = forest._fitted(entries, 6000, float(np.linalg.norm(vectors, axis=1).max()), 32, 7, 256)
    steps = forest._calibrated(entries, fitted, 20, 0.93)
    assert 1 <= steps < 0.03 * 6000, steps  # rows to a side, of a sketch that holds all rows
    own, codes = fitted.codes(vectors[:40], False), fitted.codes(vectors, True)
    low, high = fitted.intervals(own, steps)
    inside = (codes[None] >= low[:, None]) & (codes[None] <= high[:, None])
    assert np.array_equal(inside.any(axis=2), fitted.steps(own, np.broadcast_to(codes, (40, *codes.shape))) <= steps)
    assert np.median(inside.sum(axis=1)) <= 2 * steps + 2  # equal strings at a border come along


URLS = [None, "", "no scheme", "http://a.net/x", "HTTP://Sub.Example.NET/en/1?q#f", "https://example.com/de/", "https://x.example.com/de", "http://w.org/fr/a", "http://w.org/fr",
        "http://net/", "http://net", "http://xnet/", "https://m.casino-win.example.com/en/4", "https://casino-win.example.org/fr/1", "x://ÄB.example.com/de/é?://", "://", "a://b://c/d",
        "http://example.net/EN/", "http://a..net/", "http://" + "a." * 2000 + "net/p", "http://free-bets.example.com:80/", "http://a.net/x"]


@pytest.mark.parametrize("rules,hosts", [(None, None), ((), ()), ((("b/", "block"), ("a/x", "allow")), ("c",))])
def test_urls(spark, rules, hosts):
    from tracelight.llm.url_filter import BLOCKED_HOSTS, RULES, judge_urls

    rules, hosts = RULES if rules is None else rules, BLOCKED_HOSTS if hosts is None else hosts
    df = spark.createDataFrame([(i, u, "keep", None) for i, u in enumerate(URLS)], "page_id long, url string, note string, rule string")
    got = {r.page_id: r for r in judge_urls(df, rules=rules, blocked_hosts=hosts, carry=("note", "rule")).collect()}
    assert len(got) == len(URLS) and got[0].note == "keep"
    for i, url in enumerate(URLS):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        under = lambda h: host == h or host.endswith("." + h)
        fits = sorted(((-len(r), r, v) for r, v in rules if under(r.split("/")[0]) and path.startswith("/" + r.split("/", 1)[1])))
        verdict = fits[0][2] if fits else "block" if any(under(h) for h in hosts) else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, fits[0][1] if fits else None, verdict), url
    assert judge_urls(df.limit(0)).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    from pyspark.sql import functions as F

    from tracelight.llm.url_filter import build_cascade

    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 37 == 0).alias("listed"), F.lit(False).alias("none"), F.lit(True).alias("all"))
    cascade = build_cascade(universe, "listed")
    assert len(cascade.levels) > 2
    assert universe.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0
    assert universe.where(build_cascade(universe, "none").contains(F.col("key"))).count() == 0
    assert universe.where(~build_cascade(universe, "all").contains(F.col("key"))).count() == 0
    with pytest.raises(ValueError):
        build_cascade(universe, "listed", max_filter_bits=64)
