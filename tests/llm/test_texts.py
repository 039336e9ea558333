"""Quality rules, substring dedup, SimHash and toxicity against plain versions."""

from __future__ import annotations

import zlib
from pathlib import Path
import sys

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

SF = "/root/testdata/sf0.001"
have_tables = pytest.mark.skipif(not Path(SF).exists(), reason="tables not present")


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}", 0, 7, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, kept int, score string")


def mixed_texts(n=60, seed=5):
    """Prose with exact copies, near copies, shared passages and periodic texts."""
    random = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 20
    draw = lambda k: [vocabulary[i] for i in random.integers(0, len(vocabulary), k)]
    passage, line = draw(60), draw(24)
    out = []
    for i in range(n):
        w = draw(int(random.integers(5, 200)))
        if i % 3 == 0:
            at = int(random.integers(0, len(w)))
            w[at:at] = passage
        if i % 4 == 1:
            w = w + line + draw(3) + line
        if i % 10 == 7:
            w = ["round", "and", "about"] * 15 + w
        text = " ".join(w)
        out += [text] * (3 if i % 7 == 0 else 1)
        if i % 6 == 2:
            w[len(w) // 2] = "changed"
            out.append("\n".join([" ".join(w[:10]), " ".join(w[10:])]))
    return out + brute.ODD_TEXTS


def test_base_counts(spark):
    from tracelight.llm.quality import judge

    texts = mixed_texts()
    got = {r.doc_id: r for r in judge(docs_of(spark, texts), carry=("source", "n_words", "kept", "score")).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_counts(text), text
        assert r.source == f"s{i % 3}" and r.score is None
        assert not (r.kept and r.base_failed)
    assert judge(docs_of(spark, texts).limit(0)).count() == 0
    assert judge(docs_of(spark, ["a b"], [None])).collect()[0].base_failed


def test_js_distance(spark):
    from pyspark.sql import functions as F

    from tracelight.llm.quality import js_distance, total

    cases = [([1, 0], [0, 1]), ([1, 1], [2, 2]), ([3, 1, 0], [1, 1, 2])]
    df = spark.createDataFrame(cases, "p array<long>, q array<long>").select(js_distance(F.col("p"), total(F.col("p")), F.col("q"), total(F.col("q"))).alias("d"))
    got = [r.d for r in df.collect()]
    for (p, q), d in zip(cases, got):
        a, b = np.array(p) / sum(p), np.array(q) / sum(q)
        m = (a + b) / 2
        kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m) if v)
        assert d == pytest.approx(np.sqrt((kl(a) + kl(b)) / 2), abs=1e-9)
    assert spark.createDataFrame([([0, 0], [1, 1])], "p array<long>, q array<long>").select(js_distance(F.col("p"), total(F.col("p")), F.col("q"), total(F.col("q")))).collect()[0][0] is None


@have_tables
def test_quality_keeps_clean_and_drops_junk(spark):
    from tracelight.llm.quality import judge

    got = judge(spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")).join(spark.read.parquet(f"{SF}/../sf0.01/labels.parquet"), "doc_id").where("n_words >= 50")
    good, junk = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert junk.where("not kept").count() >= 0.85 * junk.count()


@pytest.mark.parametrize("shard,block", [(256, 2_000_000), (2, 3000)])
def test_substring_dedup(spark, monkeypatch, shard, block):
    from tracelight.llm import substring

    monkeypatch.setattr(substring, "SHARD_PIECES", shard)
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    texts = mixed_texts()
    ids = [(i * 37) % 1009 for i in range(len(texts))]
    docs = docs_of(spark, texts, ids)
    got = sorted(substring.remove_repeats(docs, carry=("source", "n_words")).collect(), key=lambda r: r.doc_id)
    want = brute.without_repeats(list(zip(ids, texts)))
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == want
    assert sum(w[1] for w in want) > 1000
    for r in got:
        text = texts[ids.index(r.doc_id)]
        if not r.n_removed:
            assert r.kept_text == text and r.removed_spans == []
        else:
            assert sum(s.stop - s.start for s in r.removed_spans) == r.n_removed
        assert r.source == f"s{ids.index(r.doc_id) % 3}"


def test_substring_dedup_edges(spark):
    from tracelight.llm.substring import remove_repeats

    assert remove_repeats(docs_of(spark, []).limit(0)).count() == 0
    long = " ".join(f"v{i}" for i in range(30))
    rows = remove_repeats(docs_of(spark, [long, long, long, None], [5, 5, None, None])).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_removed) for r in rows) == [(False, 30, 0), (False, 30, 30), (True, 0, 0), (True, 30, 30)]
    huge = remove_repeats(docs_of(spark, ["a " * 50_000])).collect()[0]
    assert (huge.n_words, huge.n_removed) == (50_000, 49_999)


def test_automaton_statistics():
    from tracelight.llm.substring import PieceAutomaton

    random = np.random.default_rng(2)
    for _ in range(40):
        pieces = [random.integers(0, 3, int(random.integers(1, 25))).tolist() for _ in range(4)]
        automaton = PieceAutomaton()
        for p in pieces[:-1]:
            automaton.add(p)
        parts = {tuple(p[i:j]) for p in pieces[:-1] for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        q = pieces[-1]
        want = [max([n for n in range(1, e + 2) if tuple(q[e + 1 - n : e + 1]) in parts], default=0) for e in range(len(q))]
        assert automaton.matches(q) == want


def test_simhash(spark):
    from tracelight.llm.simhash import near_duplicates

    texts = mixed_texts(80)
    ids = [(i * 31) % 2003 if i % 40 else None for i in range(len(texts))]
    got = near_duplicates(docs_of(spark, texts, ids), carry=("source", "score")).collect()
    prints = [brute.fingerprint(t) for t in texts]
    want = sorted((str(i), f"{p:016x}", str(c)) for i, p, c in zip(ids, prints, brute.components(ids, prints)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("limit", [2048, 8])
def test_fingerprint_links(spark, limit):
    """Chains and dense groups of fingerprints, with and without split buckets."""
    from tracelight.llm.components import connected_components
    from tracelight.llm.simhash import fingerprint_links

    random = np.random.default_rng(3)
    prints = set(int(x) for x in random.integers(0, 1 << 63, 300))
    for seed in list(prints)[:20]:
        x = seed
        for _ in range(30):
            for b in random.integers(0, 64, int(random.integers(1, 5))):
                x ^= 1 << int(b)
            prints.add(x)
    center = (1 << 64) - 1
    prints |= {center ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a)} | {0, 1, 3, 1 << 63}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "_fp long")
    roots = {r.node: r.root for r in connected_components(fingerprint_links(df, bucket_rows=limit)).collect()}
    want = brute.components(list(range(len(prints))), prints)
    groups_got, groups_want = {}, {}
    for i, s in enumerate(signed):
        groups_got.setdefault(roots.get(s, s), set()).add(i)
        groups_want.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, groups_got.values())) == sorted(map(sorted, groups_want.values()))


def test_components(spark):
    from tracelight.llm.components import connected_components

    edges = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(100, 150)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in [*range(100, 150), 200]} | {300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@have_tables
def test_toxicity_on_held_out_documents(spark):
    from tracelight.llm.toxicity import fit, score

    folder = f"{SF}/../sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = fit(docs, labels)
    got = score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    for r in got[:200]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    hits = sum(r.predicted and r.toxic for r in held)
    assert hits >= 0.8 * sum(r.toxic for r in held)
    assert hits >= 0.9 * sum(r.predicted for r in held)


def test_toxicity_of_long_texts(spark):
    """A text owns only the n-grams that it holds: long clean and toxic texts are told apart like short ones."""
    from tracelight.llm.toxicity import fit, score

    random = np.random.default_rng(31)
    word = lambda: "".join(chr(97 + c) for c in random.integers(0, 26, int(random.integers(3, 9))))
    vocabulary = [word() for _ in range(3000)]
    draw = lambda k: [vocabulary[i] for i in random.integers(0, 3000, k)]
    insult = ["vile", "fool", "wretched", "scum", "idiot"]
    texts = [" ".join(w if not i % 2 or k % 5 else insult[int(random.integers(0, 5))] for k, w in enumerate(draw(60))) for i in range(400)]
    long = [" ".join(word() for _ in range(150_000)) for _ in range(3)]
    assert min(map(len, long)) > 900_000
    docs = docs_of(spark, texts + long + [t + " " + " ".join(insult * 20) for t in long])
    model = fit(docs, spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in score(docs, model).collect() if r.doc_id >= 400}
    assert min(got[i] for i in (403, 404, 405)) > max(got[i] for i in (400, 401, 402))
    held = {g for t in long[:1] for n in (3, 4, 5, 6, 7) for g in (t[i : i + n] for i in range(len(t) - n + 1))}
    _, feature = _features(model, long[0])
    names = [int(g).to_bytes(8, "big") for g in model.features.grams]
    own = {i for i, x in enumerate(names) if x[-x[0] :].decode() in held or x[-x[0] :].decode() in (" " + long[0] + " ")}
    assert set(feature.tolist()) == own and len(own) < len(names)


def _features(model, text):
    from tracelight.llm.toxicity import _grams

    return _grams([text], model.features)


def test_toxicity_edges(spark):
    from tracelight.llm.toxicity import fit, score

    texts = ["nice day " * 5, "you vile fool " * 5] * 40 + [None, ""]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    rows = score(docs, fit(docs, labels), carry=("lang", "score")).collect()
    assert len(rows) == 82 and all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id < 80)
    assert rows[0].lang == "en"
    empty = [r.score for r in rows if r.doc_id >= 80]
    assert empty[0] == empty[1]
    none = score(docs, fit(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.0} or max(r.score for r in none) < 1e-9
    assert score(docs.limit(0), fit(docs, labels.where("toxic = 1"))).count() == 0


@pytest.mark.parametrize("most", [1, 7, 100, 5000])
def test_most_telling(spark, most):
    from tracelight.llm.toxicity import most_telling

    random = np.random.default_rng(most)
    rows = [(int(g), float(c)) for g, c in zip(random.permutation(3000), np.round(random.exponential(3, 3000), 1))]
    table = spark.createDataFrame(rows, "gram long, chi double").repartition(30)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[:most]
    assert [(r.gram, r.chi) for r in most_telling(table, most).collect()] == want
    assert most_telling(table.limit(0), most).count() == 0
