"""The five stages: each one's decisions on its own input, and the whole run."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="tables not present")


def jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = [x.lower() for x in brute.words(t)]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_documents(spark):
    """Edited copies at and above the bound are found, and different texts stay apart."""
    from tracelight.llm.near_copies import similar_documents

    random = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts, pairs = [], []
    for _ in range(300):
        w = [vocabulary[i] for i in random.integers(0, 4000, int(random.integers(80, 400)))]
        texts.append(" ".join(w))
        for _ in range(max(1, len(w) // 70)):
            w[int(random.integers(0, len(w)))] = vocabulary[int(random.integers(0, 4000))]
        pairs.append((len(texts) - 1, len(texts)))
        texts.append("\n".join([" ".join(w[:30]).upper(), " ".join(w[30:])]))
    texts += brute.ODD_TEXTS
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar_documents(df).collect()}
    assert set(got) == set(range(len(texts)))
    close = [(a, b) for a, b in pairs if jaccard(texts[a], texts[b]) >= 0.8]
    assert len(close) > 150
    assert sum(got[a] == got[b] for a, b in close) >= 0.9 * len(close)
    sizes = {}
    for i in range(600):
        sizes.setdefault(got[i], []).append(i)
    assert all(len(g) <= 2 for g in sizes.values())
    empty = [600 + i for i, t in enumerate(brute.ODD_TEXTS) if not brute.words(t)]
    assert len({got[i] for i in empty}) == 1
    assert similar_documents(df.limit(0)).count() == 0


def changed(words, similarity, random, k=5):
    """``words`` with words replaced until the similarity is at most ``similarity``."""
    w, sets = list(words), lambda x: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
    own = sets(w)
    while True:
        now = sets(w)
        if len(own & now) / len(own | now) <= similarity:
            return w
        w[int(random.integers(0, len(w)))] = f"new{int(random.integers(0, 1 << 30))}"


def test_similarity_is_exact(spark):
    """Planted pairs on both sides of the bound: links are those of at least 0.8 exactly."""
    from tracelight.llm.near_copies import similar_documents

    random = np.random.default_rng(21)
    texts = []
    for i in range(400):
        w = [f"w{x}" for x in random.integers(0, 5000, 600)]
        target = random.uniform(0.65, 0.799) if i % 2 else random.uniform(0.81, 0.86)
        texts += [" ".join(w), " ".join(changed(w, target, random))]
    template = [f"t{x}" for x in random.integers(0, 5000, 600)]
    texts += [" ".join(changed(template, 0.86, random)) for _ in range(60)]  # about 0.75 to each other
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    pairs = [(2 * i, 2 * i + 1) for i in range(400)]
    close = {p for p in pairs if jaccard(texts[p[0]], texts[p[1]]) >= 0.8}
    joined = {p for p in pairs if got[p[0]] == got[p[1]]}
    assert len(close) == 200 and joined <= close and len(joined) >= 0.98 * len(close)
    near = range(800, len(texts))
    alone = [a for a in near if all(a == b or jaccard(texts[a], texts[b]) < 0.8 for b in near)]
    assert len(alone) > 30 and all(got[a] == a and sum(c == a for c in got.values()) == 1 for a in alone)


def test_near_copies_go_by_row(spark):
    """Ids that are null or repeat: one row of each group stays, and no text is lost."""
    from tracelight.llm.stages import drop_near_copies

    random = np.random.default_rng(22)
    a, b, c, d = ([f"{x}{i}" for i in random.integers(0, 5000, 300)] for x in "abcd")
    edit = lambda w: " ".join([*w[:150], "edited", *w[150:]])
    rows = [
        (None, " ".join(a), "en"), (None, edit(a), "en"),  # both without an id
        (5, " ".join(b), "en"), (5, " ".join(b), "en"),  # equal rows
        (1, " ".join(c), "en"), (7, edit(c), "en"), (7, " ".join(d), "en"),  # one id, two texts, one of them a copy
        (None, edit(d), "en"),
    ]
    kept = drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert kept[0].__fields__ == ["doc_id", "text", "lang"]
    assert sorted((str(r.doc_id), r.text[0]) for r in kept) == [("1", "c"), ("5", "b"), ("7", "d"), ("None", "a")]


def test_stages(spark):
    import corpus_pipeline
    from tracelight.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF))
        assert out.columns == columns
        before, after = docs.toPandas().set_index("doc_id"), out.toPandas().set_index("doc_id")
        assert set(after.index) <= set(before.index)
        if name != "substring_dedup":
            assert after.text.equals(before.text.loc[after.index]) and len(after) < len(before)
        else:
            assert len(after) == len(before)
            want = brute.without_repeats([(i, t) for i, t in before.text.items()])
            assert [len(brute.words(t)) for t in after.text.sort_index()] == [n - r for n, r, _ in want]
            assert (after.n_chars == after.text.str.len()).all()
        kept[name] = set(after.index)
        docs = out
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    clean, toxic = set(labels.index[labels.toxic == 0]), set(labels.index[labels.toxic == 1])
    assert len(kept["toxicity"] & clean) >= 0.98 * len(clean) and len(kept["toxicity"] & toxic) <= 0.25 * len(toxic)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == kept["substring_dedup"]
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.max()).all()
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 14)} == {n.split("_")[0] + "_" for n in names if n.startswith("op") and n[2].isdigit()}
    assert {"op10_url_filter", "op11_secret_scan"} <= set(entry.oracle_sql())


def test_url_sql(spark):
    from tools.check_queries import compare, duck
    from tracelight.llm.queries import QUERIES, SQL

    for folder in (SF, "/root/testdata/sf0.001"):
        ok, detail, _ = compare(spark, duck(folder), "op10_url_filter", QUERIES["op10_url_filter"], SQL["op10_url_filter"], folder)
        assert ok, detail


def test_hot_buckets_are_split(spark):
    """A third of all rows are near copies of one text; with buckets of 16 rows nothing else comes out."""
    from tracelight.llm.near_copies import similar_documents

    random = np.random.default_rng(5)
    base = [f"w{x}" for x in random.integers(0, 5000, 200)]
    texts = [" ".join(changed(base, 0.94, random)) for _ in range(120)] + [" ".join(f"w{x}" for x in random.integers(0, 5000, 150)) for _ in range(240)]
    texts += texts[:20] + ["a", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain, split = ({r.doc_id: r.component_id for r in similar_documents(df, hot_rows=h).collect()} for h in (1 << 14, 16))
    assert plain == split and len({plain[i] for i in range(120)}) == 1 and all(plain[i] == i for i in range(120, 360))


CLASHES = ["score", "predicted", "held_out", "kept", "base_failed", "n_words", "n_removed", "kept_text", "kept_sha256", "removed_spans", "char_distance", "word_distance",
           "_id", "_row", "_hash", "_node", "_file", "_fp", "_start", "_n", "_key", "_block", "_text", "_c0", "row", "id", "hash", "t", "node", "code", "bands", "file", "start", "n",
           "c0", "c1", "x2_", "bucket", "first", "component_id", "low", "label", "with.dot", "with space"]


@pytest.mark.parametrize("stage", ["drop_toxic", "drop_poor", "drop_near_copies", "drop_repeats"])
def test_stages_keep_their_input(spark, stage):
    """Columns of any name, null and empty texts, null and equal ids, one text of a megabyte, an empty table."""
    from pyspark.sql import functions as F

    from tracelight.llm import stages

    apply = getattr(stages, stage)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (None, "", None, "s", 0), (7, "", "xx", None, 0), (7, None, "de", "s", None), (9_000, "long words here and the text of it " * 30_000, "en", "s", 1)],
                                "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])
    whole = docs.unionByName(odd)
    plain = apply(spark, whole, SF)
    wide = whole.select("*", *[(F.coalesce("doc_id", F.lit(-1)) * 100 + i).alias(c) for i, c in enumerate(CLASHES)])
    out = apply(spark, wide, SF)
    assert out.columns == wide.columns and out.schema["score"].dataType == wide.schema["score"].dataType
    rows = out.collect()
    assert sorted(map(str, plain.collect())) == sorted(str(plain_row(r, docs.columns)) for r in rows)
    for r in rows:
        assert [r[5 + i] for i in range(len(CLASHES))] == [(-1 if r.doc_id is None else r.doc_id) * 100 + i for i in range(len(CLASHES))]
    if stage == "drop_repeats":
        assert len(rows) == 305 and sum(r.text is None for r in rows) == 2
        assert next(r.n_chars for r in rows if r.doc_id == 9_000) < 2000  # all but the first words of it repeat
    if stage == "drop_poor":
        assert all(r.text for r in rows)
    if stage == "drop_near_copies":
        assert sum(not r.text for r in rows) == 1 and any(r.doc_id == 9_000 for r in rows)
    assert apply(spark, wide.limit(0), SF).count() == 0


def plain_row(row, columns):
    from pyspark.sql import Row

    return Row(**{c: row[c] for c in columns})
