"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Method. The features of a text are the character n-grams (bytes of the lower-cased text, three to seven long, a space at
both ends) that it holds at least once. For each, the log ratio of its smoothed document counts among toxic and other
labelled texts is taken; the features of largest chi-square stay, and logistic regression is fitted on their presence
times that ratio. An n-gram is known by 64 bits, its bytes and its length, so none is taken for another. Scoring looks
all n-grams of the whole text up in one table of buckets, and compares those that may be features.

The fit reads at most ``max_fit_rows`` labelled documents, chosen by a hash of their ids, and counts their n-grams in
Spark; everything else is fixed in size (``n_features`` features and at most two for each document of the fit).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import carried, slices, written

ORDERS = (3, 4, 5, 6, 7)
BUCKET_BITS = 18
MAX_FIT_ROWS = 20_000
N_FEATURES = 4096
THRESHOLD = 0.3
SCORE_ROWS = 256


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: remainder 2 of the CRC-32 of the id as text, modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _spread(gram: np.ndarray) -> np.ndarray:
    """Bucket of each n-gram."""
    return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Features:
    """The chosen n-grams in ascending order, and which buckets hold one."""

    grams: np.ndarray
    held: np.ndarray

    @staticmethod
    def of(grams: np.ndarray) -> Features:
        held = np.zeros(1 << BUCKET_BITS, bool)
        held[_spread(grams)] = True
        return Features(grams, held)

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``gram`` that are a feature, and which."""
        at = np.flatnonzero(self.held[_spread(gram)])
        feature = np.minimum(np.searchsorted(self.grams, gram[at]), max(0, len(self.grams) - 1))
        same = self.grams[feature] == gram[at] if len(at) else np.zeros(0, bool)
        return at[same], feature[same]


def _named(texts: list[str | None], features: Features | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, (text, n-gram) at every place of the texts, or (text, feature) of those among ``features``."""
    raw = [b" " + (t or "").lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    gram = data.astype(np.uint64)
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            break
        gram = (gram[: len(data) - n + 1] << np.uint64(8)) | data[n - 1 :]
        if n not in ORDERS:
            continue
        named = gram | np.uint64(n << 56)  # seven bytes and the length fill 64 bits
        at, found = (np.arange(len(named)), named) if features is None else features.find(named)
        text = np.searchsorted(ends, at, side="right").astype(np.int32)
        inside = at + n <= ends[text] if len(at) else np.zeros(0, bool)
        yield text[inside], found[inside]


def _distinct(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, n-gram) once per text, ascending by n-gram; one pair of arrays for each length, which bounds what is in memory."""
    for text, gram in _named(texts):
        order = np.argsort(gram, kind="stable")  # places ascend by text
        text, gram = text[order], gram[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
        yield text[new], gram[new]


def _grams(texts: list[str | None], features: Features) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every n-gram among ``features``, once per text and ascending by text."""
    both = np.unique(np.concatenate([np.zeros(0, np.int64)] + [(text.astype(np.int64) << 32) | found for text, found in _named(texts, features)]))
    return both >> 32, both & 0xFFFFFFFF


@dataclass(frozen=True)
class ToxicityModel:
    features: Features
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        text, feature = _grams(texts, self.features)
        total = self.bias + np.bincount(text, weights=self.weights[feature], minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -500, 500)))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, max_rows: int) -> DataFrame:
    """``_text, _y`` of at most ``max_rows`` labelled ids that may be learned from; an id with several labels counts as toxic if one says so."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    # the broadcast side has max_rows rows of two numbers at most
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_text", "_y")


def most_telling(scored: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of largest ``chi``, ties by ``gram``, of a written table.

    First the values are counted in steps of a sixteenth of their magnitude, a thousand rows or so; then only the rows from
    the step on that holds the last one wanted are sorted, however many partitions there are.
    """
    step = F.floor(F.log2(F.greatest(F.col("chi"), F.lit(1e-12))) * 16)
    above, bound = 0, None
    for row in sorted(scored.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):
        bound, above = row["step"], above + row["n"]
        if above >= most:
            break
    return scored.where(step >= bound if bound is not None else F.lit(False)).orderBy(F.desc("chi"), "gram").limit(most)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", max_fit_rows: int = MAX_FIT_ROWS, n_features: int = N_FEATURES) -> ToxicityModel:
    sample = written(labelled_sample(docs, labels, id_col, text, max_fit_rows).repartition(8, "_id"))
    labelled = sample.select("_text", F.when(F.col("_y") > 0, 1).otherwise(0).alias("_y"))

    def counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts, ys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, 500_000):
                toxic_text = np.array(ys[a:b]) == 1
                for who, gram in _distinct(texts[a:b]):
                    if not len(gram):
                        continue
                    edges = np.concatenate([[0], np.flatnonzero(gram[1:] != gram[:-1]) + 1])
                    toxic = np.add.reduceat(toxic_text[who].astype(np.int32), edges)
                    other = np.diff(np.append(edges, len(gram))).astype(np.int32) - toxic
                    yield pa.RecordBatch.from_arrays([pa.array(gram[edges].view(np.int64)), pa.array(other, pa.int32()), pa.array(toxic, pa.int32())], names=["gram", "other", "toxic"])

    n_of = {r["_y"]: r["n"] for r in labelled.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = np.array([n_of.get(0, 0), n_of.get(1, 0)], np.float64)
    if not rows.all():  # nothing to tell apart: the share of toxic labels, zero without labels
        share = float(rows[1] / rows.sum()) if rows.sum() else 0.0
        return ToxicityModel(Features.of(np.zeros(0, np.uint64)), np.zeros(1), float(np.log(share / (1 - share))) if 0 < share < 1 else (-500.0 if share == 0 else 500.0))
    n = float(rows.sum())
    summed = labelled.mapInArrow(counts, "gram long, other int, toxic int").groupBy("gram").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    total = F.col("other") + F.col("toxic")
    expected = total * float(rows[1] / n)
    spread = expected * float(1 - rows[1] / n) * (F.lit(1.0) - total / n) + 1e-9
    chi = (F.col("toxic") - expected) * (F.col("toxic") - expected) / F.greatest(spread, F.lit(0.25))
    # more features than two per document would be learned by heart
    kept = most_telling(written(summed.select("gram", "other", "toxic", chi.alias("chi"))), min(n_features, int(2 * n))).toArrow()
    grams = kept.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(grams)
    features = Features.of(grams[order])
    other, toxic = (kept.column(c).to_numpy()[order].astype(np.float64) for c in ("other", "toxic"))
    ratio = np.log((toxic + 1) / (rows[1] + 2)) - np.log((other + 1) / (rows[0] + 2))

    def presence(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids, texts, ys = (batch.column(i).to_pylist() for i in range(3))
            for a, b in slices(texts, 2_000_000):
                who, feature = _grams(texts[a:b], features)
                cuts = np.searchsorted(who, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(ys[a:b], pa.int32()),
                    pa.array([feature[i:j].astype("<u2").tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["id", "y", "features"])

    fitted = sample.select("_id", "_text", F.when(F.col("_y") > 0, 1).otherwise(0).alias("_y")).mapInArrow(presence, "id long, y int, features binary") \
        .orderBy("id", "features").limit(max_fit_rows).toArrow()
    lists = [np.frombuffer(x, "<u2").astype(np.int64) for x in fitted.column("features").to_pylist()]
    y = fitted.column("y").to_numpy().astype(np.float64)
    weights, bias = _logistic(lists, y, ratio)
    return ToxicityModel(features, weights * ratio, bias)


def _logistic(lists: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.02, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over mini-batches in a fixed order; the start is the naive Bayes direction, damped."""
    w, bias = np.full(len(ratio), 0.05), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    random, step = np.random.default_rng(0), 0
    for epoch in range(epochs):
        order = random.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            sizes = np.array([len(lists[i]) for i in rows])
            feature = np.concatenate([lists[i] for i in rows])
            line = np.repeat(np.arange(len(rows)), sizes)
            logit = bias + np.bincount(line, weights=w[feature] * ratio[feature], minlength=len(rows))
            error = 1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y[rows]
            gradient = np.append(np.bincount(feature, weights=error[line], minlength=len(w)) * ratio / len(rows) + penalty * w, error.mean())
            step += 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            move = rate * (0.5 ** (epoch / 4)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def scored_parts(batch: pa.RecordBatch, text: int, model: ToxicityModel) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """The columns of a batch but its texts, and scores, a few rows at a time: carried texts of a whole batch are not copied at once."""
    for start in range(0, batch.num_rows, SCORE_ROWS):
        part = batch.slice(start, SCORE_ROWS)
        texts = part.column(text).to_pylist()
        scores = [model.scores(texts[a:b]) for a, b in slices(texts, 250_000)]
        yield [c for i, c in enumerate(part.columns) if i != text], np.concatenate(scores)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, held_out``, carried columns, ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on).

    Only the text is an input of the score. Null is read as the empty text and scored; a null id is not held out.
    Repeated rows are scored each by itself. A carried column named like a result is dropped.
    """
    extra = carried(docs, carry, ("doc_id", "held_out", "score", "predicted"))
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), held_out(id_col).alias("_held"), F.col(text).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(extra)])
    schema = slim.drop("_text").withColumn("_score", F.lit(0.0)).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for columns, scores in scored_parts(batch, 2, model):
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], names=schema.names)

    out = slim.mapInArrow(run, schema)
    return out.select(F.col("_id").alias("doc_id"), F.col("_held").alias("held_out"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(extra)],
                      F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
