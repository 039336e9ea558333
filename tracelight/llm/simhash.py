"""SimHash near-duplicates over a Gray-order hierarchical index.

Method. Equal fingerprints are one entry. Two fingerprints with three differing bits or fewer agree on at least one of
four 16-bit blocks, so every distinct fingerprint goes, rotated, to four buckets; a large bucket is split again by the
same argument on its remaining 48 bits. Inside a partition the entries are sorted by Gray rank, and runs of eight form
nodes, eight nodes an upper node, and so on. A node holds the bits on which all its members agree, without those that
its upper node holds already. A query adds up its differences from the root down and drops a whole group as soon as
they exceed the bound, and also a group whose members are all known to hang together with it. Links found in a
partition are kept as one link per member to the smallest member, and components are joined over all partitions.

``near_copies`` serves a similarity bound instead of a bit bound with the same index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import byte_words, carried, written
from tracelight.llm.components import connected_components

MAX_BITS = 3
BLOCKS, BLOCK_BITS = 4, 16
SUB_BLOCKS, SUB_BITS = 4, 12
FAN = 8


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles (A-Z lower-cased, repeats counted); 0 without words."""
    words = byte_words(text)
    if not words:
        return 0
    words = b" ".join(words).lower().split(b" ")
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 65536):
        ones += np.unpackbits(hashes[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str, shingle: int, seed: int) -> DataFrame:
    """``docs`` with ``_fp`` (the 64 bits as a signed long) in the place of the text."""
    kept = [f for f in docs.schema.fields if f.name != text]
    at = docs.columns.index(text)
    out = docs.drop(text).withColumn("_fp", F.lit(0).cast("long")).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            prints = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(at)], dtype=np.uint64).view(np.int64)
            columns = [c for i, c in enumerate(batch.columns) if i != at] + [pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["_fp"])

    return docs.mapInArrow(run, out)


class GrayIndex:
    """Entries sorted by bucket and Gray rank, with nodes over runs of FAN entries on each level."""

    def __init__(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray):
        """``codes``: sorted; ``first``, ``last``: the range of each entry's bucket."""
        self.codes, self.first, self.last = codes.astype(np.uint64), first, last
        self.component = np.arange(len(codes))
        self.patterns, self.shared = [self.codes], [np.full(len(codes), ~np.uint64(0))]
        ones, any_ = self.codes, self.codes
        while len(ones) > FAN:
            ones = np.bitwise_and.reduceat(ones, np.arange(0, len(ones), FAN))
            any_ = np.bitwise_or.reduceat(any_, np.arange(0, len(any_), FAN))
            self.patterns.append(ones)
            self.shared.append(~(ones ^ any_))
        # each level keeps only the bits that its upper level has not
        self.own = [m & ~np.repeat(up, FAN)[: len(m)] for m, up in zip(self.shared, self.shared[1:])] + [self.shared[-1]]

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.component
        while True:
            low = np.minimum(label[a], label[b])
            if (label[a] == low).all() and (label[b] == low).all():
                return
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while not np.array_equal(label, label[label]):
                label = label[label]
            self.component = label

    def connect(self, most: int, chunk: int = 2048, check: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """Component of each entry, named by its first entry: all links of at most ``most`` bits inside a bucket are followed.

        ``check`` may refuse pairs of entries that the codes let pass.
        """
        n = len(self.codes)
        for step in (1, 2):  # neighbours in Gray order first: dense groups hang together at once
            a = np.arange(n - step) if n > step else np.zeros(0, np.int64)
            a = a[(a + step < self.last[a]) & (np.bitwise_count(self.codes[a] ^ self.codes[a + step]) <= most)] if len(a) else a
            if check is not None:
                a = a[check(a, a + step)]
            self._join(a, a + step)
        top = len(self.patterns) - 1
        width = FAN**top
        for begin in range(0, n, chunk):
            query = np.arange(begin, min(n, begin + chunk))
            query = query[query + 1 < self.last[query]]
            if not len(query):
                continue
            uniform = self._uniform()
            low, high = (query + 1) // width, (self.last[query] - 1) // width
            spread = high - low + 1
            who = np.repeat(query, spread)
            node = np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high)]) if spread.max() > 1 else low
            gone = np.zeros(len(who), np.int64)
            for level in range(top, -1, -1):
                gone = gone + np.bitwise_count((self.codes[who] ^ self.patterns[level][node]) & self.own[level][node])
                keep = (gone <= most) & (uniform[level][node] != self.component[who])
                who, node, gone = who[keep], node[keep], gone[keep]
                if not level or not len(who):
                    break
                below, size = FAN ** (level - 1), len(self.patterns[level - 1])
                who, gone = np.repeat(who, FAN), np.repeat(gone, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = (node < size) & ((node + 1) * below > who + 1) & (node * below < self.last[who])
                who, node, gone = who[inside], node[inside], gone[inside]
            for at in range(0, len(who), 1 << 20):
                a, b = who[at : at + (1 << 20)], node[at : at + (1 << 20)]
                if check is not None:
                    a, b = a[keep := check(a, b)], b[keep]
                self._join(a, b)
        return self.component

    def _uniform(self) -> list[np.ndarray]:
        """Per level, the component that all members of a node share, else -1."""
        out = [self.component]
        for _ in self.patterns[1:]:
            edges = np.arange(0, len(out[-1]), FAN)
            low, high = np.minimum.reduceat(out[-1], edges), np.maximum.reduceat(out[-1], edges)
            out.append(np.where(low == high, low, -1))
        return out


def gray_rank(code: Column) -> Column:
    """Place of a 64-bit code in the reflected binary order."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code


def _rotated(code: Column, by: int) -> Column:
    return code if not by else F.shiftleft(code, by).bitwiseOR(F.shiftrightunsigned(code, 64 - by))


def fingerprint_links(distinct: DataFrame, most: int = MAX_BITS, bucket_rows: int = 2048) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints ``_fp`` that lose no connection by links of at most ``most`` (<= 3) bits.

    A bucket beyond ``bucket_rows`` is split into sub-blocks of its remaining bits; every entry goes to all of them, so
    no link is lost.
    """
    if not 0 <= most < BLOCKS:
        raise ValueError("the blocks hold links of at most three bits")
    entries = distinct.select("_fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), _rotated(F.col("_fp"), BLOCK_BITS * t).alias("code")) for t in range(BLOCKS)])).alias("e"))
    entries = entries.select(F.col("e.code").alias("code"), F.col("e.t").alias("t"),
                             F.shiftrightunsigned(F.col("e.code"), 48).bitwiseOR(F.shiftleft(F.col("e.t").cast("long"), 16)).alias("bucket"))
    large = written(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows).select("bucket", F.lit(True).alias("split")))
    sub = lambda j: F.shiftrightunsigned(F.col("code"), SUB_BITS * j).bitwiseAND(F.lit((1 << SUB_BITS) - 1)) \
        .bitwiseOR(F.lit((j + 1) << SUB_BITS).cast("long"))
    marked = entries.join(large, "bucket", "left").withColumn(
        "sub", F.explode(F.when(F.col("split"), F.array(*[sub(j) for j in range(SUB_BLOCKS)])).otherwise(F.array(F.lit(0).cast("long")))))
    keyed = marked.select(F.shiftleft("bucket", 20).bitwiseOR(F.col("sub")).alias("key"), "t", "code",
                          gray_rank(F.col("code")).bitwiseXOR(F.lit(-(1 << 63)).cast("long")).alias("rank"))
    ordered = keyed.repartition("key").sortWithinPartitions("key", "rank")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def links(keys: np.ndarray, turns: np.ndarray, codes: np.ndarray) -> pa.RecordBatch | None:
            codes = codes.view(np.uint64)
            edges = np.flatnonzero(np.diff(keys)) + 1
            sizes = np.diff(np.concatenate([[0], edges, [len(keys)]]))
            first = np.repeat(np.concatenate([[0], edges]), sizes)
            found = GrayIndex(codes, first, first + np.repeat(sizes, sizes)).connect(most)
            member = np.flatnonzero(found != np.arange(len(found)))
            by = (turns[member].astype(np.uint64) * np.uint64(BLOCK_BITS))
            back = lambda x: np.where(by > 0, (x >> by) | (x << ((np.uint64(64) - by) % np.uint64(64))), x).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(back(codes[member])), pa.array(back(codes[found[member]]))], names=["u", "v"])

        for batch in parts:
            new = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if held and sum(len(h[0]) for h in held) + len(new[0]) > 50_000:
                keys, turns, codes = (np.concatenate(c) for c in zip(*held))
                whole = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
                if keys[-1] != new[0][0]:
                    whole = len(keys)
                if whole:
                    yield links(keys[:whole], turns[:whole], codes[:whole])
                held = [(keys[whole:], turns[whole:], codes[whole:])] if whole < len(keys) else []
            held.append(new)
        if held:
            yield links(*(np.concatenate(c) for c in zip(*held)))

    return ordered.select("key", "t", "code").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, most: int = MAX_BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id`` and the carried columns.

    ``fingerprint`` is 16 lower-case hex digits; documents whose fingerprints differ in at most ``most`` bits are linked,
    and ``component_id`` is the smallest id that links reach, the document's own included. Texts without words (null and
    empty too) have fingerprint zero and are linked like any other. A null id takes no part in the smallest id; a group
    of null ids alone has a null component. Repeated rows stay. A carried column named like a result is dropped.
    """
    extra = carried(docs, carry, ("doc_id", "fingerprint", "component_id", text))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(extra)])
    prints = written(fingerprints(slim, "_text", shingle, seed))
    distinct = written(prints.groupBy("_fp").agg(F.min("doc_id").alias("low")))
    roots = written(connected_components(fingerprint_links(distinct, most)))
    rooted = written(distinct.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", "low", F.coalesce("root", "_fp").alias("root")))
    lows = written(rooted.groupBy("root").agg(F.min("low").alias("component_id")))
    named = written(rooted.join(lows, "root").select("_fp", "component_id"))
    return prints.join(named, "_fp").select("doc_id", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(extra)],
                                            F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")
