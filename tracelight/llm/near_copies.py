"""Near copies by a similarity bound: SimHash fingerprints in Gray order inside MinHash bands, links by the sets themselves.

Documents are sets of word shingles (five words). Three steps name the links:

1. Bands. A document is entered in BANDS buckets, one for each group of ROWS minima of its set. Two sets of similarity 0.8
   share a bucket with 0.997, closer ones almost surely, whatever the number of documents; so every document costs the
   same number of narrow rows at every size, and no text moves.
2. Gray order. In a bucket the entries are sorted by the Gray rank of their 64-bit SimHash, and the hierarchical index of
   ``simhash.GrayIndex`` drops whole groups whose shared bits differ too much from a query's. A bucket beyond ``HOT_ROWS`` is
   first split by sampled fingerprint bits, into as many tables as such a pair needs to meet in one with 0.99, if its
   bits differ by up to two standard deviations more than expected.
3. Sets. What is left is linked if the sets have at least the wanted similarity, exactly. The sets lie in byte files,
   written while the bands are made, and only those of candidates are read.

Links become components over all buckets. Tables and files of the steps are deleted before the result is returned; what
stays is one narrow table of decisions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import Scratch, byte_words, file_system, mixed, written
from tracelight.llm.components import connected_components
from tracelight.llm.simhash import GrayIndex, gray_rank
from tracelight.llm.token_files import TaskFile

BANDS, ROWS = 25, 7
HOT_ROWS = 1 << 14
SAMPLINGS = 4
BATCH_ROWS = 30_000


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Ascending hashes of the distinct word shingles of a text (A-Z lower-cased); a shorter text is one shingle, none without words."""
    words = byte_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words).lower()
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], dtype=np.uint64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash of a shingle set; zero of the empty one."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[a : a + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def band_keys(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """BANDS bucket keys of a set: each hashes the ROWS minima of its band under random multiply-add functions."""
    least = np.full(len(factors), ~np.uint64(0))
    for a in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[a : a + 2048, None] * factors + shifts).min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two ascending sets; two empty ones are equal."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0 if len(b) else 1.0
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


class SetReader:
    """Shingle sets from task files; the sets read last are kept up to ``most`` bytes."""

    def __init__(self, folder: str, most: int = 64_000_000):
        self.fs, _ = file_system(folder)
        self.most, self.size, self.kept, self.open = most, 0, {}, {}

    def read(self, path: str, start: int, length: int) -> np.ndarray:
        key = (path, start)
        if key in self.kept:
            found = self.kept.pop(key)
        else:
            if path not in self.open:
                if len(self.open) >= 64:
                    self.open.pop(next(iter(self.open))).close()
                self.open[path] = self.fs.open_input_file(path)
            found = np.frombuffer(self.open[path].read_at(8 * length, start), "<u8")
            self.size += found.nbytes
            while self.kept and self.size > self.most:
                self.size -= self.kept.pop(next(iter(self.kept))).nbytes
        self.kept[key] = found
        return found


def bit_rate(similarity: float) -> float:
    """Share of differing SimHash bits of two equally large sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _measured(rows: DataFrame, shingle: int, folder: str) -> DataFrame:
    """``row, id, hash, node, code, bands, file, start, n`` of ``rows(row, id, hash, t)``; the sets go to byte files."""
    random = np.random.default_rng(11)
    factors = random.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = TaskFile(folder)
        for batch in parts:
            for a in range(0, batch.num_rows, 1000):
                some = batch.slice(a, 1000)
                nodes, codes, bands, starts, sizes = [], [], [], [], []
                for t in some.column(3):
                    hashes = shingle_set(t.as_py(), shingle)
                    data = hashes.astype("<u8").tobytes()
                    starts.append(out.size)
                    out.write(data)
                    nodes.append(xxhash.xxh64_intdigest(data))
                    codes.append(set_fingerprint(hashes))
                    bands.append(band_keys(hashes, factors, shifts).view(np.int64) if len(hashes) else np.zeros(0, np.int64))
                    sizes.append(len(hashes))
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*some.columns[:3], signed(nodes), signed(codes), pa.array(bands, pa.list_(pa.int64())), pa.array([out.path] * len(nodes), pa.string()),
                                                  pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["row", "id", "hash", "node", "code", "bands", "file", "start", "n"])
        out.close()

    return rows.mapInArrow(run, "row long, id long, hash long, node long, code long, bands array<long>, file string, start long, n long")


def _split_hot(entries: DataFrame, scratch: Scratch, rate: float, hot_rows: int) -> DataFrame:
    """``entries`` with the buckets beyond ``hot_rows`` cut up by sampled bits of the fingerprint, in several tables each."""
    hot = scratch.table(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot_rows))
    most = hot.agg(F.max("rows")).first()[0]
    if most is None:
        return entries
    random = np.random.default_rng(17)
    deepest = max(1, math.ceil(math.log2(most / hot_rows)) + 1)
    wide = rate + 2 * math.sqrt(rate * (1 - rate) / 64)
    tables = {k: math.ceil(math.log(0.01) / math.log(1 - (1 - wide) ** k)) for k in range(1, deepest + 1)}
    # buckets sample unlike bits, so a pair that shares several buckets has as many chances
    samples = [[random.permutation(64).tolist() for _ in range(max(tables.values()))] for _ in range(SAMPLINGS)]
    bit = lambda place: F.shiftrightunsigned("code", place).bitwiseAND(F.lit(1).cast("long"))
    level = F.greatest(F.lit(1), F.ceil(F.log2(F.col("rows") / hot_rows)) + 1).cast("int")
    marked = entries.join(hot, "bucket", "left").withColumn("k", F.when(F.col("rows").isNotNull(), level))
    cuts, kind = F.when(F.lit(False), F.array("bucket")), F.pmod("bucket", F.lit(SAMPLINGS))
    for k, count in tables.items():
        for s, sampled in enumerate(samples):
            keys = F.array(*[F.xxhash64("bucket", F.lit(t), *[bit(p) for p in sampled[t][:k]]) for t in range(count)])
            cuts = cuts.when((F.col("k") == k) & (kind == s), keys)
    return marked.withColumn("bucket", F.explode(cuts.otherwise(F.array("bucket")))).drop("rows", "k")


def _links(entries: DataFrame, folder: str, files: list[str], similarity: float, rate: float) -> DataFrame:
    """``u, v``: links of at least ``similarity`` that hang together what hangs together in some bucket."""
    near = round(64 * rate + 4 * math.sqrt(64 * rate * (1 - rate)))  # a bound that hardly any such pair exceeds

    def links(reader: SetReader, keys: np.ndarray, codes: np.ndarray, nodes: np.ndarray, file: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(keys)) + 1
        sizes = np.diff(np.concatenate([[0], edges, [len(keys)]]))
        first = np.repeat(np.concatenate([[0], edges]), sizes)
        up = list(range(len(keys)))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        def check(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Pairs whose sets are similar enough; those that hang together already are let pass unread."""
            ok = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-6
            for p in np.flatnonzero(ok).tolist():
                i, j = int(a[p]), int(b[p])
                x, y = top(i), top(j)
                if x != y:
                    ok[p] = nodes[i] == nodes[j] or jaccard(*(reader.read(files[file[e]], int(start[e]), int(size[e])) for e in (i, j))) >= similarity
                    if ok[p]:
                        up[max(x, y)] = min(x, y)
            return ok

        label = GrayIndex(codes.view(np.uint64), first, first + np.repeat(sizes, sizes)).connect(near, check=check)
        member = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[member]), pa.array(nodes[label[member]])], names=["u", "v"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = SetReader(folder)
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in parts:
            new = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            at = 0
            if rows + len(new[0]) > BATCH_ROWS:
                # up to the last bucket that is whole; a bucket that goes on is joined once, when it ends
                borders = np.flatnonzero(np.diff(new[0])) + 1
                if held and held[-1][0][-1] != new[0][0]:
                    borders = np.append(0, borders)
                if len(borders):
                    at = int(borders[-1])
                    whole = [*held, tuple(c[:at] for c in new)]
                    if sum(len(h[0]) for h in whole):
                        yield links(reader, *(np.concatenate(c) for c in zip(*whole)))
                    held, rows = [], 0
            if at < len(new[0]):
                held.append(tuple(c[at:] for c in new))
                rows += len(new[0]) - at
        if held:
            yield links(reader, *(np.concatenate(c) for c in zip(*held)))

    rank = gray_rank(F.col("code")).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    ordered = entries.repartition("bucket").sortWithinPartitions("bucket", rank)
    return ordered.select("bucket", "code", "node", "file", "start", "n").mapInArrow(run, "u long, v long")


def _grouped(rows: DataFrame, shingle: int, similarity: float, hot_rows: int) -> DataFrame:
    """``row, id, component_id, first`` of ``rows(row, id, hash, t)``: the smallest id of a row's group, and whether it is the row to keep.

    A node is a distinct set of shingles, not an id, so equal and null ids join nothing.
    """
    spark = rows.sparkSession
    rate = bit_rate(similarity)
    with Scratch(spark) as scratch:
        measured = scratch.table(_measured(rows, shingle, scratch.folder()))
        low = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.coalesce("hash", F.lit(0).cast("long")).alias("hash"), F.col("row").alias("row"))
        distinct = scratch.table(measured.groupBy("node").agg(F.min(low).alias("low"), F.min(F.struct("file", "start", "n", "code")).alias("s"), F.any_value("bands").alias("bands"))
                                 .select("node", "low", "s.*", "bands"))
        # one name per task
        files = [r["file"] for r in distinct.select("file").distinct().orderBy("file").collect()]
        number = scratch.table(spark.createDataFrame(list(enumerate(files)), "no int, file string"))
        slim = distinct.join(number, "file").select("node", "code", "start", "n", F.col("no").alias("file"), "bands")
        entries = slim.select("node", "code", "file", "start", "n", F.explode("bands").alias("bucket"))
        edges = _links(_split_hot(entries, scratch, rate, hot_rows), scratch.folder(), files, similarity, rate)
        roots = scratch.table(connected_components(edges, table=scratch.table))
        rooted = scratch.table(distinct.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")))
        lows = scratch.table(rooted.groupBy("root").agg(F.min("low").alias("low")))
        named = scratch.table(rooted.select("node", "root").join(lows, "root").select("node", F.col("low.id").alias("component_id"), F.col("low.row").alias("kept")))
        return written(measured.select("row", "id", "node").join(named, "node").select("row", "id", "component_id", (F.col("row") == F.col("kept")).alias("first")))


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("t"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``doc_id, component_id`` of every document with an id: documents of at least this Jaccard similarity hang together.

    ``component_id`` is the smallest id of the group. Texts without words, null ones too, are one group. No link is below the
    bound; a pair of exactly 0.8 is found with 0.997 (about 0.99 where all its buckets are hot), closer pairs almost surely. Repeated rows
    stay, an empty table gives no rows.
    """
    groups = _grouped(_rows(docs, id_col, text), shingle, similarity, hot_rows)
    return groups.where(F.col("id").isNotNull()).select(F.col("id").alias("doc_id"), "component_id")


def first_of_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, fixed: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row of ``docs`` for each group of ``similar_documents``: the smallest id, null ids last; among equal ids the smallest hash of the text, then any one row.

    ``fixed``: ``docs`` is read from files as it stands, so its rows come in one order each time; otherwise it is written
    first. Columns may have any names.
    """
    plain = docs if fixed else written(docs)
    renamed = plain.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    kept = _grouped(_rows(renamed, at[id_col], at[text]), shingle, similarity, hot_rows).where("first").select("row")
    numbered = renamed.withColumn("row", F.monotonically_increasing_id())
    return numbered.join(kept, "row", "left_semi").select(*at.values()).toDF(*docs.columns)
