"""Nearest neighbours by a hash-prefix forest: a sorted array of hash strings per tree, searched by longest prefixes.

Method. Each tree gives every vector a 63-bit string: the signs of its products with orthonormal random directions. A tree
is the sorted array of its strings. A query descends in each tree to the place of its own string, where the rows stand that
share its longest prefixes, and then ascends in all trees together: the prefix that counts becomes shorter and admits the
rows next to those that are in, as many to each side in each tree, until every tree has given ``reach`` rows to a side. In
each tree these are one interval of the sorted array. The rows of the intervals, and no others, are scored with the exact
inner product of the original vectors.

How far a recall reaches depends on the data: a few rows where vectors form groups, a fixed share of all rows where they
have no structure. So the search is fitted: for FIT_QUERIES queries the true neighbours are found by one pass over all
rows, and ``reach`` is what finds the share ``target`` of them. Also fitted, on FIT_ROWS rows, are the cuts of the sorted
arrays and the sketch of each array on which a query counts its steps. Every row is indexed, and the measured recall of the
whole search is in the README.

On Spark. Inner products are made angles by one more dimension that lifts all rows to the norm of the longest. Equal vectors
are one entry, which keeps its 21 smallest ids: no result needs more. Tree rows hold tree, string and the entry's place, no
vectors. A query goes, as two strings, to the pieces of the arrays that its intervals touch; what they offer comes back as
short numbers, one list for each piece; the lists of all trees are united by block of entries and go, with the query's
vector, to the blocks, where they are scored. Blocks follow the order of the first tree, so near rows lie together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelight.llm.common import Scratch, written

TREES = 40
STRING_BITS = 63
BLOCK_ROWS = 4096
HELD_PLACES = 1 << 22  # places that a task gathers before it passes them on
FIT_ROWS, FIT_QUERIES, TARGET = 1 << 14, 128, 0.93
_LAST = (1 << 63) - 1


def directions(dims: int, trees: int, seed: int = 7) -> np.ndarray:
    """``trees`` x STRING_BITS x ``dims`` directions, orthonormal inside a tree as far as the dimensions go."""
    random = np.random.default_rng(seed)
    out = np.empty((trees, STRING_BITS, dims))
    for tree in range(trees):
        rows: list[np.ndarray] = []
        while sum(map(len, rows)) < STRING_BITS:
            q, _ = np.linalg.qr(random.normal(size=(dims, dims)))
            rows.append(q.T)
        out[tree] = np.concatenate(rows)[:STRING_BITS]
    return out


def strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash strings as integers, first sign highest: rows x trees."""
    weights = np.int64(1) << np.arange(STRING_BITS - 1, -1, -1, dtype=np.int64)
    out = np.empty((len(vectors), len(planes)), np.int64)
    for tree, plane in enumerate(planes):
        out[:, tree] = (vectors @ plane.T > 0) @ weights
    return out


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part: an id, and a finite, non-zero vector without nulls, of the most frequent length."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v")).where("vec_id is not null and v is not null")
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(sound)
    top = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == (top["d"] if top else 0))


def _array(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Forest:
    """What was fitted: the sketch of each tree (ascending strings of sampled rows, each standing for as many rows), and the cuts."""

    planes: np.ndarray
    longest: float
    rows: int
    sketch: np.ndarray  # trees x sampled rows
    cuts: np.ndarray  # trees x (pieces - 1)

    def codes(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        """Strings of entries (``lifted``) or of queries: rows x trees."""
        lift = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0.0)) if lifted else np.zeros(len(x))
        return strings(np.column_stack([x, lift]), self.planes)

    def steps(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How many steps of the sketch a query must reach, in the tree that needs fewest, to offer each row: ``own`` queries x trees, ``codes`` queries x rows x trees."""
        need = np.full(codes.shape[:2], self.sketch.shape[1] + 1)
        for tree, sketch in enumerate(self.sketch):
            place = np.searchsorted(sketch, own[:, tree], "left")[:, None]
            low, high = np.searchsorted(sketch, codes[:, :, tree], "left"), np.searchsorted(sketch, codes[:, :, tree], "right")
            need = np.minimum(need, np.maximum(np.maximum(place - high + 1, low - place + 1), 1))
        return need

    def intervals(self, own: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last string of each query's interval in each tree: ``steps`` steps of the sketch to each side."""
        low, high = np.zeros_like(own), np.full_like(own, _LAST)
        for tree, sketch in enumerate(self.sketch):
            place = np.searchsorted(sketch, own[:, tree], "left")
            inside = place >= steps
            low[inside, tree] = sketch[place[inside] - steps]
            inside = place + steps <= len(sketch)
            high[inside, tree] = sketch[place[inside] + steps - 1]
        return low, high

    def piece(self, tree: int, code: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Piece of a tree's array for each string. Where a string repeats as a cut it is a hot one: its rows are dealt over the pieces between."""
        low, high = np.searchsorted(self.cuts[tree], code, "left"), np.searchsorted(self.cuts[tree], code, "right")
        return low + place % (high - low + 1)

    def pieces(self, tree: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last piece that strings from ``low`` to ``high`` can lie in."""
        return np.searchsorted(self.cuts[tree], low, "left"), np.searchsorted(self.cuts[tree], high, "right")


def _fitted(entries: DataFrame, n: int, longest: float, trees: int, seed: int, block_rows: int) -> Forest:
    """Sketches and cuts from at most FIT_ROWS entries, those of least ``rep``, which is a hash."""
    share = min(1.0, FIT_ROWS / n)
    least = int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1
    rows = entries.where(F.col("rep") <= least).select("v").limit(2 * FIT_ROWS).collect()  # about FIT_ROWS vectors
    x = np.array([r["v"] for r in rows], np.float64)
    planes = directions(x.shape[1] + 1, trees, seed)
    plain = Forest(planes, longest, n, np.zeros((trees, 0), np.int64), np.zeros((trees, 0), np.int64))
    sketch = np.sort(plain.codes(x, True).T, axis=1)
    pieces = min(len(rows), max(1, -(-n // block_rows)))
    at = np.arange(1, pieces) * sketch.shape[1] // pieces
    return Forest(planes, longest, n, sketch, sketch[:, at])


def _calibrated(entries: DataFrame, forest: Forest, k: int, target: float) -> int:
    """Steps of the sketch that find ``target`` of the true neighbours of FIT_QUERIES queries, those of least ``rep``; one pass over all rows."""
    asked = entries.where("asks").orderBy("rep").limit(FIT_QUERIES).select("rep", "v").collect()
    reps, q = np.array([r["rep"] for r in asked]), np.array([r["v"] for r in asked], np.float64)
    own = forest.codes(q, False)

    def best(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, depth = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for batch in parts:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                x = _array(some.column(1)).astype(np.float64)
                s = np.where(some.column(0).to_numpy()[None, :] == reps[:, None], -np.inf, q @ x.T)
                here = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                codes = forest.codes(x, True)
                deep = forest.steps(own, codes[here])
                score, depth = np.concatenate([score, np.take_along_axis(s, here, 1)], 1), np.concatenate([depth, deep], 1)
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                score, depth = np.take_along_axis(score, top, 1), np.take_along_axis(depth, top, 1)
        if score.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), score.shape[1])), pa.array(score.ravel()), pa.array(depth.ravel())], names=["q", "score", "depth"])

    found = entries.select("rep", "v").mapInArrow(best, "q long, score double, depth long")
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))
    rows = found.where("score > double('-inf')").withColumn("place", place).where(F.col("place") <= k).select("depth").collect()  # FIT_QUERIES x k rows
    return int(np.quantile([r["depth"] for r in rows], target, method="higher")) if rows else 1


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, trees: int = TREES, reach: int | None = None,
            target: float = TARGET, block_rows: int = BLOCK_ROWS, seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for each row whose id is divisible by ``every``.

    Nearest is the largest inner product in double precision, ties go to the smaller id, and a query is not its own
    neighbour. Rows without an id, and vectors that are null, empty, zero, of another length than most, or hold null or
    non-finite components, take no part. Of rows with equal ids and equal vectors one takes part; equal ids with
    different vectors are different entries. Other columns are not read. An empty table gives no rows. ``reach``: rows that
    a tree offers a query on each side; by default fitted to the recall ``target``.
    """
    spark = vectors.sparkSession
    schema, most = "query_id long, rank int, vec_id long, score double", k + 1
    with Scratch(spark) as scratch:
        rows = scratch.table(usable(vectors, id_col, vector).dropDuplicates(["vec_id", "v"]).withColumn("h", F.xxhash64("v")))
        # row_number() <= n keeps n rows of a group in each task before they are shuffled
        place = F.row_number().over(W.partitionBy("h", "v").orderBy("vec_id"))
        groups = rows.withColumn("place", place).where(F.col("place") <= most).groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        asked = rows.where(F.col("vec_id") % every == 0).select("h", "v").distinct().withColumn("asks", F.lit(True))
        # the hash of its vector names an entry
        groups = groups.join(asked, ["h", "v"], "left").select(F.col("h").alias("rep"), "ids", "v", F.coalesce("asks", F.lit(False)).alias("asks"))
        entries = scratch.table(groups)
        norm2 = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        n, queries, longest = entries.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(norm2(F.col("v")))).first()
        if not queries:
            return spark.createDataFrame([], schema)
        forest = _fitted(entries, n, longest**0.5, trees, seed, block_rows)
        per_step = n / forest.sketch.shape[1]
        steps = max(1, -(-reach // max(1, int(per_step)))) if reach else _calibrated(entries, forest, k, target)
        best = _search(entries, forest, steps, most, scratch)
        owners = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("h").alias("rep"))
        result = owners.join(best, "rep").select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
        return written(result.select("query_id", F.posexplode("best").alias("place", "b")).select(
            "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score")))


def _search(entries: DataFrame, forest: Forest, steps: int, most: int, scratch: Scratch) -> DataFrame:
    """``rep, best``: for each asking entry the ``most`` best ids among the rows that the trees offer."""
    trees = len(forest.planes)
    kind = dict(entries.dtypes)["v"]

    def placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                codes = Forest.codes(forest, _array(some.column(2)).astype(np.float64), True)[:, 0]
                salt = some.column(0).to_numpy().view(np.uint64) % np.uint64(1 << 30)
                yield pa.RecordBatch.from_arrays([pa.array(forest.piece(0, codes, salt.astype(np.int64))), *some.columns], names=["block", "rep", "ids", "v", "asks"])

    def numbered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places inside each block, which comes in one piece."""
        last, start = None, 0
        for batch in parts:
            blocks = batch.column(0).to_numpy()
            new = np.append(last is None or blocks[0] != last, blocks[1:] != blocks[:-1]) if len(blocks) else np.zeros(0, bool)
            begins = np.maximum.accumulate(np.where(new, np.arange(len(blocks)), -1))
            local = np.arange(len(blocks)) - begins
            local[begins < 0] = start + np.arange(int((begins < 0).sum()))
            if len(blocks):
                last, start = blocks[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local.astype(np.int32))], names=["block", "rep", "ids", "v", "asks", "local"])

    laid = entries.select("rep", "ids", "v", "asks").mapInArrow(placed, f"block long, rep long, ids array<long>, v {kind}, asks boolean")
    laid = laid.repartition("block").sortWithinPartitions("block", "rep").mapInArrow(numbered, f"block long, rep long, ids array<long>, v {kind}, asks boolean, local int")
    table = scratch.table(laid)

    def grown(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tree rows: the string of every entry in every tree."""
        for batch in parts:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                codes = forest.codes(_array(some.column(1)).astype(np.float64), True)
                block, local = some.column(0), some.column(2)
                spread = block.to_numpy() * 65537 + local.to_numpy()
                for tree in range(trees):
                    size = len(codes)
                    yield _tree_rows(tree, forest.piece(tree, codes[:, tree], spread), codes[:, tree], codes[:, tree], np.zeros(size, np.int64), block, local)

    def descended(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Query rows: the interval of every query in every tree, once for each piece that it touches."""
        for batch in parts:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                own = forest.codes(_array(some.column(1)).astype(np.float64), False)
                low, high = forest.intervals(own, steps)
                for tree in range(trees):
                    first, last = forest.pieces(tree, low[:, tree], high[:, tree])
                    who = np.repeat(np.arange(len(own)), last - first + 1)
                    piece = np.arange(len(who)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[who]
                    yield _tree_rows(tree, piece, low[who, tree], high[who, tree], some.column(0).to_numpy()[who], pa.array(np.full(len(who), -1, np.int64)), pa.array(np.zeros(len(who), np.int32)))

    tree_schema = "tree int, piece long, low long, high long, rep long, block long, local int"
    items = table.select("block", "v", "local").mapInArrow(grown, tree_schema)
    asked = table.where("asks").select("rep", "v")
    both = items.unionByName(asked.mapInArrow(descended, tree_schema))
    # in each piece the rows come before the queries
    ordered = both.repartition("tree", "piece").sortWithinPartitions("tree", "piece", F.col("block") < 0, "low")

    def offered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each interval holds in each piece, as places in blocks of entries: one list."""
        piece, codes, blocks, places, ready = None, [], [], [], None
        for batch in parts:
            cols = [c.to_numpy() for c in batch.columns]
            key = cols[0].astype(np.int64) << 40 | cols[1]
            edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | ((cols[5][1:] < 0) != (cols[5][:-1] < 0))) + 1, [len(key)]]) if len(key) else [0]
            reps, lists, held = [], [], 0
            for a, b in zip(edges[:-1], edges[1:]):
                if key[a] != piece:
                    piece, codes, blocks, places, ready = key[a], [], [], [], None
                if cols[5][a] >= 0:
                    codes.append(cols[2][a:b])
                    blocks.append(cols[5][a:b])
                    places.append(cols[6][a:b])
                    continue
                if not codes:
                    continue
                if ready is None:
                    ready = np.concatenate(codes), np.concatenate(blocks), np.concatenate(places)
                begin, stop = np.searchsorted(ready[0], cols[2][a:b], "left"), np.searchsorted(ready[0], cols[3][a:b], "right")
                for rep, i, j in zip(cols[4][a:b].tolist(), begin.tolist(), stop.tolist()):
                    if i < j:
                        block, place = ready[1][i:j], ready[2][i:j]
                        order = np.argsort(block, kind="stable")
                        reps.append(rep)
                        lists.append(_packed_by_block(block[order], place[order]))
                        held += j - i
                    if len(reps) >= 4096 or held >= HELD_PLACES:
                        yield _offers(reps, lists)
                        reps, lists, held = [], [], 0
            if reps:
                yield _offers(reps, lists)

    offers = ordered.mapInArrow(offered, "rep long, places binary")
    kinds = offers.select("rep", F.lit(1).alias("kind"), "places", F.lit(None).cast(kind).alias("v")).unionByName(
        asked.select("rep", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("places"), "v"))

    def united(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One list for each query and block over all trees, with the query's vector; a very long one comes in parts."""
        rep = vector = None
        held: dict[int, list[np.ndarray]] = {}
        places = 0

        def lists() -> list[tuple]:
            return [(block, rep, vector, _packed(np.unique(np.concatenate(some)))) for block, some in held.items()]

        out: list[tuple] = []
        shape = None
        for batch in parts:
            shape = batch.schema.field(3).type
            for r, k, p, v in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if held and (r != rep or places >= HELD_PLACES):
                    out += lists()
                    held, places = {}, 0
                if not k:
                    rep, vector = r, v.as_py()
                    continue
                for block, some in _unpacked_by_block(p):
                    held.setdefault(block, []).append(some)
                    places += len(some)
                if len(out) >= 2048:
                    yield _united(out, shape)
                    out = []
        out += lists()
        if out:
            yield _united(out, shape)

    lists = kinds.repartition("rep").sortWithinPartitions("rep", "kind").select("rep", "kind", "places", "v").mapInArrow(united, f"block long, rep long, v {kind}, places binary")
    empty = F.lit(None).cast("array<long>")
    at_blocks = table.select("block", F.lit(0).alias("kind"), "local", "rep", "ids", "v", F.lit(None).cast("binary").alias("places")).unionByName(
        lists.select("block", F.lit(1).alias("kind"), F.lit(0).alias("local"), "rep", empty.alias("ids"), "v", "places"))

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best rows of each block for each query that was offered some of them."""
        block, vectors, ids, ready = None, [], [], None
        for batch in parts:
            number, kinds_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((np.diff(number) != 0) | (np.diff(kinds_) != 0)) + 1, [len(number)]]) if len(number) else [0]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if number[a] != block:
                    block, vectors, ids, ready = number[a], [], [], None
                some = batch.slice(a, b - a)
                if not kinds_[a]:
                    vectors.append(_array(some.column(5)).astype(np.float64))
                    ids.append(some.column(4))
                    continue
                if ready is None:
                    ready = np.concatenate(vectors), pa.concat_arrays(ids)
                x = ready[0]
                q = _array(some.column(5)).astype(np.float64)
                reps, who, score = some.column(3).to_numpy(), [], []
                from_: list[np.ndarray] = []
                for i, places in enumerate(some.column(6).to_pylist()):
                    near = _unpacked(places).astype(np.int64)
                    s = x[near] @ q[i]
                    if len(near) > most:  # what can be among the best; ties at the border stay
                        near = near[s >= np.partition(s, -most)[-most] - 1e-9 * (1 + np.abs(s).max())]
                    from_.append(near)
                    who.append(np.full(len(near), reps[i]))
                    score.append((x[near] * q[i]).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), pa.array(np.concatenate(score)), ready[1].take(pa.array(np.concatenate(from_)))], names=["rep", "score", "ids"])

    found = at_blocks.repartition("block").sortWithinPartitions("block", "kind", "local").mapInArrow(scored, "rep long, score double, ids array<long>")
    pairs = found.select("rep", "score", F.explode("ids").alias("vec_id")).groupBy("rep", "vec_id").agg(F.max("score").alias("score"))
    best = pairs.withColumn("place", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= most)
    return scratch.table(best.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best")))


def _tree_rows(tree: int, piece: np.ndarray, low: np.ndarray, high: np.ndarray, rep: np.ndarray, block: pa.Array, local: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(piece), tree, np.int32)), pa.array(piece.astype(np.int64)), pa.array(low), pa.array(high), pa.array(rep), block, local],
                                      names=["tree", "piece", "low", "high", "rep", "block", "local"])


def _packed(places: np.ndarray) -> bytes:
    """Places of a block as 16-bit numbers where they fit, else 32-bit ones; the first byte says which."""
    return b"\x02" + places.astype("<u2").tobytes() if not len(places) or places.max() < 65536 else b"\x04" + places.astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype(np.uint32)


def _packed_by_block(block: np.ndarray, place: np.ndarray) -> bytes:
    """Places, ascending by block: how many blocks, the blocks, how many places each has, the places."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])
    sizes = np.diff(np.append(cut, len(block)))
    return len(cut).to_bytes(4, "little") + block[cut].astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + _packed(place)


def _unpacked_by_block(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    n = int.from_bytes(data[:4], "little")
    blocks, sizes = np.frombuffer(data, "<i8", n, 4), np.frombuffer(data, "<u4", n, 4 + 8 * n)
    yield from zip(blocks.tolist(), np.split(_unpacked(data[4 + 12 * n :]), np.cumsum(sizes)[:-1]))


def _offers(reps: list[int], lists: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(lists, pa.binary())], names=["rep", "places"])


def _united(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    block, rep, v, places = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(rep, pa.int64()), pa.array(v, kind), pa.array(places, pa.binary())], names=["block", "rep", "v", "places"])


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact ``(query_id, vec_id)`` pairs that were found."""
    pairs = ["query_id", "vec_id"]
    n = exact.count()
    return found.select(*pairs).distinct().join(exact.select(*pairs).distinct(), pairs).count() / n if n else 1.0
