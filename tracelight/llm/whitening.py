"""Embedding whitening: leading components of the covariance by a block Jacobi-Davidson method, and whitened coordinates.

Method. The covariance is never formed: a product of it with a few vectors is a Spark job that centres every row, multiplies
it with the vectors and back, and sums d x b numbers. Ritz pairs are taken from a search space; for those that lead and
have not settled, the correction equation, projected off the settled components and the Ritz vectors, is solved roughly
by a few steps of MINRES, all columns side by side, so that a step is one product; the corrections extend the search
space. Pairs are locked from the largest down once their residual is at the level of rounding, until all wanted ones are;
a last Rayleigh-Ritz step over the locked space puts them in order.

On Spark: vectors become blocks of whole numbers, written once. Every product reads these blocks, sums inside each task,
then over a fixed number of tasks; the driver holds d x b numbers, whatever the number of rows. Sums and deviations are
exact in whole numbers, and ``n*x - S`` is formed in whole numbers before it becomes a double.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import written

SCALE, SHIFT = 64, 1_000_000
BLOCK_VALUES = 1 << 18  # numbers in a block of rows
SUM_TASKS = 16
WIDTH, INNER_STEPS = 16, 4
# A residual counts as rounding below this share of the largest eigenvalue.
SETTLED = 64 * np.finfo(np.float64).eps
# Where residuals stop shrinking above SETTLED, they are accepted below this share only.
STALLED = 1e-12
LEAST_EIGENVALUE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """``components``: unit columns by falling ``eigenvalues``; ``sums``: exact sums of the whole numbers of each dimension."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    products: int


@dataclass(frozen=True)
class Blocks:
    """Written blocks ``ids array<long>, x binary``, the dimension of their vectors (0 without rows), and in how many tasks they are read."""

    df: DataFrame
    dim: int
    tasks: int


def whole_numbers(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> Blocks:
    """Blocks of the rows whose vector takes part.

    A null vector, one with a null or non-finite entry and an empty one take no part. Where vectors differ in length, the
    most frequent length (of equally frequent ones the larger) takes part. A vector with an entry of 2^55 and more, which
    has no whole number of 64 bits, takes no part either. A null id stays.
    """
    v = F.col(vector).cast("array<double>")
    good = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")) \
        .where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**55)))
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), F.col("d").desc()).limit(1).collect()
    dim = lengths[0]["d"] if lengths else 0
    step = max(1, BLOCK_VALUES // max(1, dim))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            ids = pa.concat_arrays([i for i, _ in held])
            x = np.concatenate([m for _, m in held])
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([x.astype("<i8").tobytes()], pa.binary())], names=["ids", "x"])

        for batch in parts:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                values = some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                held.append((some.column(0), np.floor(SCALE * values).astype(np.int64) + SHIFT))
                if sum(len(i) for i, _ in held) >= step:
                    yield made()
                    held.clear()
        if held:
            yield made()

    blocks = written(good.where(F.size("v") == dim).mapInArrow(run, "ids array<long>, x binary"))
    return Blocks(blocks, dim, blocks.rdd.getNumPartitions())


def _summed(blocks: Blocks, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], dtype: str = "<f8") -> np.ndarray:
    """Sum over all blocks of what ``of`` makes of a block's whole numbers: inside tasks, then in SUM_TASKS tasks, then here."""

    def add(parts: Iterator[pa.RecordBatch], column: int, part: Callable[[bytes], np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in parts:
            for value in batch.column(column):
                one = part(value.as_buffer())
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, dtype).tobytes()], pa.binary())], names=["part"])

    inner = blocks.df.select("x").mapInArrow(lambda parts: add(parts, 0, lambda b: of(np.frombuffer(b, "<i8"))), "part binary")
    if blocks.tasks > SUM_TASKS:
        inner = inner.repartition(SUM_TASKS).mapInArrow(lambda parts: add(parts, 0, lambda b: np.frombuffer(b, dtype).reshape(shape)), "part binary")
    total = np.zeros(shape, dtype)
    for row in inner.collect():  # SUM_TASKS rows of the given shape at most
        total = total + np.frombuffer(row["part"], dtype).reshape(shape)
    return total


def column_sums(blocks: Blocks) -> tuple[int, tuple[int, ...]]:
    """Number of rows and exact sum of each dimension, added up in quarters of 16 bits, which do not overflow below 2^47 rows."""
    dim = blocks.dim

    def quarters(x: np.ndarray) -> np.ndarray:
        x = x.reshape(-1, dim)
        parts = [x & 0xFFFF, (x >> 16) & 0xFFFF, (x >> 32) & 0xFFFF, x >> 48]
        return np.stack([np.append(p.sum(axis=0), len(x)) for p in parts])

    total = _summed(blocks, quarters, (4, dim + 1), "<i8").tolist()
    return total[0][dim], tuple(sum(total[k][j] << 16 * k for k in range(4)) for j in range(dim))


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``x - S/n`` as doubles: the mean's whole part goes in whole numbers, so that one rounding is left."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole)])
    return (x.reshape(-1, len(sums)) - np.array(whole, np.int64)).astype(np.float64) - rest


class CentredProducts:
    """Products of the covariance (divisor n, centred before multiplying) with a few vectors, one Spark job each."""

    def __init__(self, blocks: Blocks, n: int, sums: tuple[int, ...]):
        self.blocks, self.n, self.sums, self.done = blocks, n, sums, 0

    def __call__(self, y: np.ndarray) -> np.ndarray:
        n, sums = self.n, self.sums
        self.done += 1

        def of(x: np.ndarray) -> np.ndarray:
            z = centred(x, n, sums)
            return z.T @ (z @ y)

        return _summed(self.blocks, of, y.shape) / n

    def trace(self) -> float:
        n, sums = self.n, self.sums
        return float(_summed(self.blocks, lambda x: np.array([(centred(x, n, sums) ** 2).sum()]), (1,))[0]) / n


def _off(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``y`` without its part in the span of the orthonormal ``q``, twice for rounding."""
    for _ in range(2):
        y = y - q @ (q.T @ y)
    return y


def _basis(y: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Orthonormal columns that extend ``q`` by ``y``; columns that lie in the span already are left out."""
    out = q
    for j in range(y.shape[1]):
        v = y[:, j]
        size = np.linalg.norm(v)
        v = _off(out, v[:, None])[:, 0]
        left = np.linalg.norm(v)
        if size > 0 and left > 1e-10 * size:
            v = _off(out, (v / left)[:, None])[:, 0]
            out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, q.shape[1] :]


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of symmetric systems, one for each column of ``b``, by ``steps`` of MINRES side by side."""
    x = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    v_old, v = np.zeros_like(b), b / np.where(beta > 0, beta, 1)
    w_old, w = np.zeros_like(b), np.zeros_like(b)
    eta, c_old, c, s_old, s = beta.copy(), *(np.full(b.shape[1], k) for k in (1.0, 1.0, 0.0, 0.0))
    off = np.zeros(b.shape[1])
    live = beta > 0
    for _ in range(steps):
        if not live.any():
            break
        y = apply(v) - off * v_old
        alpha = (v * y).sum(axis=0)
        y = y - alpha * v
        new = np.linalg.norm(y, axis=0)
        delta, low = c * alpha - c_old * s * off, s * alpha + c_old * c * off
        far, turn = s_old * off, np.hypot(delta, new)
        live &= turn > 1e-300
        safe = np.where(live, turn, 1.0)
        c_old, s_old, c, s = c, s, np.where(live, delta / safe, 1.0), np.where(live, new / safe, 0.0)
        w_old, w = w, np.where(live, (v - far * w_old - low * w) / safe, 0.0)
        x = x + np.where(live, c * eta, 0.0) * w
        eta = -s * eta
        live &= new > 1e-14 * np.maximum(np.abs(alpha), 1e-300)
        v_old, v, off = v, np.where(live, y / np.where(new > 0, new, 1.0), 0.0), np.where(live, new, 0.0)
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, width: int = WIDTH, inner: int = INNER_STEPS, most_rounds: int = 500,
                    seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric positive operator, falling, and orthonormal eigenvectors as columns.

    Eigenvalues below LEAST_EIGENVALUE of the largest are left out, so fewer may come back. When enough pairs are locked, a
    fresh random space off them is searched until its largest value is surely below theirs: an eigenvalue of higher
    multiplicity than ``width`` is not cut short.
    """
    wanted, width = min(wanted, dim), min(width, dim)
    random = np.random.default_rng(seed)
    locked, locked_a, found = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros(0)
    space = _basis(random.normal(size=(dim, width)), locked)
    space_a = product(space)
    largest, best, still, probing = 0.0, np.inf, 0, False
    for _ in range(most_rounds):
        values, turn = np.linalg.eigh((space.T @ space_a + space_a.T @ space) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, vectors_a = space @ turn, space_a @ turn
        largest = max(largest, float(values[0]))
        if largest <= 0:
            break
        residuals = _off(locked, vectors_a - vectors * values)
        sizes = np.linalg.norm(residuals, axis=0)
        least = np.sort(found)[-wanted] if len(found) >= wanted else -np.inf
        if values[0] + sizes[0] <= max(least, LEAST_EIGENVALUE * largest) * (1 + SETTLED):
            break
        # from the largest down: a pair is locked only behind all larger ones
        lead = int(np.argmax(np.append(sizes > SETTLED * largest, True)))
        if not lead:
            still, best = (0 if sizes[0] < 0.5 * best else still + 1), min(best, float(sizes[0]))
            lead = int(still >= 4 and sizes[0] <= STALLED * largest)
        whole = locked.shape[1] + space.shape[1] >= dim  # nothing can extend the space: what is left is rounding
        lead = len(values) if whole else min(lead, max(1, wanted - len(found)))
        if lead:
            locked, locked_a = np.column_stack([locked, vectors[:, :lead]]), np.column_stack([locked_a, vectors_a[:, :lead]])
            found, best, still = np.append(found, values[:lead]), np.inf, 0
        if whole:
            break
        space, space_a, values, residuals = vectors[:, lead:], vectors_a[:, lead:], values[lead:], residuals[:, lead:]
        if not space.shape[1] or (len(found) >= wanted and not probing):
            probing = len(found) >= wanted
            space = _basis(random.normal(size=(dim, width)), locked)
            space_a = product(space)
            continue
        left = max(1, wanted - len(found))
        if space.shape[1] > left + 5 * width:  # a thick restart
            keep = left + 3 * width
            space, space_a, values, residuals = space[:, :keep], space_a[:, :keep], values[:keep], residuals[:, :keep]
        theta = values[:width]
        fixed = np.column_stack([locked, space[:, :width]])
        shifted = lambda y: _off(fixed, product(y) - y * theta)  # noqa: B023, E731
        correction = minres(shifted, -_off(fixed, residuals[:, :width]), inner)
        so_far = np.column_stack([locked, space])
        fresh = _basis(_off(fixed, correction), so_far)
        if not fresh.shape[1]:
            fresh = _basis(random.normal(size=(dim, width)), so_far)
        space, space_a = np.column_stack([space, fresh]), np.column_stack([space_a, product(fresh)])
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if not locked.shape[1]:
        return np.zeros(0), locked
    values, turn = np.linalg.eigh((locked.T @ locked_a + locked_a.T @ locked) / 2)
    order = [j for j in np.argsort(-values, kind="stable") if values[j] > LEAST_EIGENVALUE * values.max()][:wanted]
    return values[order], locked @ turn[:, order]


def fit(blocks: Blocks, components: int = 32) -> Whitening | None:
    """Components of all rows of ``blocks``; None without rows. Rows that are all equal have no component."""
    if not blocks.dim:
        return None
    n, sums = column_sums(blocks)
    product = CentredProducts(blocks, n, sums)
    trace = product.trace()
    values, vectors = jacobi_davidson(product, blocks.dim, components) if trace > 0 else (np.zeros(0), np.zeros((blocks.dim, 0)))
    return Whitening(n, sums, vectors, values, trace, product.done)


def identity_error(blocks: Blocks, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, centred before multiplying."""
    n, sums, turn = model.n, model.sums, model.components / np.sqrt(model.eigenvalues)
    k = turn.shape[1]
    mean = _summed(blocks, lambda x: (centred(x, n, sums) @ turn).sum(axis=0), (k,)) / n

    def of(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ turn - mean
        return w.T @ w

    return float(np.abs(_summed(blocks, of, (k, k)) / n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of ``(n*x - S)^2`` of each row, exact; null beyond a long."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    from_mean = x.reshape(-1, len(sums)) - whole
    if n * (float(np.abs(from_mean).max(initial=0)) + 1) * len(sums) ** 0.5 >= 2.0**31:  # beyond that, sums of squares need Python's whole numbers
        from_mean, rest = from_mean.astype(object), rest.astype(object)
    part = from_mean * n - rest
    return [v if v < 1 << 63 else None for v in (part * part).sum(axis=1).tolist()]


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every row that takes part and every component.

    Components are numbered from 1 by falling eigenvalue, up to ``components``, those of zero variance left out: rows that
    are all equal, and a single row, give none, as does an empty table. Repeated rows and equal ids are rows of their own.
    ``deviation`` is null beyond a long. Which vectors take part is said at ``whole_numbers``. Other columns play no part.
    """
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    blocks = whole_numbers(embeddings, id_col, vector)
    model = fit(blocks, components)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], schema)
    n, sums, k = model.n, model.sums, len(model.eigenvalues)
    turn, explained, error = model.components / np.sqrt(model.eigenvalues), model.eigenvalues / model.trace, identity_error(blocks, model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for ids, data in zip(batch.column(0), batch.column(1)):
                x = np.frombuffer(data.as_buffer(), "<i8")
                white, far, ids = centred(x, n, sums) @ turn, deviations(x, n, sums), ids.values
                rows = len(ids)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n, np.int64)),
                    pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(white.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                ], names=[f.split()[0] for f in schema.split(", ")])

    return blocks.df.mapInArrow(run, schema)
