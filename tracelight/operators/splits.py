"""Values carried forward through files without moving their lines.

Lines of one input split lie in one task, in order. Three steps: the last value of each split, one narrow row per split; a
scan of these rows along each file, which gives the value that enters a split; and a pass over the lines that starts each
split from its entering value. Only the rows of the first step are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tracelight.functions.frames import joined_narrow
from tracelight.operators.ordered import carry_forward

SPLIT = "_split"
_KEYS = ["source_file", SPLIT]


def in_splits(lines: DataFrame) -> bool:
    """Whether lines still lie as they were read."""
    return SPLIT in lines.columns


class _Fill:
    """Forward fill of one column over batches; a run is the rows of one split."""

    def __init__(self, before: bool):
        self.before, self.state = before, None

    def __call__(self, own: pa.Array, entry: pa.Array, starts: np.ndarray, goes_on: bool) -> pa.Array:
        """``starts``: for each row the first row of its run in this batch; ``goes_on``: the first run began in the batch before."""
        n = len(own)
        rows = np.arange(n)
        last = np.maximum.accumulate(np.where(own.is_valid().to_numpy(zero_copy_only=False), rows, -1))
        first = self.state if goes_on else entry.slice(0, 1)
        values = pa.concat_arrays([own, entry, first])
        outside = np.where(goes_on & (starts == 0), 2 * n, n + rows)
        here = np.where(last >= starts, last, outside)
        self.state = values.take(pa.array(here[-1:]))
        if self.before:
            here = np.where(rows > starts, np.append(0, here[:-1]), outside)
        return values.take(pa.array(here))


def carry_in_splits(lines: DataFrame, values: dict[str, Column], before: bool = False, per_file: dict[str, Column] | None = None) -> DataFrame:
    """Last non-NULL value at or before each line (``before``: strictly before) of the same file.

    ``lines`` has ``source_file, _split, line_number``, the rows of a split in order in one task. ``per_file`` are
    aggregates over a file that every line gets as well; they ride on the rows of the splits.
    """
    names = list(values)
    staged = lines.select("*", *[column.alias(f"_in_{n}") for n, column in values.items()])
    tails = staged.groupBy(*_KEYS).agg(*[F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col("line_number"))).alias(f"_tail_{n}") for n in names])
    earlier = W.partitionBy("source_file").orderBy(SPLIT).rowsBetween(W.unboundedPreceding, -1)
    entering = tails.select(*_KEYS, *[F.last(f"_tail_{n}", ignorenulls=True).over(earlier).alias(f"_entry_{n}") for n in names])
    if per_file:
        entering = entering.join(lines.groupBy("source_file").agg(*[column.alias(n) for n, column in per_file.items()]), "source_file")
    joined, stayed = joined_narrow(staged, entering, _KEYS)
    if not stayed:  # shuffled by file and split, so each split is in one task again
        joined = joined.sortWithinPartitions(*_KEYS, "line_number")
    kept = [*lines.columns, *(per_file or {})]
    keyed = joined.select(*kept, *[f"_in_{n}" for n in names], *[f"_entry_{n}" for n in names], F.xxhash64(*_KEYS).alias("_run"))
    k, v = len(kept), len(names)
    schema = StructType([keyed.schema[c] for c in kept] + [StructField(n, keyed.schema[f"_in_{n}"].dataType) for n in names])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills, last_run = [_Fill(before) for _ in names], None
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column(k + 2 * v).to_numpy()
            new = np.append(True, runs[1:] != runs[:-1])
            starts = np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))
            goes_on, last_run = bool(runs[0] == last_run), runs[-1]
            filled = [f(batch.column(k + i), batch.column(k + v + i), starts, goes_on) for i, f in enumerate(fills)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *filled], names=schema.names)

    return keyed.mapInArrow(fill, schema)


def carried(lines: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Last non-NULL value at or before each line: inside splits where lines lie as read, by blocks of line numbers otherwise."""
    return carry_in_splits(lines, values) if in_splits(lines) else carry_forward(lines, "source_file", "line_number", values)
