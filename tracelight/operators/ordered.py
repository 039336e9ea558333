"""Order-dependent operators that never put a whole file or table into one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelight.session import cut_lineage

BLOCK_LINES = 65_536
ROWS_PER_TASK = 100_000


def carry_forward(
    df: DataFrame, by: str, order: str, values: dict[str, Column], block: int = BLOCK_LINES
) -> DataFrame:
    """Last non-NULL value at or before each row of the same ``by``, in ``order``.

    Two levels: inside fixed blocks of line numbers, then over one row per block, so the size of
    a single file does not bound the work of a task.
    """
    names = list(values)
    staged = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("long"))
    for name, column in values.items():
        staged = staged.withColumn(f"_in_{name}", column)
    per_block = staged.groupBy(by, "_block").agg(
        *[F.max_by(F.col(f"_in_{n}"), F.when(F.col(f"_in_{n}").isNotNull(), F.col(order))).alias(f"_tail_{n}") for n in names]
    )
    earlier = W.partitionBy(by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = per_block.select(
        by, "_block", *[F.last(f"_tail_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in names]
    )
    within = W.partitionBy(by, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = staged.select(
        *df.columns, "_block", *[F.last(f"_in_{n}", ignorenulls=True).over(within).alias(f"_here_{n}") for n in names]
    )
    joined = local.join(carried, [by, "_block"], "left")
    return joined.select(
        *df.columns, *[F.coalesce(F.col(f"_here_{n}"), F.col(f"_carry_{n}")).alias(n) for n in names]
    )


def global_index(df: DataFrame, order: Sequence[Column | str], name: str = "idx", start: int = 1, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Consecutive numbers in ``order`` over the whole table.

    Range-partitioned sort, saved to the checkpoint folder (by ``keep``) so that the partition layout is fixed,
    then one offset per partition. Ranges follow the number of rows: wide rows that compress well
    would share a few large ones.
    """
    tasks = max(1, -(-df.count() // ROWS_PER_TASK))
    laid = (
        df.repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    laid = keep(laid)
    sizes = laid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count
    offsets = sizes.select(
        "_pid",
        F.coalesce(
            F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    return (
        laid.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_offset") + F.col("_pos") + F.lit(start))
        .drop("_pid", "_pos", "_offset")
    )


def numbered_ids(df: DataFrame, order: Sequence[Column | str], prefix: str, name: str, digits: int = 6) -> DataFrame:
    """``PREFIX-000001`` identifiers in ``order``."""
    indexed = global_index(df.drop(name), order, "_seq")
    text = F.col("_seq").cast("string")
    padded = F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))
    return indexed.withColumn(name, F.concat(F.lit(f"{prefix}-"), padded)).drop("_seq")


def smallest_distinct(df: DataFrame, group: Sequence[str], value: Column, limit: int, name: str) -> DataFrame:
    """The ``limit`` smallest distinct values per group, joined with ``;``.

    Values are made distinct first and ranked with a per-group limit that Spark applies before the
    shuffle, so no group is collected beyond ``limit`` values.
    """
    distinct = df.select(*group, value.alias("_v")).where(F.col("_v").isNotNull() & (F.col("_v") != "")).distinct()
    ranked = distinct.withColumn("_rank", F.row_number().over(W.partitionBy(*group).orderBy("_v")))
    return (
        ranked.where(F.col("_rank") <= limit)
        .groupBy(*group)
        .agg(F.array_join(F.array_sort(F.collect_list("_v")), ";").alias(name))
    )
