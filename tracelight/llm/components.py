"""Connected components whose hot nodes are split: minima are summed before they move, and joins read written tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import written


def _star(edges: DataFrame, large: bool, table: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One step: the larger (or smaller) neighbours of each node point at the smallest node around it."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    near = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    # written, so that both sides of the join are plain exchanges and a hot node's partition can be split
    low = table(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    moved = near.join(low, "u").where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, table: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """``(node, root)`` of every node of ``edges(u, v)``; the root is the smallest node that can be reached, and has a row too.

    Alternating large-star and small-star steps; rounds grow with the logarithm of a component's size. Loops and
    repeated edges are of no effect; no edges give no rows. ``table`` writes the tables of the rounds.
    """
    current = table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        settled = table(_star(_star(current, True, table), False, table))
        # a forest of stars: each node points once, and no node that is pointed at points on
        several = settled.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        onward = settled.select("u").join(settled.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        current = settled
        if several.unionByName(onward).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
