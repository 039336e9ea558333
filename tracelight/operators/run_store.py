"""Tables of earlier runs, kept version by version, and what changed between two of them.

Rows are dealt into buckets by their key. A run writes its rows by bucket and, beside them, one summary row per bucket:
how many rows it has and a checksum that does not depend on their order (one more row counts the whole run). Two runs are compared by their summaries first, and
only the buckets whose summaries differ are read and joined. A run counts once its summary is there, which is written
last, so a failed run is not taken for an earlier one.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 256


def _content(columns: Sequence[str]) -> Column:
    return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"}))


class RunStore:
    """Versions of one table beneath ``root``: ``rows/run=<name>/bucket=<n>`` and ``summary/run=<name>``."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), list(keys), buckets

    def write(self, df: DataFrame, run: str) -> None:
        """Keep ``df`` as the run's rows; writing a run again replaces it."""
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")
        rows = df.withColumn("_content", _content(df.columns)).withColumn("bucket", bucket)
        # a bucket is a few files, however many tasks the input has
        rows.repartition("bucket", F.pmod("_content", F.lit(4))).write.mode("overwrite").partitionBy("bucket").parquet(self._rows(run))
        self.spark.createDataFrame([(rows.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/schema/run={run}")
        kept = self.read(run)
        summary = kept.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("_content").alias("mixed"), F.sum(F.pmod("_content", F.lit(1 << 31))).alias("total"))
        whole = kept.agg(F.lit(-1).alias("bucket"), F.count(F.lit(1)).alias("rows"), F.lit(0).cast("bigint").alias("mixed"), F.lit(0).cast("bigint").alias("total"))
        summary.unionByName(whole).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/summary/run={run}")

    def _rows(self, run: str) -> str:
        return f"{self.root}/rows/run={run}"

    def runs(self) -> list[str]:
        """Names of the whole runs, ascending."""
        try:
            found = self.spark.read.option("basePath", f"{self.root}/summary").schema("run string").parquet(f"{self.root}/summary").select("run").distinct().collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":  # nothing was written yet
                return []
            raise
        return sorted(r["run"] for r in found)

    def read(self, run: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of a run; with ``buckets`` only those are read."""
        shape = StructType.fromJson(json.loads(self.spark.read.text(f"{self.root}/schema/run={run}").head()[0]))
        rows = self.spark.read.schema(shape).parquet(self._rows(run))
        return rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))

    def changed_buckets(self, earlier: str, current: str) -> list[int]:
        """Buckets whose rows differ; at most as many numbers as there are buckets."""
        summary = lambda run: self.spark.read.parquet(f"{self.root}/summary/run={run}").where("bucket >= 0")
        a, b = summary(earlier).withColumnsRenamed({"rows": "r0", "mixed": "m0", "total": "t0"}), summary(current)
        both = a.join(b, "bucket", "full_outer")
        same = F.col("r0").eqNullSafe(F.col("rows")) & F.col("m0").eqNullSafe(F.col("mixed")) & F.col("t0").eqNullSafe(F.col("total"))
        return sorted(r["bucket"] for r in both.where(~same).select("bucket").collect())

    def diff(self, earlier: str, current: str) -> DataFrame:
        """``change`` (new, gone, changed) and the row: of the current run, or of the earlier one where it is gone.

        Rows are told apart by their keys, NULL being a value; of rows with equal keys each is paired with one of the other run.
        """
        buckets = self.changed_buckets(earlier, current)
        new, old = self.read(current, buckets), self.read(earlier, buckets)
        columns = [c for c in new.columns if c not in ("bucket", "_content")]
        # rows that both runs have are paired first, so a repeated key shows its differing rows only
        turn = F.row_number().over(W.partitionBy(*[F.col(f"`{k}`") for k in self.keys], "_content").orderBy(F.lit(0)))
        tag = lambda df: df.withColumn("_turn", turn)
        equal = ["bucket", "_content", "_turn"]
        n, o = tag(new), tag(old)
        fresh, stale = n.join(o.select(*equal, *self.keys), self._null_safe(n, o, equal), "left_anti"), o.join(n.select(*equal, *self.keys), self._null_safe(o, n, equal), "left_anti")
        place = F.row_number().over(W.partitionBy(*[F.col(f"`{k}`") for k in self.keys]).orderBy("_content", "_turn"))
        row = lambda df, name: df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(name), *[F.col(f"`{k}`").alias(f"_{name}{i}") for i, k in enumerate(self.keys)], place.alias(f"_{name}_n"))
        left, right = row(fresh, "new"), row(stale, "old")
        on = F.col("_new_n") == F.col("_old_n")
        for i in range(len(self.keys)):
            on = on & F.col(f"_new{i}").eqNullSafe(F.col(f"_old{i}"))
        change = F.when(F.col("_old_n").isNull(), "new").when(F.col("_new_n").isNull(), "gone").otherwise("changed")
        return left.join(right, on, "full_outer").select(change.alias("change"), F.coalesce("new", "old").alias("_row")).select("change", "_row.*")

    def _null_safe(self, a: DataFrame, b: DataFrame, equal: Sequence[str]) -> Column:
        on = F.lit(True)
        for c in [*equal, *self.keys]:
            on = on & a[c].eqNullSafe(b[c])
        return on
