"""Stream jobs with the same window semantics as the batch operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracelight.functions.net import ip_key, is_v4_key
from tracelight.functions.text import domain_host
from tracelight.functions.times import instant
from tracelight.functions.values import non_blank
from tracelight.operators.brute_force import THRESHOLD, WINDOW_MS
from tracelight.operators.enrich import host_suffixes, path_prefixes, short_pieces, with_ranges
from tracelight.operators.findings import match_rules
from tracelight.operators.records import effective_ip, http_records
from tracelight.rules.model import Rule
from tracelight.sources.lines import decode_lines
from tracelight.sources.web import parse_access


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """New log lines under a folder. Streams have no line numbers: the number is NULL."""
    raw = spark.readStream.option("recursiveFileLookup", True).text(path)
    return decode_lines(raw.select(F.col("_metadata.file_path").alias("source_file"), F.lit(None).cast("bigint").alias("line_number"), "value"))


def stream_rule_hits(lines: DataFrame, rules: Iterable[Rule], tz_offset: str = "+00:00") -> DataFrame:
    """Rule hits per access-log line, stateless. Conditions on five-minute counts see no count here."""
    events = parse_access(lines, tz_offset).events
    hits = match_rules(http_records(events, tz_offset, with_counts=False), rules)
    return hits.select(
        instant(F.col("timestamp"), tz_offset).alias("event_time"), "timestamp", "remote_ip", "uri_path", "rule_id", "score", "reasons", F.col("_raw_hash").alias("raw_hash"))


def stream_tumbling(hits: DataFrame, keys: list[str], delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Hits per key and five-minute bucket; a bucket is final once the watermark has passed it."""
    return hits.withWatermark("event_time", delay).groupBy(F.window("event_time", width).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("match_count"), F.max("score").alias("score")
    ).select((F.unix_seconds("w.start") / 300).cast("bigint").alias("bucket"), *keys, "match_count", "score")


class LateSplitter:
    """``foreachBatch`` sink that sets late rows aside and appends bucket counts of the rest.

    A row is late when it is more than ``delay_seconds`` older than the newest event time of earlier
    batches. A batch keeps the newest time seen so far next to its results, and the next one reads that
    row alone, so a restarted stream and a repeated batch decide the same way; every batch overwrites
    its own folder. ``compact`` gathers the late rows of finished batches.
    """

    def __init__(self, root: str, keys: list[str], delay_seconds: int = 600) -> None:
        self.root, self.keys, self.delay = root.rstrip("/"), keys, delay_seconds

    def _newest_before(self, spark: SparkSession, batch_id: int) -> Any:
        return spark.read.parquet(f"{self.root}/newest/batch_id={batch_id - 1}").head()[0] if batch_id else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = self._newest_before(spark, batch_id)
        is_late = F.lit(False) if newest is None else F.unix_micros("event_time") < newest - self.delay * 1_000_000
        flagged = batch.withColumn("_late", F.coalesce(is_late, F.lit(False))).persist()
        flagged.where("_late").drop("_late").write.mode("overwrite").parquet(f"{self.root}/late/batch_id={batch_id}")
        bucket = F.floor(F.unix_seconds("event_time") / 300).alias("bucket")
        flagged.where("not _late").groupBy(bucket, *self.keys).agg(
            F.count(F.lit(1)).alias("match_count"), F.max("score").alias("score")
        ).write.mode("overwrite").parquet(f"{self.root}/counts/batch_id={batch_id}")
        flagged.agg(F.greatest(F.max(F.unix_micros("event_time")), F.lit(newest).cast("bigint")).alias("newest")).write.mode("overwrite").parquet(f"{self.root}/newest/batch_id={batch_id}")
        flagged.unpersist()

    def totals(self, spark: SparkSession) -> DataFrame:
        """Counts over all batches."""
        return spark.read.parquet(f"{self.root}/counts").groupBy("bucket", *self.keys).agg(
            F.sum("match_count").alias("match_count"), F.max("score").alias("score"))

    def late(self, spark: SparkSession) -> DataFrame:
        """Late rows of all batches: the newest gathered table and the batches behind it."""
        rows, upto = spark.read.parquet(f"{self.root}/late"), self._gathered(spark)
        if upto is None:
            return rows
        base = spark.read.parquet(f"{self.root}/late_base/upto={upto}")
        return base.unionByName(rows.where(F.col("batch_id") > upto))

    def _gathered(self, spark: SparkSession) -> int | None:
        try:
            return spark.read.parquet(f"{self.root}/late_base").agg(F.max("upto")).head()[0]
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":  # nothing was gathered yet
                return None
            raise

    def compact(self, spark: SparkSession, upto: int, files: int = 1) -> None:
        """Gather the late rows of batches up to ``upto`` in a few files; readers go on to them when the table is whole."""
        self.late(spark).where(F.col("batch_id") <= upto).coalesce(files).write.mode("overwrite").parquet(f"{self.root}/late_base/upto={upto}")


_BRUTE_OUT = "source string, kind string, first_failure_ms bigint, at_ms bigint"
_STEP_MS = 60_000


def _advance(failures: list[int], first: int, reported: int, at: int, failed: bool) -> tuple[list[int], int, int, str | None]:
    """One attempt, in order of time: the last failures, the first failure once triggered, what has been reported."""
    event = None
    if failed:
        failures = [*failures, at][-THRESHOLD:]
        if reported == 0 and len(failures) == THRESHOLD and failures[-1] - failures[0] <= WINDOW_MS:
            first, reported, event = failures[0], 1, "triggered"
    elif reported == 1 and first <= at <= first + WINDOW_MS:
        reported, event = 2, "followed_by_success"
    return failures, first, reported, event


class BruteForceWatch(StatefulProcessor):
    """Attempts of one source wait in a map by their time until the watermark has passed them, and are then taken in order.

    So neither the order of arrival nor the cut into batches matters. The map holds counts per millisecond, for the delay of
    the watermark at most, whatever the traffic; beside it five failure times. A timer at the end of each minute that has
    attempts takes them; a last one drops the state twenty minutes after the last attempt. Attempts that come behind the
    watermark are given out as ``late`` instead of being lost.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at_ms bigint", "failed bigint, passed bigint")
        self.known = handle.getValueState("known", "failures array<bigint>, first bigint, reported int, newest bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        timers = set(self.handle.listTimers())
        for batch in rows:
            late = batch[batch["at_ms"] < mark]
            if len(late):
                yield pd.DataFrame({"source": key[0], "kind": "late", "first_failure_ms": -1, "at_ms": late["at_ms"].astype("int64")})
            counts = batch[batch["at_ms"] >= mark].groupby("at_ms")["failed"].agg(["sum", "count"])
            for at, failed, n in counts.itertuples():
                slot = (int(at),)
                held = self.waiting.getValue(slot) if self.waiting.containsKey(slot) else (0, 0)
                self.waiting.updateValue(slot, (held[0] + int(failed), held[1] + int(n - failed)))
                timer = (int(at) // _STEP_MS + 1) * _STEP_MS
                if timer not in timers:
                    timers.add(timer)
                    self.handle.registerTimer(timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        failures, first, reported, newest = self.known.get() if self.known.exists() else ([], -1, 0, -1)
        failures, out = list(failures), []
        due = sorted((k[0], v[0], v[1]) for k, v in self.waiting.iterator() if k[0] < until)
        for at, failed, passed in due:
            # of equal times failures come first; more than the threshold at once change nothing
            for is_failure in [True] * min(failed, THRESHOLD) + [False] * min(passed, 1):
                failures, first, reported, event = _advance(failures, first, reported, at, is_failure)
                if event:
                    out.append((key[0], event, first, at))
            self.waiting.removeKey((at,))
            newest = at
        if due:
            self.known.update((failures, first, reported, newest))
            self.handle.registerTimer(newest + 2 * WINDOW_MS + 1)
        elif newest + 2 * WINDOW_MS < until:
            self.known.clear()
        if out:
            yield pd.DataFrame(out, columns=["source", "kind", "first_failure_ms", "at_ms"])

    def close(self) -> None:
        pass


def stream_brute_force(attempts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Alerts per source from ``source, event_time, failed``: when five failures fall in ten minutes, and when a success follows.

    Alerts come when the watermark has passed the attempt that causes them, in order of time; ``late`` rows are attempts
    behind the watermark. Needs the RocksDB state store, which ``use_state_store`` sets.
    """
    timed = attempts.withWatermark("event_time", delay).select("source", "failed", F.unix_millis("event_time").alias("at_ms"))
    return timed.groupBy("source").transformWithStateInPandas(BruteForceWatch(), _BRUTE_OUT, "Append", "EventTime")


def use_state_store(spark: SparkSession) -> None:
    """The state store that map state and timers need, for queries started afterwards."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def indicator_keys(indicators: DataFrame) -> DataFrame:
    """Static side of the indicator join: ``(family, key)`` with what the exact test needs."""
    kind = lambda name: indicators.where(F.col("indicator_type") == name)
    none = lambda t: F.lit(None).cast(t)
    plain = lambda df, family, key: df.select(
        F.lit(family).alias("family"), key.alias("key"), "seq", none("string").alias("low"), none("string").alias("high"), none("boolean").alias("v4"), none("string").alias("needle"))
    v = F.col("value")
    nets = with_ranges(kind("cidr").withColumnRenamed("value", "network")).select(
        F.lit("net").alias("family"), F.concat(F.col("_digits").cast("string"), F.lit(":"), "_key").alias("key"), "seq", "low", "high", "v4", none("string").alias("needle"))
    agents = kind("user_agent").withColumn("needle", F.lower("value")).where("needle != ''").select(
        F.lit("agent").alias("family"), F.substring("needle", 1, 4).alias("key"), "seq", none("string").alias("low"), none("string").alias("high"), none("boolean").alias("v4"), "needle")
    return (
        plain(kind("ip"), "ip", ip_key(v)).unionByName(plain(kind("domain"), "host", F.lower(F.rtrim(F.trim(v), F.lit(".")))))
        .unionByName(plain(kind("url_path"), "path", F.lower(v))).unionByName(nets).unionByName(agents)
    )


def stream_ioc_hits(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """Stream of access-log events joined with a static indicator table."""
    keys = indicator_keys(indicators)
    staged = events.withColumn("_k", ip_key(effective_ip(F.col("remote_ip"), F.col("inferred_client_ip")))).withColumn("_ua", F.lower(non_blank(F.col("user_agent"))))
    pair = lambda family, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(family).alias("family"), x.alias("key")))
    nets = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda n: F.concat(n.cast("string"), F.lit(":"), F.substring("_k", F.lit(1), n)))
    probes = F.concat(
        pair("ip", F.when(F.col("_k").isNotNull(), F.array("_k"))), pair("net", F.when(F.col("_k").isNotNull(), nets)),
        pair("host", F.when(F.col("host").isNotNull(), host_suffixes(domain_host(F.col("host"))))),
        pair("path", F.when(F.col("uri_path").isNotNull(), path_prefixes(F.lower("uri_path")))),
        pair("agent", F.when(F.col("_ua").isNotNull(), short_pieces(F.col("_ua")))))
    joined = staged.withColumn("_p", F.explode(probes)).select("*", "_p.family", "_p.key").join(keys, ["family", "key"])
    exact = (
        F.when(F.col("family") == "net", F.col("_k").between(F.col("low"), F.col("high")) & (F.col("v4") | ~is_v4_key(F.col("_k"))))
        .when(F.col("family") == "agent", F.col("_ua").contains(F.col("needle"))).otherwise(True)
    )
    return joined.where(exact).drop("_k", "_ua", "_p", "key", "low", "high", "v4", "needle")
