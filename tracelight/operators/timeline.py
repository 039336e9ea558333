"""Findings as one ordered timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions.times import instant, micros
from tracelight.operators.ordered import numbered_ids

# Timeline kind of a source type and its rank among equal instants.
KINDS = {
    "access_log": "http", "db_log": "database", "app_log": "app_log", "waf_log": "waf", "file": "file", "process": "process",
    "network": "network", "account": "auth", "logon": "auth", "persistence": "persistence", "ioc": "ioc",
}
RANKS = {
    "http": 10, "database": 20, "waf": 22, "app_log": 24, "error": 25, "file": 30, "yara": 35, "process": 40,
    "network": 50, "persistence": 60, "auth": 70, "ioc": 80,
}
ACTIONS = {
    "db_log": "database_event", "app_log": "application_error", "waf_log": "waf_event", "file": "file_evidence",
    "process": "process_evidence", "network": "network_evidence", "persistence": "persistence_evidence", "ioc": "ioc_match",
}


def _lookup(table: dict, key: Column, default) -> Column:
    pairs = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def timeline_events(findings: DataFrame, tz_offset: str = "+00:00") -> DataFrame:
    """Timeline rows with their sort keys ``_at`` (NULL last) and ``_rank``; ids follow the findings' ids."""
    c = F.col
    kind = F.when((c("source_type") == "file") & (c("category") == "yara_match"), "yara").otherwise(_lookup(KINDS, c("source_type"), "error"))
    level = F.coalesce(c("evidence_chain_level"), F.lit("L1"))
    action = F.when(c("source_type") == "access_log", F.coalesce("method", F.lit("http_request"))).otherwise(_lookup(ACTIONS, c("source_type"), "evidence"))
    return findings.select(
        "timestamp", kind.alias("source_type"), "severity", c("remote_ip").alias("subject"), action.alias("action"),
        F.coalesce("uri_path", "source_file").alias("object"), "source_file", "line_number", c("finding_id"),
        F.array_sort(F.array_distinct(F.concat(F.array("finding_id"), F.coalesce("related_ids", F.array().cast("array<string>"))))).alias("related_finding_ids"),
        F.round(F.least(c("score"), F.lit(100)) / 100.0, 2).alias("confidence"),
        F.concat(level, F.lit(" "), c("source_type"), F.lit(" "), c("rule_id"), F.lit(" score "), c("score").cast("string"), F.lit(": "), c("evidence_summary")).alias("summary"),
        micros(instant(c("timestamp"), tz_offset)).alias("_at"), _lookup(RANKS, kind, 25).alias("_rank"),
    )


def timeline(findings: DataFrame, tz_offset: str = "+00:00") -> DataFrame:
    """Numbered and ordered timeline."""
    numbered = numbered_ids(timeline_events(findings, tz_offset), ["finding_id"], "TL", "event_id")
    return numbered.orderBy(F.col("_at").asc_nulls_last(), "_rank", "event_id").drop("_at", "_rank", "finding_id")
