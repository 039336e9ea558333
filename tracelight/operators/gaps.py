"""Collection errors as evidence gaps, gap findings and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions import assess
from tracelight.functions.text import sha256_hex
from tracelight.functions.values import display_or, holds, text
from tracelight.operators.findings import base_finding
from tracelight.operators.ordered import numbered_ids

# Sources by scope and the sources that never make a gap.
CORE_SOURCES = ["system", "process", "network", "account", "persistence", "filesystem"]
SCOPES = {
    "core_collection": CORE_SOURCES, "runtime": ["runtime"],
    "host_events": ["events", "windows_evtx", "linux_audit", "journald"], "container": ["container"],
}
CONFIG_SOURCES = ["trusted_proxy", "geoip", "ioc", "enrich"]
_ADVICE = {
    "host_events": "Check that event logs exist, were exported and cover the period; their absence is a gap, not a clean signal.",
    "runtime": "Check the supplied runtime paths and the component baseline before reading runtime results as complete.",
    "container": "Check container metadata paths and log access; container evidence is incomplete.",
}
_DEFAULT_ADVICE = "Check permissions, paths and log availability of this source before treating the run as complete."


def is_eligible(mode: str) -> Column:
    """Errors that mean missing evidence: not optional features, configuration input, or sources the mode never reads."""
    message = F.lower(text(F.col("message")))
    optional = F.col("source").isin("yara", "geoip") & (F.col("operation") == "initialize") & message.contains("not compiled")
    config = F.col("source").isin(*CONFIG_SOURCES) | message.rlike(r"could not parse|could not be parsed|not found")
    irrelevant = F.col("source").isin(*CORE_SOURCES) & F.lit(mode == "analyze")
    return ~holds(optional) & ~holds(config) & ~holds(irrelevant)


def coverage_of(message: Column, operation: Column) -> Column:
    lowered = F.lower(text(message))
    return (
        F.when(lowered.rlike("not supported|not compiled"), "unsupported")
        .when(lowered.rlike("does not exist|missing") | F.lower(text(operation)).contains("discover"), "not_collected")
        .otherwise("partial")
    )


def _normal_source(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), r"[- ]", "_")


def evidence_gaps(errors: DataFrame, mode: str = "triage", expected: DataFrame | None = None) -> DataFrame:
    """Gap rows of the eligible errors, plus explicitly named sources that are missing (``expected``)."""
    rows = errors.where(is_eligible(mode))
    if expected is not None:
        fresh = expected.join(rows.select("source", "path").distinct(), ["source", "path"], "left_anti")
        rows = rows.unionByName(fresh, allowMissingColumns=True)
    source = _normal_source(F.col("source"))
    scope_advice = F.lit(_DEFAULT_ADVICE)
    for scope, advice in _ADVICE.items():
        scope_advice = F.when(source.isin(*SCOPES[scope]), advice).otherwise(scope_advice)
    shaped = rows.select(
        "timestamp", source.alias("source"), "path", "operation", "message", "detail",
        coverage_of(F.col("message"), F.col("operation")).alias("coverage_status"), F.lit("high").alias("confidence"),
        F.lit("Q5").alias("evidence_quality"), scope_advice.alias("recommendation"),
    )
    return numbered_ids(shaped, ["timestamp", "source", "path", "operation", "message"], "GAP", "gap_id")


def gap_findings(gaps: DataFrame) -> DataFrame:
    """One informational finding per gap."""
    c = F.col
    token = F.regexp_replace(F.regexp_replace(F.upper(c("source")), r"[^A-Z0-9]", "-"), r"^-+|-+$", "")
    summary = F.concat(
        F.lit("Could not read "), c("source"), F.lit(" ("), c("operation"), F.lit(") at "), display_or(text(c("path")), "unspecified path"),
        F.lit(": "), c("message"), F.lit(". Silence of this source means nothing."),
    )
    return gaps.select(*base_finding(
        10, "evidence_gap", F.concat(F.lit("GAP-"), token, F.lit("-UNAVAILABLE-001")), "Source missing or partly read",
        "evidence_gap", "Q5", "Q5 collection gap: a requested evidence source could not be read", "base_rule_score", summary,
        c("recommendation"), finding_id=F.replace(c("gap_id"), F.lit("GAP-"), F.lit("GAP-F-")), timestamp=c("timestamp"),
        source_file=F.when(text(c("path")) != "", c("path")),
        score_breakdown=assess.breakdown(base_rule_score=10, evidence_gap_discount=-5),
        raw_hash=sha256_hex(F.concat_ws("|", "source", "path", "operation", "message", "timestamp")),
        evidence_chain_level=F.lit("L1"), evidence_chain_basis=F.lit("L1 evidence gap; sources=evidence_gap; related=none"),
    ))


def status_of_statuses(status: Column, present: Column | None = None) -> Column:
    """Aggregate: collected without gaps, unsupported if all are, not_collected if any is, else partial."""
    rows = F.count(F.when(status.isNotNull(), 1)) if present is None else F.sum(present.cast("int"))
    return (
        F.when(rows == 0, "collected").when(F.bool_and(status == "unsupported"), "unsupported")
        .when(F.bool_or(status == "not_collected"), "not_collected").otherwise("partial")
    )


def coverage(gaps: DataFrame, scopes: dict[str, list[str]] | None = None) -> DataFrame:
    """Status and gap count per scope; a scope without gaps is collected."""
    spark = gaps.sparkSession
    pairs = [(scope, source) for scope, sources in (scopes or SCOPES).items() for source in sources]
    table = spark.createDataFrame(pairs, "scope string, source string")
    counted = gaps.groupBy("source", "coverage_status").agg(F.count(F.lit(1)).alias("_n"))
    joined = table.join(counted, "source", "left")
    return joined.groupBy("scope").agg(
        status_of_statuses(F.col("coverage_status")).alias("status"), F.coalesce(F.sum("_n"), F.lit(0)).alias("gaps")
    )
