"""Score, severity, evidence quality and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelight.functions.values import holds, let

# Severity order, quality wording, chain level order.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
DECLARED_SEVERITIES = {
    "info": "info", "informational": "info", "low": "low", "medium": "medium", "moderate": "medium",
    "high": "high", "critical": "critical",
}
QUALITY_WORDS = {
    "Q1": "direct evidence", "Q2": "strong correlation evidence", "Q3": "weak correlation evidence",
    "Q4": "environment context", "Q5": "collection gap",
}
BREAKDOWN_PARTS = [
    "base_rule_score", "context_score", "correlation_score", "enrichment_score", "anomaly_score", "runtime_score",
    "host_event_score", "container_score", "evidence_quality_score", "evidence_gap_discount", "allowlist_discount",
    "noise_discount",
]


def severity(score: Column) -> Column:
    return (
        F.when(score < 30, "info").when(score < 50, "low").when(score < 70, "medium").when(score < 90, "high")
        .otherwise("critical")
    )


def severity_rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), name) - 1


def higher_severity(left: Column, right: Column) -> Column:
    """The more severe of two names; NULL loses."""
    return F.when(right.isNull() | (severity_rank(left) >= severity_rank(right)), left).otherwise(right)


def default_quality(source_type: Column) -> Column:
    return (
        F.when(source_type == "evidence_gap", "Q5").when(source_type.isin("ioc", "enrichment"), "Q4").otherwise("Q1")
    )


def quality_words(quality: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for code, words in QUALITY_WORDS.items():
        chain = chain.when(quality == code, words)
    return chain


def confidence(score: Column, quality: Column) -> Column:
    return (
        F.when(quality == "Q5", "high")
        .when(quality == "Q4", F.when(score >= 50, "medium").otherwise("low"))
        .when(quality == "Q3", F.when(score >= 70, "medium").otherwise("low"))
        .when(quality == "Q2", F.when(score >= 50, "high").otherwise("medium"))
        .otherwise(F.when(score >= 90, "high").when(score >= 50, "medium").otherwise("low"))
    )


def is_high_or_critical(category: Column, severity_name: Column, score: Column) -> Column:
    return holds((category != "evidence_gap") & (severity_name.isin("high", "critical") | (score >= 70)))


def breakdown(**parts: Column | int) -> Column:
    """Score breakdown struct with every part present."""
    unknown = set(parts) - set(BREAKDOWN_PARTS)
    if unknown:
        raise ValueError(f"unknown breakdown parts {sorted(unknown)}")
    cell = lambda p: p if isinstance(p, Column) else F.lit(p)
    return F.struct(*[cell(parts.get(name, 0)).cast("short").alias(name) for name in BREAKDOWN_PARTS])


def level_rank(level: Column) -> Column:
    return F.when(level.isin("L2", "L3", "L4", "L5"), F.substring(level, 2, 1).cast("int")).otherwise(1)


def clamp_score(score: Column) -> Column:
    return let(score, lambda s: F.greatest(F.lit(0), F.least(F.lit(100), s))).cast("int")
