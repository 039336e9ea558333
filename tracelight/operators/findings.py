"""Rule matching, scoring and grouping of hits into findings."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions import assess
from tracelight.functions.times import instant
from tracelight.operators.allowlist import Allowlist
from tracelight.operators.ordered import numbered_ids
from tracelight.operators.records import RecordSet
from tracelight.rules.compile import condition, lookup_in, score_struct
from tracelight.rules.model import Rule
from tracelight.schema import FINDING, conform

_DEFAULT_ADVICE = "Review the source evidence, its surroundings and the host before drawing conclusions."
_HITS = "array<struct<rule_id:string,score:int,base:int,reasons:array<string>,suppressed:boolean>>"
_GROUP = ["rule_id", "_source_file", "_ip", "_path", "_bucket"]


def in_window(timestamp: Column, since: Column | None = None, until: Column | None = None, tz_offset: str = "+00:00") -> Column:
    """Detection window: both bounds inclusive, undated rows kept."""
    at = instant(timestamp, tz_offset)
    keep = F.lit(True)
    if since is not None:
        keep = keep & (at >= since)
    if until is not None:
        keep = keep & (at <= until)
    return at.isNull() | keep


def match_rules(records: RecordSet, rules: Iterable[Rule], allowlist: Allowlist | None = None) -> DataFrame:
    """One row per (record, matching rule) with score, reasons and the suppression flag.

    Only enabled rules of the record set's source are evaluated, all of them in one pass over the data.
    """
    df = records.df
    lookup = lookup_in(df.columns)
    allow = allowlist or Allowlist()
    path = _either(lookup("uri_path"), lookup("path"))
    ip = _either(lookup("remote_ip"), lookup("source_ip"))
    agent = lookup("user_agent")

    def hit(rule: Rule) -> Column:
        matched = condition(rule.match, lookup, records.default_field)
        scored = score_struct(rule, lookup, records.default_field)
        return F.when(matched, scored.withField("suppressed", allow.suppresses(rule.id, path, ip, agent)))

    active = [r for r in rules if r.enabled and r.source.lower() == records.source.lower()]
    hits = F.array_compact(F.array(*[hit(r) for r in active])) if active else F.array().cast(_HITS)
    return df.withColumn("_hit", F.explode(hits)).select(*df.columns, "_hit.*")


def _either(left: Column | None, right: Column | None) -> Column | None:
    present = [c for c in (left, right) if c is not None]
    return F.coalesce(*present) if present else None


def rule_metadata(rules: Iterable[Rule]) -> list[tuple[str, str, str, str | None, str]]:
    return [
        (
            r.id, r.name, r.category, assess.DECLARED_SEVERITIES.get((r.severity or "").strip().lower()),
            r.recommendation or _DEFAULT_ADVICE,
        )
        for r in rules
    ]


def shape_hits(hits: DataFrame) -> DataFrame:
    """Narrow, source-independent form of the hits that grouping needs."""
    have = set(hits.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None).cast("string"))
    status = pick("status")
    return hits.select(
        "rule_id", "score", "base", "reasons", "suppressed", "_source_type", "_source_rank", "_source_file", "_line",
        "_raw_hash",
        pick("timestamp", "started_at", "modified_at", "logon_time").alias("timestamp"),
        pick("remote_ip", "client_ip").alias("remote_ip"), pick("method").alias("method"),
        pick("uri_path", "path", "http_path", "statement_type").alias("uri_path"),
        F.when(status.rlike(r"^\+?\d{1,5}$"), status.cast("int")).alias("status"),
        F.coalesce(pick("time_bucket_5m"), F.col("_line").cast("string"), F.lit("record")).alias("_bucket"),
    )


def group_findings(hits: DataFrame, rules: Iterable[Rule], number: bool = True) -> DataFrame:
    """Unsuppressed hits grouped by rule, file, source, path and five-minute bucket.

    Descriptive fields come from the first record, score and its reasons from the first record with
    the highest score.
    """
    spark = hits.sparkSession
    kept = hits.where(~F.col("suppressed"))
    keyed = kept.withColumn("_ip", F.coalesce("remote_ip", F.lit(""))).withColumn("_path", F.coalesce("uri_path", F.lit("")))
    seq = F.struct("_source_rank", "_line", "_raw_hash")
    better = F.struct(F.col("score").alias("s"), (-F.col("_source_rank")).alias("r"), (-F.col("_line")).alias("l"))
    grouped = keyed.groupBy(*_GROUP).agg(
        F.count(F.lit(1)).alias("match_count"),
        F.min_by(F.struct("timestamp", "remote_ip", "method", "uri_path", "status", "_source_type"), seq).alias("first"),
        F.max_by(F.struct("score", "base", "reasons", "_raw_hash", "_line"), better).alias("best"),
    )
    meta = spark.createDataFrame(
        rule_metadata(rules), "rule_id string, rule_name string, category string, declared string, recommendation string"
    )
    joined = grouped.join(F.broadcast(meta), "rule_id")  # rule configuration, not data
    score, source_type = F.col("best.score"), F.col("first._source_type")
    delta = (score - F.col("best.base")).cast("short")
    quality = assess.default_quality(source_type)
    say = lambda label, column: F.when(column.isNotNull(), F.concat(F.lit(label), column.cast("string"))).otherwise("")
    summary = F.concat(
        F.lit("Rule "), F.col("rule_id"), F.lit(" fired on "), source_type,
        say(" from ", F.col("_source_file")), say(" line ", F.col("best._line")),
        F.when(F.col("match_count") > 1, F.concat(F.lit("; "), F.col("match_count").cast("string"), F.lit(" records in all"))).otherwise(""),
        say("; method ", F.col("first.method")), say("; path ", F.col("first.uri_path")), say("; status ", F.col("first.status")),
        F.when(F.size("best.reasons") > 0, F.concat(F.lit("; weighed by "), F.array_join("best.reasons", "; "))).otherwise(""),
        F.lit(". A lead for an analyst."),
    )
    shaped = joined.select(
        *_GROUP, "match_count", "rule_name", "category", "recommendation",
        F.col("first.timestamp").alias("timestamp"), F.col("first.remote_ip").alias("remote_ip"),
        F.col("first.method").alias("method"), F.col("first.uri_path").alias("uri_path"),
        F.col("first.status").alias("status"), source_type.alias("source_type"), F.col("_source_file").alias("source_file"),
        F.col("best._line").alias("line_number"), F.col("best._raw_hash").alias("raw_hash"), score.alias("score"),
        assess.higher_severity(assess.severity(score), F.col("declared")).alias("severity"),
        quality.alias("evidence_quality"), assess.confidence(score, quality).alias("confidence"),
        F.concat(quality, F.lit(" "), assess.quality_words(quality), F.lit(" from "), source_type, F.lit(" evidence")).alias("evidence_quality_basis"),
        assess.breakdown(
            base_rule_score=F.col("best.base"), context_score=F.greatest(delta, F.lit(0).cast("short")),
            noise_discount=F.least(delta, F.lit(0).cast("short")),
        ).alias("score_breakdown"),
        F.array().cast("array<string>").alias("related_ids"), summary.alias("evidence_summary"),
    )
    if not number:
        return shaped
    return conform(numbered_ids(shaped, _GROUP, "F", "finding_id"), FINDING)


def detect(record_sets: Iterable[RecordSet], rules: Iterable[Rule], allowlist: Allowlist | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings and raw hits (suppressed ones flagged) over several record frames."""
    rules = list(rules)
    hits = reduce(
        DataFrame.unionByName, [shape_hits(match_rules(r, rules, allowlist)) for r in record_sets]
    )
    return group_findings(hits, rules), hits


def base_finding(
    score: Column | int, category: Column | str, rule_id: Column | str, rule_name: Column | str, source_type: str,
    quality: str, quality_basis: str, part: str, summary: Column, recommendation: Column | str, **fields: Column,
) -> list[Column]:
    """Columns of a finding made by a coded detector; unnamed fields stay NULL."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    score = as_column(score).cast("int")
    values: dict[str, Column] = {
        "score": score, "severity": assess.severity(score), "confidence": assess.confidence(score, F.lit(quality)),
        "evidence_quality": F.lit(quality), "evidence_quality_basis": F.lit(quality_basis),
        "score_breakdown": assess.breakdown(**{part: score}), "category": as_column(category),
        "rule_id": as_column(rule_id), "rule_name": as_column(rule_name), "source_type": F.lit(source_type),
        "evidence_summary": summary, "recommendation": as_column(recommendation),
        "related_ids": F.array().cast("array<string>"), **fields,
    }
    return [
        (values[f.name].cast(f.dataType) if f.name in values else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in FINDING.fields
    ]
