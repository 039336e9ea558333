"""Writing results: JSON lines, guarded CSV, SARIF, source-specific tables, run metrics, manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.functions.text import redact
from tracelight.functions.values import text
from tracelight.rules.model import RuleFile
from tracelight.sinks import committed


def guard_formula(value: Column) -> Column:
    """Prefix a quote where a spreadsheet would run the cell as a formula."""
    return F.when(value.rlike(r"^[=+@\t\r]|^-(?s).+"), F.concat(F.lit("'"), value)).otherwise(value)


def csv_cells(df: DataFrame) -> DataFrame:
    """All columns as guarded text: arrays joined by ``;``, structs as JSON."""

    def cell(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            column = F.array_join(column, ";")
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            column = F.to_json(column)
        return guard_formula(text(column)).alias(field.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    csv_cells(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines that count once the whole job has committed; ``committed.read_jsonl`` reads what was committed."""
    committed.write_jsonl(df, path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


# SARIF level of a severity.
def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One reporting descriptor per rule as JSON; the first finding of a rule describes it."""
    first = findings.groupBy("rule_id").agg(F.min_by(F.struct("rule_name", "recommendation", "category", "source_type"), "finding_id").alias("f"))
    descriptor = F.struct(
        F.col("rule_id").alias("id"), F.col("f.rule_name").alias("name"), F.struct(F.col("f.rule_name").alias("text")).alias("shortDescription"),
        F.struct(F.col("f.recommendation").alias("text")).alias("help"),
        F.struct(F.col("f.category").alias("category"), F.col("f.source_type").alias("sourceType")).alias("properties"))
    return first.select("rule_id", F.to_json(descriptor).alias("descriptor"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One result per finding as JSON; at most ten related locations each."""
    uri = F.replace(F.trim("source_file"), F.lit("\\"), F.lit("/"))
    region = F.when(F.col("line_number") > 0, F.struct(F.col("line_number").alias("startLine")))
    location = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    related = F.transform(F.slice(F.coalesce("related_ids", F.array().cast("array<string>")), 1, 10), lambda r, i: F.struct(
        (i + 1).alias("id"), F.struct(F.struct(F.coalesce(uri, F.lit("unknown")).alias("uri")).alias("artifactLocation")).alias("physicalLocation"),
        F.struct(F.concat(F.lit("Related finding "), r).alias("text")).alias("message")))
    properties = F.struct(
        F.col("finding_id").alias("findingId"), "score", "category", "confidence", F.col("evidence_quality").alias("evidenceQuality"),
        F.col("evidence_quality_basis").alias("evidenceQualityBasis"), F.col("source_type").alias("sourceType"), F.col("raw_hash").alias("rawHash"),
        F.col("evidence_chain_level").alias("evidenceChainLevel"), F.col("evidence_chain_basis").alias("evidenceChainBasis"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("evidence_summary").alias("text")).alias("message"),
        F.when(text(uri) != "", F.array(location)).otherwise(F.array().cast("array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>>")).alias("locations"),
        related.alias("relatedLocations"), properties.alias("properties"))
    return findings.select("finding_id", F.to_json(result).alias("result"))


def write_sarif(findings: DataFrame, path: str, tool: str = "tracelight", version: str = "1.0.0") -> None:
    """SARIF 2.1.0 as text parts: a head with the rules, the results in id order, a tail.

    Results are written by the executors in sorted parts; concatenating the committed parts in their order
    gives one document. The rule list is as long as the rule set.
    """
    head = (
        '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"properties":{"offline":"true",'
        '"interpretation":"Findings are suspicious evidence for manual review, not proof of compromise."},'
        f'"tool":{{"driver":{{"name":"{tool}","semanticVersion":"{version}","rules":['
    )
    rules = sarif_rules(findings).select(F.concat(F.lit("1"), "rule_id").alias("k"), F.col("descriptor").alias("value"))
    results = sarif_results(findings).select(F.concat(F.lit("3"), "finding_id").alias("k"), F.col("result").alias("value"))
    spark = findings.sparkSession
    frame = spark.createDataFrame([("0", head), ("2", ']}},"results":['), ("4", "]}]}")], "k string, value string")
    firsts = rules.agg(F.min("k").alias("k")).unionByName(results.agg(F.min("k").alias("k"))).withColumn("is_first", F.lit(True))
    body = rules.unionByName(results).join(F.broadcast(firsts), "k", "left")  # two rows
    comma = body.select("k", F.when(F.col("is_first"), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    committed.write_lines(frame.unionByName(comma).repartitionByRange("k").sortWithinPartitions("k").select("value"), path)


def suspicious_events(findings: DataFrame, events: DataFrame, source_type: str, event_columns: Iterable[str]) -> DataFrame:
    """Findings of one log kind joined back to their event by line hash; of equal lines the last counts."""
    names = list(event_columns)
    last = events.groupBy("raw_hash").agg(F.max_by(F.struct(*names), F.struct("source_file", "line_number")).alias("e"))
    chosen = findings.where(F.col("source_type") == source_type).select(
        "finding_id", "timestamp", "severity", "score", "category", "rule_id", "evidence_summary", "raw_hash")
    return chosen.join(last, "raw_hash", "left").select("finding_id", "timestamp", "severity", "score", "category", "rule_id", *[F.col(f"e.{n}").alias(n) for n in names], "evidence_summary", "raw_hash")


def error_rows(rejects: DataFrame, redact_secrets: bool = True) -> DataFrame:
    """Parse rejects for publication."""
    return rejects.withColumn("raw_sample", redact(F.col("raw_sample"))) if redact_secrets else rejects


def run_metrics(stages: dict[str, DataFrame]) -> DataFrame:
    """Row count per named stage."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), "rows") for name, df in stages.items()]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total


def rule_manifest(spark: SparkSession, files: Iterable[RuleFile]) -> tuple[DataFrame, DataFrame]:
    """Rule table and per-file checksums with one combined checksum (rules are configuration, not data)."""
    files = list(files)
    rules = [(f.path, r.id, r.category, r.source, r.severity, r.enabled, r.base) for f in files for r in f.rules]
    table = spark.createDataFrame(rules, "path string, rule_id string, category string, source string, severity string, enabled boolean, base int")
    combined = hashlib.sha256("\n".join(f"{f.path}:{f.sha256}" for f in files).encode()).hexdigest()
    sums = spark.createDataFrame([(f.path, f.sha256, len(f.rules)) for f in files], "path string, sha256 string, rules int")
    return table, sums.withColumn("combined_sha256", F.lit(combined))


def rule_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("category", "source", "enabled").agg(F.count(F.lit(1)).alias("rules"))


def evidence_index(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and hash of result files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
