"""Comparison with an earlier run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions import assess
from tracelight.functions.values import non_blank, text

LOG_STREAMS = ["access_log", "db_log", "waf_log", "app_log"]
_SEEN_FINDING = " Baseline context: a similar finding existed in the baseline; score reduced, evidence kept."
_SEEN_FILE = " Baseline context: the file existed in the baseline; review only if other evidence changed."


def signature(prefix: str = "") -> Column:
    """Identity of a finding across runs: coarse for log streams, fine for everything else."""
    c = lambda n: text(F.col(prefix + n))
    coarse = F.concat_ws("|", c("rule_id"), c("source_type"), c("source_file"))
    fine = F.concat_ws("|", *[c(n) for n in ("rule_id", "source_type", "remote_ip", "uri_path", "source_file", "raw_hash")])
    return F.when(F.col(prefix + "source_type").isin(*LOG_STREAMS), coarse).otherwise(fine)


def is_file_finding() -> Column:
    return (F.col("source_type") == "file") | F.col("category").isin("webshell_static", "yara_match")


def file_key(digest: Column, path: Column) -> Column:
    """``sha256:<hash>`` when there is one, else ``path:<lower-cased path>``."""
    return F.coalesce(
        F.concat(F.lit("sha256:"), non_blank(digest)),
        F.concat(F.lit("path:"), F.lower(F.replace(non_blank(path), F.lit("\\"), F.lit("/")))),
    )


def known_files(findings: DataFrame, *file_tables: DataFrame) -> DataFrame:
    """File keys an earlier run knew, from its findings and its file tables (``sha256, path``)."""
    keys = findings.where(is_file_finding()).select(file_key(F.col("raw_hash"), F.col("source_file")).alias("key"))
    for table in file_tables:
        keys = keys.unionByName(table.select(file_key(F.col("sha256"), F.col("path")).alias("key")))
    return keys.where(F.col("key").isNotNull()).distinct()


def downrank_repeated(findings: DataFrame, earlier: DataFrame, earlier_files: DataFrame) -> DataFrame:
    """Ten points less for a repeated finding and ten more for a repeated file; nothing is dropped."""
    seen = earlier.select(signature().alias("_sig")).distinct().withColumn("repeated_finding", F.lit(True))
    files = earlier_files.select(F.col("key").alias("_key")).distinct().withColumn("_file", F.lit(True))
    keyed = findings.withColumn("_sig", signature()).withColumn(
        "_key", F.when(is_file_finding(), file_key(F.col("raw_hash"), F.col("source_file")))
    )
    flagged = keyed.join(seen, "_sig", "left").join(files, "_key", "left")
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    flagged = flagged.withColumn("repeated_finding", flag("repeated_finding")).withColumn("repeated_file", flag("_file"))
    hits = F.col("repeated_finding").cast("int") + F.col("repeated_file").cast("int")
    score = F.greatest(F.col("score") - 10 * hits, F.lit(0)).cast("int")
    note = F.concat_ws(
        "; ", non_blank(F.col("evidence_chain_basis")), F.when(F.col("repeated_finding"), "baseline repeated finding"),
        F.when(F.col("repeated_file"), "baseline repeated file"),
    )
    return (
        flagged.withColumn("severity", F.when(hits > 0, assess.severity(score)).otherwise(F.col("severity")))
        .withColumn("evidence_summary", F.concat(
            "evidence_summary", F.when(F.col("repeated_finding"), _SEEN_FINDING).otherwise(""),
            F.when(F.col("repeated_file"), _SEEN_FILE).otherwise("")))
        .withColumn("evidence_chain_basis", F.when(hits > 0, note).otherwise(F.col("evidence_chain_basis")))
        .withColumn("score", score)
        .select(*findings.columns, "repeated_finding", "repeated_file")
    )


def new_values(current: DataFrame, earlier: DataFrame, value: Column, name: str) -> DataFrame:
    """Distinct non-blank values that the earlier run did not have."""
    pick = lambda df: df.select(value.alias(name)).where(F.col(name).isNotNull() & (F.col(name) != "")).distinct()
    return pick(current).join(pick(earlier), name, "left_anti")


def network_target() -> Column:
    return F.when(text(F.col("remote_address")) != "", F.lower(F.concat("remote_address", F.lit(":"), text(F.col("remote_port")))))


def baseline_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """Count per named set of new values."""
    rows = [df.agg(F.count(F.lit(1)).alias("new_values")).select(F.lit(name).alias("kind"), "new_values") for name, df in parts.items()]
    total = rows[0]
    for row in rows[1:]:
        total = total.unionByName(row)
    return total


def component_diff(current: DataFrame, earlier: DataFrame, keys: list[str], digest: str = "sha256") -> DataFrame:
    """Rows of ``current`` whose hash and whose key are both unknown to ``earlier``."""
    known_hashes = earlier.select(digest).where(text(F.col(digest)) != "").distinct()
    identity = F.lower(F.concat_ws("|", *[text(F.col(k)) for k in keys]))
    known_keys = earlier.select(identity.alias("_identity")).distinct()
    fresh = current.join(known_hashes, digest, "left_anti").withColumn("_identity", identity)
    return fresh.join(known_keys, "_identity", "left_anti").drop("_identity")


def hidden_processes(listed: DataFrame, visible: DataFrame, keys: list[str]) -> DataFrame:
    """Processes found by one enumeration and missing from the other."""
    return listed.join(visible.select(*keys).distinct(), keys, "left_anti")


def with_sysfs_flag(modules: DataFrame, sysfs: DataFrame, keys: list[str]) -> DataFrame:
    """Kernel modules with ``in_sysfs``."""
    known = sysfs.select(*keys).distinct().withColumn("_known", F.lit(True))
    return modules.join(known, keys, "left").withColumn("in_sysfs", F.coalesce("_known", F.lit(False))).drop("_known")
