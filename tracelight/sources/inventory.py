"""Inventories, earlier results and feeds: CSV, JSON arrays, JSON lines, plain lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelight.functions.net import cidr_range, ip_key, socket_class
from tracelight.functions.values import contains_any, non_blank, text
from tracelight.operators.ordered import global_index
from tracelight.operators.records import RecordSet, inventory_records
from tracelight.rules.compile import field_name
from tracelight.schema import FINDING
from tracelight.sinks.committed import read_jsonl as read_committed
from tracelight.sources.lines import read_log_lines

# Inventory table, the rule source it feeds, its source type and an extra field.
INVENTORIES = {
    "processes": ("process", "process", None), "network_connections": ("network", "network", None),
    "scheduled_tasks": ("persistence", "persistence", ("persistence_type", "scheduled_task")),
    "startup_items": ("persistence", "persistence", ("persistence_type", "startup_item")),
    "services": ("persistence", "persistence", ("persistence_type", "service")),
    "shell_history": ("shell_history", "shell_history", None), "login_history": ("login_history", "login_history", None),
    "persistence_misc": ("persistence", "persistence_misc", ("persistence_type", "misc")),
    "sudoers": ("sudoers", "sudoers", None), "ssh_keys": ("ssh_keys", "ssh_keys", None),
    "sshd_config": ("sshd_config", "sshd_config", None), "firewall": ("firewall", "firewall", None),
    "deleted_open": ("deleted_open", "deleted_open", None), "suid_file": ("suid_file", "suid_file", None),
    "kernel_params": ("kernel_params", "kernel_params", None), "fs_anomaly": ("fs_anomaly", "fs_anomaly", None),
    "bin_change": ("bin_change", "bin_change", None), "registry_persistence": ("registry_persistence", "registry_persistence", None),
    "wmi_subscription": ("wmi_subscription", "wmi_subscription", None),
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All-text CSV with normalised header names; short rows are padded, cells beyond the header are dropped."""
    raw = spark.read.option("header", True).option("multiLine", False).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(field_name(c)) for c in raw.columns])


def records_of(name: str, table: DataFrame) -> RecordSet:
    """Rule records of an inventory table by its name."""
    source, source_type, extra = INVENTORIES[name]
    rank = 1 + list(INVENTORIES).index(name)
    return inventory_records(table, source, source_type, rank, dict([extra]) if extra else None)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Typed rows and a one-row count of the lines that are not valid JSON."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema).alias("r"), F.from_json("value", "map<string,string>").isNull().alias("bad"))
    return parsed.where(~F.col("bad")).select("r.*"), parsed.agg(F.sum(F.col("bad").cast("int")).alias("malformed"))


def _first(df: DataFrame, *names: str) -> Column:
    """First of the named columns that holds a non-blank value."""
    by_name = {field_name(c): c for c in df.columns}
    present = [non_blank(F.trim(F.col(f"`{by_name[n]}`").cast("string"))) for n in names if n in by_name]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


# Words in a name or command line that mark a web server or its runtime.
WEB_PROCESS_WORDS = ["nginx", "httpd", "apache", "apache2", "php-fpm", "java", "tomcat", "dotnet", "node", "gunicorn", "uwsgi", "daphne", "weblogic", "jboss", "wildfly", "caddy"]


def described_processes(processes: DataFrame) -> DataFrame:
    """A process inventory with ``web_related``, from ``name`` and ``command_line``."""
    return processes.withColumn("web_related", contains_any(F.concat(text(F.col("name")), F.lit(" "), text(F.col("command_line"))), WEB_PROCESS_WORDS))


def described_connections(connections: DataFrame) -> DataFrame:
    """A network inventory with ``remote_class`` of ``remote_address``; NULL where there is none."""
    return connections.withColumn("remote_class", F.when(text(F.col("remote_address")) != "", socket_class(F.col("remote_address"))))


def earlier_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings that an earlier run has written as JSON lines and committed."""
    return read_committed(spark, path, FINDING)


# Accepted indicator type names.
IOC_TYPES = {
    "ip": "ip", "cidr": "cidr", "domain": "domain", "host": "domain", "url": "url_path", "url_path": "url_path", "path": "url_path",
    "hash": "hash", "sha256": "hash", "sha1": "hash", "md5": "hash", "user_agent": "user_agent", "ua": "user_agent",
}
_SCRIPT_EXTENSIONS = "php|php5|php7|phtml|jsp|jspx|asp|aspx|ashx|asmx|war"


def ioc_type(name: Column) -> Column:
    pairs = F.create_map(*[F.lit(v) for pair in IOC_TYPES.items() for v in pair])
    return F.try_element_at(pairs, F.lower(F.trim(name)))


def infer_ioc_type(value: Column) -> Column:
    """Type of an untyped indicator: network, address, hash, path, domain, else user agent."""
    v = F.trim(value)
    return (
        F.when(v.contains("/") & cidr_range(v).isNotNull(), "cidr").when(ip_key(v).isNotNull(), "ip")
        .when(v.rlike(r"^([0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$"), "hash")
        .when(v.startswith("/") | v.rlike(rf"(?i)\.({_SCRIPT_EXTENSIONS})$"), "url_path")
        .when(v.contains(".") & ~v.contains(" "), "domain").otherwise("user_agent")
    )


def _usable(kind: Column, value: Column) -> Column:
    return F.when(kind == "ip", ip_key(value).isNotNull()).when(kind == "cidr", cidr_range(value).isNotNull()).otherwise(F.lit(True))


def shape_iocs(rows: DataFrame, origin: str, strict_type: bool) -> tuple[DataFrame, DataFrame]:
    """Indicators ``seq, indicator_type, value, source, confidence, tags, description`` and load counts.

    ``strict_type``: a table with a type column rejects rows whose type is unknown (CSV); otherwise the
    type is inferred (JSON).
    """
    value = _first(rows, "value", "indicator", "ioc")
    named = _first(rows, "type", "indicator_type")
    has_type = any(field_name(c) in ("type", "indicator_type") for c in rows.columns)
    kind = ioc_type(named) if strict_type and has_type else F.coalesce(ioc_type(named), infer_ioc_type(value))
    shaped = rows.select(
        *(["seq"] if "seq" in rows.columns else []), kind.alias("indicator_type"), value.alias("value"),
        F.coalesce(_first(rows, "source"), F.lit(origin)).alias("source"), F.coalesce(_first(rows, "confidence"), F.lit("medium")).alias("confidence"),
        text(_first(rows, "tags")).alias("tags"), text(_first(rows, "description")).alias("description"),
    )
    good = F.col("value").isNotNull() & F.col("indicator_type").isNotNull() & F.coalesce(_usable(F.col("indicator_type"), F.col("value")), F.lit(False))
    short = (F.col("indicator_type") == "hash") & F.length("value").isin(32, 40)
    counts = shaped.agg(
        F.sum(good.cast("int")).alias("loaded"), F.sum((~F.coalesce(good, F.lit(False))).cast("int")).alias("skipped"),
        F.sum((good & short).cast("int")).alias("short_hashes"),
    )
    kept = shaped.where(good)
    if "seq" not in kept.columns:
        kept = global_index(kept, ["indicator_type", "value", "source"], "seq")
    return kept, counts


def read_ioc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Indicator feed from CSV, JSON array, JSON lines or a plain list."""
    lowered = path.lower()
    if lowered.endswith(".csv"):
        return shape_iocs(read_csv(spark, path), path, strict_type=True)
    if lowered.endswith(".json") or lowered.endswith(".jsonl"):
        return shape_iocs(spark.read.option("multiLine", lowered.endswith(".json")).option("primitivesAsString", True).json(path), path, strict_type=False)
    lines = read_log_lines(spark, path).select("source_file", "line_number", F.trim("text").alias("line")).where(~F.col("line").startswith("#"))
    left, right = F.trim(F.split_part("line", F.lit(","), F.lit(1))), F.trim(F.regexp_replace("line", r"^[^,]*,", ""))
    typed = F.col("line").contains(",") & ioc_type(left).isNotNull()
    # numbered over all files of the feed: equal line numbers of two files are different indicators
    rows = global_index(lines, ["source_file", "line_number"], "seq").select(
        "seq", F.when(typed, right).otherwise(left).alias("value"), F.when(typed, left).alias("type")
    )
    return shape_iocs(rows, path, strict_type=False)


def shape_geoip(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Networks ``network, country, region, city, asn, as_org`` (plus ``file_order``) and the skipped-row count."""
    shaped = rows.select(
        *(["file_order"] if "file_order" in rows.columns else []), _first(rows, "network", "cidr", "ip").alias("network"),
        text(_first(rows, "country", "country_iso")).alias("country"), text(_first(rows, "region", "subdivision")).alias("region"),
        text(_first(rows, "city")).alias("city"), text(_first(rows, "asn")).alias("asn"),
        text(_first(rows, "as_org", "org", "organization")).alias("as_org"),
    )
    good = F.coalesce(cidr_range(F.col("network")).isNotNull(), F.lit(False))
    return shaped.where(good), shaped.agg(F.sum((~good).cast("int")).alias("skipped"))


def read_geoip(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Network table from CSV, JSON array or JSON lines; file order decides between overlapping networks."""
    lowered = path.lower()
    if lowered.endswith(".csv"):
        rows = read_csv(spark, path)
    else:
        rows = spark.read.option("multiLine", lowered.endswith(".json")).option("primitivesAsString", True).json(path)
    # the scan order of several files is not their order: files by name, then the order inside
    placed = rows.withColumn("_file", F.input_file_name()).withColumn("_place", F.monotonically_increasing_id())
    return shape_geoip(global_index(placed, ["_file", "_place"], "file_order"))
