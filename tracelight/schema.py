"""Table schemas. Every text column is nullable; only identity columns are required."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from tracelight.functions.assess import BREAKDOWN_PARTS

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "float": T.FloatType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()),
    "breakdown": StructType([T.StructField(p, T.ShortType()) for p in BREAKDOWN_PARTS]),
}


def _schema(columns: str) -> StructType:
    """``name type, …`` without needing a session."""
    pairs = [c.split() for c in columns.split(",")]
    return StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


LINE = _schema(
    "source_file string, line_number bigint, text string, raw_hash string, byte_len bigint, "
    "had_invalid_utf8 boolean, is_long boolean"
)
HTTP_EVENT = _schema(
    "timestamp string, source_file string, line_number bigint, remote_ip string, xff_ip string, "
    "inferred_client_ip string, proxy_ip string, client_ip_source string, method string, scheme string, "
    "host string, uri_path string, uri_query string, status int, bytes_sent bigint, referer string, "
    "user_agent string, request_time double, upstream_status string, upstream_time double, raw_hash string, "
    "parser_name string, parse_confidence float"
)
DB_EVENT = _schema(
    "timestamp string, source_file string, line_number bigint, db_type string, db_instance string, "
    "db_user string, db_name string, client_ip string, client_port int, session_id string, "
    "statement_type string, statement_summary string, duration_ms double, rows bigint, error_code string, "
    "severity string, raw_hash string, parser_confidence float"
)
WAF_EVENT = _schema(
    "timestamp string, source_file string, line_number bigint, vendor string, action string, rule_id string, "
    "rule_name string, client_ip string, proxy_ip string, host string, method string, path string, status int, "
    "score double, raw_hash string, parser_name string, parse_confidence float"
)
APP_EVENT = _schema(
    "timestamp string, source_file string, line_number bigint, framework string, level string, logger string, "
    "exception_type string, message_summary string, request_id string, trace_id string, http_path string, "
    "user_summary string, raw_hash string, parser_name string, parse_confidence float"
)
WINDOWS_EVENT = _schema(
    "event_id string, timestamp string, channel string, provider string, event_code string, computer string, "
    "user string, process_name string, process_id string, parent_process_name string, "
    "command_line_summary string, source_ip string, target_user string, service_name string, task_name string, "
    "object_path string, action string, result string, severity string, raw_hash string, "
    "parser_confidence float, source_file string, line_number bigint"
)
LINUX_EVENT = _schema(
    "event_id string, timestamp string, source string, unit string, user string, uid string, pid string, "
    "ppid string, process_name string, command_line_summary string, cwd string, src_ip string, tty string, "
    "session string, action string, object_path string, result string, raw_hash string, "
    "parser_confidence float, source_file string, line_number bigint"
)
CONTAINER_LOG = _schema(
    "event_id string, timestamp string, runtime string, container_id string, container_name string, "
    "pod_name string, namespace string, stream string, message_summary string, source_file string, "
    "line_number bigint, raw_hash string, parser_confidence float"
)
PARSE_ERROR = _schema(
    "source_file string, line_number bigint, parser_name string, message string, raw_hash string, raw_sample string"
)
COLLECTION_ERROR = _schema(
    "timestamp string, source string, path string, operation string, message string, detail string"
)
FINDING = _schema(
    "finding_id string, timestamp string, severity string, score int, confidence string, "
    "evidence_quality string, evidence_quality_basis string, score_breakdown breakdown, category string, "
    "rule_id string, rule_name string, source_type string, source_file string, line_number bigint, "
    "remote_ip string, method string, uri_path string, status int, evidence_summary string, raw_hash string, "
    "related_ids strings, evidence_chain_level string, evidence_chain_basis string, recommendation string, machine string"
)
# Order in which finding sources are concatenated, i.e. the run order of the detectors.
DETECTION_SOURCES = [
    "http", "process", "network", "scheduled_tasks", "startup_items", "services", "shell_history",
    "login_history", "persistence_misc", "sudoers", "ssh_keys", "sshd_config", "firewall", "deleted_open",
    "suid_file", "kernel_params", "fs_anomaly", "bin_change", "registry_persistence", "wmi_subscription",
    "db", "app", "waf",
]


def conform(df: DataFrame, schema: StructType, extra: tuple[str, ...] = ()) -> DataFrame:
    """Select the schema's columns in order, adding typed NULLs for the missing ones."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ],
        *[c for c in extra if c in have],
    )


def null_of(kind: str) -> Column:
    return F.lit(None).cast(kind)
