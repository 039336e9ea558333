"""Typed events and inventories as rule records: one text column per rule field plus provenance."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions.text import sha256_hex
from tracelight.functions.times import instant, micros
from tracelight.functions.values import non_blank, text
from tracelight.operators.bands import band_sums
from tracelight.rules.compile import field_name

META = ["_source_type", "_source_rank", "_source_file", "_line", "_raw_hash"]


@dataclass(frozen=True)
class RecordSet:
    """Records of one rule source: the frame, the source its rules name, the field rules read by default."""

    df: DataFrame
    source: str
    default_field: str


WINDOW_FIELDS = [
    "same_ip_request_count_5m", "same_ip_same_path_count_5m", "same_ip_404_count_5m", "same_ip_login_fail_count_5m",
]
FIVE_MINUTES_US = 300_999_999  # a difference cut to whole seconds is at most 300
_LOGIN_WORDS = r"login|signin|auth|admin"
_NO_PATH = "\u0000"


def effective_ip(remote: Column, inferred: Column) -> Column:
    """The inferred client when present, else the logged peer; blanks count as absent."""
    return F.coalesce(non_blank(inferred), non_blank(remote))


def with_window_counts(events: DataFrame, tz_offset: str = "+00:00", chunk: int | None = None) -> DataFrame:
    """Adds the four five-minute counts of each event's source; untimed or sourceless events get 0."""
    keyed = (
        events.withColumn("_ip", effective_ip(F.col("remote_ip"), F.col("inferred_client_ip")))
        .withColumn("_us", micros(instant(F.col("timestamp"), tz_offset)))
        .withColumn("_path", F.coalesce("uri_path", F.lit(_NO_PATH)))
    )
    countable = F.col("_ip").isNotNull() & F.col("_us").isNotNull()
    login_failure = F.col("status").isin(401, 403, 429) & F.lower("uri_path").rlike(_LOGIN_WORDS)
    timed = keyed.where(countable)
    narrow = timed.select(
        "_ip", "_path", "_us", (F.col("status") == 404).cast("int").alias("_nf"), login_failure.cast("int").alias("_lf")
    )
    span = dict(before=FIVE_MINUTES_US, after=FIVE_MINUTES_US, chunk=chunk)
    per_ip = band_sums(
        narrow, ["_ip"], "_us",
        {WINDOW_FIELDS[0]: F.lit(1), WINDOW_FIELDS[2]: F.col("_nf"), WINDOW_FIELDS[3]: F.col("_lf")}, **span,
    )
    per_path = band_sums(narrow, ["_ip", "_path"], "_us", {WINDOW_FIELDS[1]: F.lit(1)}, **span)
    counts = per_path.join(per_ip, ["_ip", "_us"])
    counted = timed.join(counts, ["_ip", "_path", "_us"], "left")
    rest = keyed.where(~F.coalesce(countable, F.lit(False)))
    for name in WINDOW_FIELDS:
        rest = rest.withColumn(name, F.lit(0).cast("long"))
    return counted.unionByName(rest).drop("_ip", "_path", "_us")


def _record(df: DataFrame, rule_source: str, source_type: str, default_field: str, rank: int,
            fields: dict[str, Column], line: Column, raw_hash: Column, source_file: Column) -> RecordSet:
    shaped = df.select(
        F.lit(source_type).alias("_source_type"), F.lit(rank).alias("_source_rank"), source_file.alias("_source_file"), line.cast("long").alias("_line"), raw_hash.alias("_raw_hash"),
        *[F.trim(c.cast("string")).alias(n) for n, c in fields.items()],
    )
    return RecordSet(shaped, rule_source, default_field)


def _plain(names: Iterable[str]) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def _provenance() -> dict[str, Column]:
    return {"line": F.col("line_number"), "raw_hash": F.col("raw_hash"), "source_file": F.col("source_file")}


def _spaced(*columns: Column) -> Column:
    return F.concat_ws(" ", *[text(c) for c in columns])


def http_records(events: DataFrame, tz_offset: str = "+00:00", with_counts: bool = True) -> RecordSet:
    """Access-log events; counts are added unless the frame already carries them."""
    counted = with_window_counts(events, tz_offset) if with_counts and WINDOW_FIELDS[0] not in events.columns else events
    c = F.col
    fields = {
        "timestamp": c("timestamp"), "source_file": c("source_file"), "line_number": c("line_number"),
        "remote_ip": effective_ip(c("remote_ip"), c("inferred_client_ip")), "logged_remote_ip": c("remote_ip"),
        **_plain(["xff_ip", "inferred_client_ip", "proxy_ip", "client_ip_source", "method", "scheme", "host",
                  "uri_path", "uri_query"]),
        "uri": F.concat(text(c("uri_path")), F.when(c("uri_query").isNotNull(), F.concat(F.lit("?"), c("uri_query"))).otherwise("")),
        **_plain(["status", "bytes_sent", "referer", "user_agent", "request_time", "upstream_status", "upstream_time",
                  "parser_name", "raw_hash"]),
        "request": _spaced(c("method"), c("uri_path"), c("uri_query"), c("user_agent")),
        **_plain([n for n in WINDOW_FIELDS if n in counted.columns]),
        "time_bucket_5m": F.floor(micros(instant(c("timestamp"), tz_offset)) / 300_000_000),
    }
    return _record(counted, "http_access", "access_log", "request", 0, fields, **_provenance())


def db_records(events: DataFrame) -> RecordSet:
    c = F.col
    names = ["timestamp", "source_file", "line_number", "db_type", "db_instance", "db_user", "db_name", "client_ip",
             "client_port", "session_id", "statement_type", "statement_summary", "duration_ms", "rows", "error_code",
             "severity", "raw_hash"]
    fields = _plain(names)
    fields["record"] = _spaced(*[c(n) for n in ("db_type", "db_user", "db_name", "client_ip", "statement_type", "statement_summary")])
    fields["remote_ip"] = text(c("client_ip"))
    return _record(events, "db_log", "db_log", "statement_summary", 20, fields, **_provenance())


def app_records(events: DataFrame) -> RecordSet:
    c = F.col
    names = ["timestamp", "source_file", "line_number", "framework", "level", "logger", "exception_type",
             "message_summary", "request_id", "trace_id", "http_path", "user_summary", "raw_hash"]
    fields = _plain(names)
    fields["uri_path"] = c("http_path")
    fields["record"] = _spaced(*[c(n) for n in ("framework", "level", "logger", "exception_type", "message_summary", "http_path")])
    return _record(events, "app_log", "app_log", "message_summary", 21, fields, **_provenance())


def waf_records(events: DataFrame) -> RecordSet:
    c = F.col
    fields = {
        **_plain(["timestamp", "source_file", "line_number", "vendor", "action"]),
        "waf_rule_id": c("rule_id"), "waf_rule_name": c("rule_name"), "client_ip": c("client_ip"),
        "remote_ip": c("client_ip"), **_plain(["proxy_ip", "host", "method", "path"]), "uri_path": c("path"),
        "status": c("status"), "waf_score": c("score"), "raw_hash": c("raw_hash"),
        "record": _spaced(*[c(n) for n in ("vendor", "action", "rule_id", "rule_name", "client_ip", "host", "method", "path")]),
    }
    return _record(events, "waf_log", "waf_log", "record", 22, fields, **_provenance())


# Field copied under a second name when that name is absent.
INVENTORY_ALIASES = {
    "command_line": "command", "executable_path": "path", "remote_address": "remote_ip", "sc_status": "status",
}


def inventory_records(df: DataFrame, rule_source: str, source_type: str, rank: int,
                      extra: dict[str, str] | None = None) -> RecordSet:
    """All-text inventory rows. ``record`` joins the non-blank values in field-name order.

    ``source_file`` and ``line_number`` columns, when present, are provenance and not content.
    """
    own = [c for c in df.columns if c not in ("source_file", "line_number") or rule_source == "sudoers" and c == "source_file"]
    fields: dict[str, Column] = {field_name(c): F.trim(F.col(f"`{c}`").cast("string")) for c in own}
    for key, value in (extra or {}).items():
        fields[field_name(key)] = F.lit(value)
    for original, alias in INVENTORY_ALIASES.items():
        if original in fields and alias not in fields:
            fields[alias] = fields[original]
    record = F.array_join(
        F.filter(F.array(*[fields[n] for n in sorted(fields)]), lambda v: F.coalesce(v, F.lit("")) != ""), " "
    )
    has = set(df.columns)
    source_file = F.col("source_file") if "source_file" in has else F.lit(source_type)
    line = F.col("line_number") if "line_number" in has else F.lit(None).cast("long")
    shaped = df.withColumn("_record", record).where(F.col("_record") != "")
    fields["record"] = F.col("_record")
    fields.setdefault("source_file", source_file)
    fields["line_number"] = line
    return _record(
        shaped, rule_source, source_type, "record", rank, fields, line, sha256_hex(F.col("_record")), source_file
    )


def record_map(records: RecordSet) -> DataFrame:
    """Generic view: provenance plus one string map of the fields that are present."""
    names = [c for c in records.df.columns if c not in META]
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`") for n in names]))
    return records.df.select(
        F.lit(records.source).alias("rule_source"), F.lit(records.default_field).alias("default_field"), *META,
        F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("fields"),
    )
