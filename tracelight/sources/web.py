"""Web access logs: common/combined text, JSON lines, IIS W3C."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions.text import sha256_hex, uri_path, uri_query
from tracelight.functions.times import clf_iso, naive_iso
from tracelight.functions.values import dash_to_null, let
from tracelight.operators.ordered import carry_forward
from tracelight.operators.splits import carried, carry_in_splits, in_splits
from tracelight.schema import HTTP_EVENT
from tracelight.sources.jsonfields import pick_text, to_f64, to_u16, to_u64, with_fields
from tracelight.sources.lines import Parsed, finish, parse_cases

REDACTED = ("uri_query", "referer", "user_agent", "host", "xff_ip")
_QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
_COMMON = r"(?s)^\s*(\S+)[^\[]*\[([^\]]*)\][^\"]*" + _QUOTED + r"(.*)$"
_SEP = "\u0001"


def _common_columns(df: DataFrame, tz_offset: str) -> DataFrame:
    """Adds the fields of a common/combined line and ``_error``."""
    parts = F.split(F.regexp_replace("text", _COMMON, _SEP.join(["$1", "$2", "$3", "$4"])), _SEP)
    staged = df.withColumn("_p", parts).withColumn("_ok", F.size("_p") == 4)
    get = lambda i: F.get("_p", F.lit(i))
    staged = staged.withColumn("_req", F.split(F.trim(F.regexp_replace(get(2), r"\s+", " ")), " ")).withColumn(
        "_tail", F.split(F.trim(F.regexp_replace(get(3), r"\s+", " ")), " ")
    ).withColumn("_quoted", F.regexp_extract_all(get(3), F.lit(_QUOTED), F.lit(1)))
    req, count = F.col("_req"), F.size("_req")
    full_line = (
        (count >= 3) & F.get(req, F.lit(0)).rlike(r"^[A-Za-z]{1,16}$") & F.element_at(req, -1).startswith("HTTP/")
    )
    uri = F.when(full_line, F.array_join(F.slice(req, 2, F.greatest(count - 2, F.lit(0))), " ")).otherwise(F.get(req, F.lit(1)))
    error = (
        F.when(~F.col("text").rlike(r"\[[^\]]*\]"), "missing timestamp")
        .when(~F.col("_ok"), "missing quoted request")
        .when(count < 2, "request does not contain method and URI")
    )
    return staged.withColumn("_uri", uri).select(
        *df.columns,
        F.when(F.col("_ok"), F.coalesce(clf_iso(get(1), tz_offset), get(1))).alias("timestamp"),
        get(0).alias("remote_ip"), F.get(req, F.lit(0)).alias("method"),
        uri_path(F.col("_uri")).alias("uri_path"), uri_query(F.col("_uri")).alias("uri_query"),
        to_u16(F.get("_tail", F.lit(0))).alias("status"), to_u64(F.get("_tail", F.lit(1))).alias("bytes_sent"),
        dash_to_null(F.get("_quoted", F.lit(0))).alias("referer"), dash_to_null(F.get("_quoted", F.lit(1))).alias("user_agent"),
        F.lit("common_access").alias("parser_name"), F.lit(0.86).alias("parse_confidence"), error.alias("_error"),
    )


def _json_columns(df: DataFrame, tz_offset: str) -> DataFrame:
    staged = with_fields(df, F.col("text"))
    m = F.col("_m")
    request = pick_text(m, "request", "request_line")
    word = lambda i: F.get(F.split(F.trim(F.regexp_replace(request, r"\s+", " ")), " "), F.lit(i))
    staged = staged.withColumn("_uri", F.coalesce(pick_text(m, "uri", "url", "request_uri", "path"), word(1)))
    staged = staged.withColumn("_method", F.coalesce(pick_text(m, "method", "request_method"), word(0)))
    stamp = pick_text(m, "@timestamp", "timestamp", "time", "ts")
    path = uri_path(F.col("_uri"))
    error = F.when(m.isNull(), "JSON log line is not an object").when(
        F.col("_method").isNull() | path.isNull(), "JSON log did not expose method and URI/path"
    )
    return staged.select(
        *df.columns,
        let(stamp, lambda s: F.coalesce(naive_iso(s, tz_offset), s)).alias("timestamp"),
        pick_text(m, "remote_ip", "client_ip", "ip", "c_ip", "remote_addr").alias("remote_ip"),
        pick_text(m, "xff", "x_forwarded_for", "x-forwarded-for", "x_real_ip", "x-real-ip", "forwarded", "cf_connecting_ip",
                  "cf-connecting-ip", "true_client_ip", "true-client-ip", "x_client_ip", "x-client-ip").alias("xff_ip"),
        F.col("_method").alias("method"), pick_text(m, "scheme", "protocol").alias("scheme"),
        pick_text(m, "host", "http_host").alias("host"), path.alias("uri_path"), uri_query(F.col("_uri")).alias("uri_query"),
        to_u16(pick_text(m, "status", "status_code", "sc_status")).alias("status"),
        to_u64(pick_text(m, "bytes", "bytes_sent", "body_bytes_sent", "sc_bytes")).alias("bytes_sent"),
        pick_text(m, "referer", "referrer", "http_referer").alias("referer"),
        pick_text(m, "user_agent", "user-agent", "http_user_agent", "ua").alias("user_agent"),
        to_f64(pick_text(m, "request_time", "duration", "time_taken")).alias("request_time"),
        pick_text(m, "upstream_status").alias("upstream_status"), to_f64(pick_text(m, "upstream_time")).alias("upstream_time"),
        F.lit("json_access").alias("parser_name"), F.when(F.size(m) >= 4, 0.86).otherwise(0.7).alias("parse_confidence"),
        error.alias("_error"),
    )


def _iis_columns(df: DataFrame, tz_offset: str) -> DataFrame:
    """Expects ``_fields``: the last ``#Fields:`` list at or before the line, lower-cased."""
    staged = df.withColumn("_v", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))
    cell = lambda name: F.get("_v", (F.array_position("_fields", F.lit(name)) - 1).cast("int"))
    value = lambda name: F.when(F.array_contains("_fields", name), cell(name))
    plain = lambda name: dash_to_null(value(name))
    error = F.when(F.col("_fields").isNull(), F.lit("IIS #Fields header was not seen before data line")).when(
        F.size("_v") != F.size("_fields"),
        F.concat(F.lit("IIS row has "), F.size("_v").cast("string"), F.lit(" fields but #Fields declares "), F.size("_fields").cast("string")),
    )
    return staged.select(
        *df.columns,
        naive_iso(F.concat(value("date"), F.lit(" "), value("time")), tz_offset).alias("timestamp"),
        plain("c-ip").alias("remote_ip"), plain("x-forwarded-for").alias("xff_ip"), plain("cs-method").alias("method"),
        plain("cs-host").alias("host"), plain("cs-uri-stem").alias("uri_path"), plain("cs-uri-query").alias("uri_query"),
        to_u16(value("sc-status")).alias("status"), to_u64(value("sc-bytes")).alias("bytes_sent"),
        plain("cs(referer)").alias("referer"), plain("cs(user-agent)").alias("user_agent"),
        (to_f64(value("time-taken")) / 1000.0).alias("request_time"), F.lit("iis_w3c").alias("parser_name"),
        F.lit(0.9).alias("parse_confidence"), error.alias("_error"),
    )


def _done(df: DataFrame, redact_secrets: bool) -> Parsed:
    kept = df if "_line_hash" in df.columns else df.withColumnRenamed("raw_hash", "_line_hash")
    return finish(kept.withColumn("raw_hash", sha256_hex(F.col("text"))), HTTP_EVENT, redacted=REDACTED, redact_secrets=redact_secrets)


def parse_access(lines: DataFrame, tz_offset: str = "+00:00", redact_secrets: bool = False) -> Parsed:
    """Common and combined log format; comment lines are skipped."""
    return _done(_common_columns(lines.where(~F.col("text").startswith("#")), tz_offset), redact_secrets)


def parse_json_access(lines: DataFrame, tz_offset: str = "+00:00", redact_secrets: bool = False) -> Parsed:
    return _done(_json_columns(lines.where(~F.col("text").startswith("#")), tz_offset), redact_secrets)


def _iis_header(text: Column) -> Column:
    names = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"^(#fields:)+", ""), r"\s+", " ")), " ")
    return F.when(text.startswith("#Fields:"), names)


def parse_iis(lines: DataFrame, tz_offset: str = "+00:00", redact_secrets: bool = False) -> Parsed:
    """IIS W3C: each row is read with the last ``#Fields`` header before it in the same file."""
    headed = carried(lines, {"_fields": _iis_header(F.col("text"))})
    return _done(_iis_columns(headed.where(~F.col("text").startswith("#")), tz_offset), redact_secrets)


def with_format(lines: DataFrame) -> DataFrame:
    """Adds ``_format`` per line: iis, json or common.

    A ``u_ex…`` file is IIS throughout. Otherwise the format follows the lines until one has been
    read successfully or 50 lines have passed, and then stays; the first format other than common
    stays at once. Seen per file this is the first such line among the first 49 that precede the
    first readable common line.
    """
    staged = lines.withColumn("_guess", _guess())
    per_file = staged.groupBy("source_file").agg(*[column.alias(n) for n, column in _votes().items()])
    return _by_line(staged.join(per_file, "source_file", "left")).drop("_guess", *_votes())


def _guess() -> Column:
    """What a line by itself looks like."""
    trimmed = F.ltrim(F.col("text"))
    return F.when(trimmed.startswith("#Fields:"), "iis").when(trimmed.startswith("{"), "json").when(
        ~trimmed.startswith("#"), "common"
    )


def _votes() -> dict[str, Column]:
    """Per file: the first line of a special format, the first readable common line, the first line."""
    readable = F.col("_guess").eqNullSafe("common") & F.col("text").rlike(_COMMON)
    first_line = lambda cond: F.min(F.when(cond, F.struct("line_number", "_guess")))
    return {"_special": first_line(F.col("_guess").isin("iis", "json")), "_common": first_line(readable), "_start": F.min("line_number")}


def _by_line(joined: DataFrame) -> DataFrame:
    """Adds ``_format`` from the votes of a line's file."""
    settled = F.when(
        F.col("_special").isNotNull()
        & (F.col("_common").isNull() | (F.col("_special.line_number") < F.col("_common.line_number")))
        & (F.col("_special.line_number") - F.col("_start") < 49),
        F.col("_special._guess"),
    )
    name = F.lower(F.element_at(F.split("source_file", r"[/\\]"), -1))
    by_line = F.when(name.startswith("u_ex"), "iis").when(
        settled.isNotNull() & (F.col("line_number") >= F.col("_special.line_number")), settled
    ).otherwise("common")
    return joined.withColumn("_format", by_line)


def parse_web(lines: DataFrame, tz_offset: str = "+00:00", redact_secrets: bool = False) -> Parsed:
    """Mixed access-log files, each in its detected format."""
    header = {"_fields": _iis_header(F.col("text"))}
    if in_splits(lines):  # header and format of a file come with the rows of its splits, no line moves
        tagged = _by_line(carry_in_splits(lines.withColumn("_guess", _guess()), header, per_file=_votes())).drop("_guess", *_votes())
    else:
        tagged = carry_forward(with_format(lines), "source_file", "line_number", header)
    data = tagged.where(~F.col("text").startswith("#"))
    kind = F.col("_format")
    cases = [
        (kind == "common", lambda df: _common_columns(df, tz_offset)), (kind == "json", lambda df: _json_columns(df, tz_offset)),
        (kind == "iis", lambda df: _iis_columns(df, tz_offset)),
    ]
    return _done(parse_cases(data, "text", cases, HTTP_EVENT), redact_secrets)
