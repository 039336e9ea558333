"""Application logs: JSON lines and text lines with stack-trace continuation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelight.functions.frames import joined_narrow
from tracelight.functions.text import extract, sha256_hex
from tracelight.functions.times import naive_iso
from tracelight.functions.values import let
from tracelight.operators.splits import carried
from tracelight.schema import APP_EVENT
from tracelight.session import cut_lineage
from tracelight.sources.jsonfields import pick, with_fields
from tracelight.sources.lines import Parsed, finish, parse_cases

REDACTED = ("logger", "exception_type", "message_summary", "request_id", "trace_id", "http_path", "user_summary")
LINES_PER_EVENT = 1000
_LEVEL = r"(?i)(?<![a-z0-9_/=@#])(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)(?![a-z0-9_/=@#])"
_EXCEPTION = r"(?<![A-Za-z_$])([A-Za-z_$][A-Za-z0-9_.$]*(?:Exception|Error|Throwable))"  # tried once per word
_BLANKS = " \t\n\x0b\f\r"


def stamp(value: Column, tz_offset: str) -> Column:
    """Log timestamp with a fraction of three or more digits dropped."""
    trimmed = F.rtrim(F.btrim(F.trim(value), F.lit('"')), F.lit(","))
    no_comma = F.regexp_replace(trimmed, r"^([^,]*),\d{3,}.*$", "$1")
    return naive_iso(F.regexp_replace(no_comma, r"^([^.]*)\.\d{3,}(.*)$", "$1$2"), tz_offset)


def leading_stamp(line: Column, tz_offset: str) -> Column:
    def of_words(words: Column) -> Column:
        first, second = F.get(words, F.lit(0)), F.rtrim(F.get(words, F.lit(1)), F.lit(","))
        return F.when(first.contains("T"), F.rtrim(first, F.lit(","))).otherwise(F.concat(first, F.lit(" "), second))

    # two words are taken off first, so that a long line is not cut up whole
    two = F.split(F.regexp_extract(F.ltrim(line), r"^\S*(?:\s+\S*)?", 0), r"\s+")
    return stamp(F.when(line.rlike(r"^\[[^\]]*\]"), extract(line, r"^\[([^\]]*)\]")).otherwise(let(two, of_words)), tz_offset)


def level(line: Column) -> Column:
    """First log-level word that stands alone."""
    return F.lower(extract(line, _LEVEL))


def exception_type(line: Column) -> Column:
    telling = line.contains("Exception") | line.contains("Error") | line.contains("Throwable")
    return F.when(telling, extract(line, _EXCEPTION))


def value_after(line: Column, *keys: str) -> Column:
    """Value after the first key present that has one; quotes and closing brackets end it. Every key ends with an equals sign."""

    def one(key: str) -> Column:
        raw = F.regexp_extract(line, rf'(?is)^.*?{key}\s*(?:"([^"]*)"?|([^\s,;}}\]"][^\s,;}}\]]*))', 1)
        bare = F.regexp_extract(line, rf'(?is)^.*?{key}\s*(?:"([^"]*)"?|([^\s,;}}\]"][^\s,;}}\]]*))', 2)
        value = F.btrim(F.concat(raw, bare), F.lit("\"':"))
        return F.when(F.lower(line).contains(key.lower()) & (value != ""), value)

    return F.when(line.contains("="), F.coalesce(*[one(k) for k in keys]))


def http_path(line: Column) -> Column:
    from_key = [
        let(value_after(line, key), lambda v: F.when(v.startswith("/"), v))
        for key in ("path=", "uri=", "url=", "http_path=", "request_path=")
    ]
    from_text = extract(line, r"(?i)(?:Internal Server Error:|request(?:ed)? path:)\s*(/[^\s,;]+)")
    telling = let(F.lower(line), lambda v: v.contains("internal server error:") | v.contains(" path:"))
    return F.coalesce(*from_key, F.when(telling, F.btrim(from_text, F.lit('"'))))


def logger(line: Column, level_name: Column) -> Column:
    """Dotted name that follows the upper-case level."""

    def after(tail: Column) -> Column:
        name = F.regexp_extract(tail, r"^\s*(\S+)", 1)
        return F.when(name.contains(".") | name.contains("::"), F.btrim(name, F.lit(":")))

    marker = F.concat(F.lit(" "), F.upper(level_name), F.lit(" "))
    position = F.instr(line, marker)
    tail = F.substring(line, position + F.length(marker), F.length(line))
    return F.when(level_name.isNotNull() & (position > 0), after(tail))


def framework(path: Column, line: Column) -> Column:
    where = F.lower(path)
    has = lambda what, *words: reduce(Column.__or__, [what.contains(w) for w in words])
    from_line = let(F.lower(line), lambda what: (
        F.when(has(what, "spring"), "spring").when(has(what, "django"), "django")
        .when(has(what, "flask", "werkzeug"), "flask").when(has(what, "express", "node.js", "pm2"), "node")
        .when(has(what, "laravel", "php"), "php").when(has(what, "asp.net", "microsoft.aspnetcore"), "aspnet")
    ))
    return (
        F.when(where.rlike(r"spring|application\.log"), "spring").when(where.rlike("django|gunicorn|uwsgi"), "django")
        .when(where.contains("flask"), "flask").when(where.rlike("node|express|pm2"), "node")
        .when(where.rlike("laravel|php"), "php").when(where.rlike("aspnet|stdout"), "aspnet").otherwise(from_line)
    )


def _json_columns(df: DataFrame, tz_offset: str) -> DataFrame:
    staged = with_fields(df, F.col("_text"), fold_case=True)
    m = F.col("_m")
    staged = staged.withColumn("_msg", pick(m, "message", "msg", "error", "detail"))
    return staged.select(
        *df.columns,
        let(pick(m, "@timestamp", "timestamp", "time", "datetime"), lambda s: F.coalesce(stamp(s, tz_offset), s)).alias("timestamp"),
        F.coalesce(pick(m, "framework", "runtime", "service"), framework(F.col("source_file"), F.col("_text"))).alias("framework"),
        F.lower(pick(m, "level", "severity", "loglevel")).alias("level"), pick(m, "logger", "logger_name", "source").alias("logger"),
        F.coalesce(pick(m, "exception_type", "exception", "error_type", "error.kind"), exception_type(F.col("_msg"))).alias("exception_type"),
        F.col("_msg").alias("message_summary"),
        pick(m, "request_id", "requestid", "req_id").alias("request_id"), pick(m, "trace_id", "traceid", "trace").alias("trace_id"),
        pick(m, "http_path", "path", "uri", "url", "request_path").alias("http_path"),
        pick(m, "user", "user_id", "username", "principal").alias("user_summary"),
        F.lit("app_json").alias("parser_name"), F.when(F.size(m) >= 4, 0.86).otherwise(0.72).alias("parse_confidence"),
        F.when(m.isNull(), "application JSON log is not an object").alias("_error"),
    )


def _text_columns(df: DataFrame, tz_offset: str) -> DataFrame:
    line = F.col("_text")
    staged = (
        df.withColumn("timestamp", leading_stamp(line, tz_offset)).withColumn("level", level(line))
        .withColumn("exception_type", exception_type(line)).withColumn("http_path", http_path(line))
    )
    nothing = F.col("timestamp").isNull() & F.col("level").isNull() & F.col("exception_type").isNull() & F.col("http_path").isNull()
    return staged.select(
        *df.columns, "timestamp", framework(F.col("source_file"), line).alias("framework"), "level",
        logger(line, F.col("level")).alias("logger"), "exception_type", line.alias("message_summary"),
        value_after(line, "request_id=", "requestId=", "request-id=", "req_id=").alias("request_id"),
        value_after(line, "trace_id=", "traceId=", "trace-id=", "trace=").alias("trace_id"), "http_path",
        value_after(line, "user=", "user_id=", "username=").alias("user_summary"), F.lit("app_text").alias("parser_name"),
        F.lit(0.72).alias("parse_confidence"),
        F.when(nothing, "line does not look like a supported application log event").alias("_error"),
    )


def parse_app(lines: DataFrame, tz_offset: str = "+00:00", redact_secrets: bool = False) -> Parsed:
    """Application log lines; a line with neither timestamp nor level continues the event before it."""
    staged = lines.withColumn("_text", F.btrim("text", F.lit(_BLANKS)))
    bare = leading_stamp(F.col("text"), tz_offset).isNull() & level(F.col("text")).isNull()
    cases = [
        (F.col("_text").startswith("{"), lambda df: _json_columns(df, tz_offset)), (F.lit(True), lambda df: _text_columns(df, tz_offset)),
    ]
    # written once: folding reads the parsed lines several times
    merged = cut_lineage(parse_cases(staged.withColumn("_bare", bare), "_text", cases, APP_EVENT))
    folded = fold_continuations(merged).withColumn("raw_hash", sha256_hex(F.col("_text")))
    return finish(folded, APP_EVENT, parser=F.lit("app_log"), redacted=REDACTED, redact_secrets=redact_secrets)


def fold_continuations(parsed: DataFrame) -> DataFrame:
    """Append ``_bare`` lines to the message of the last event before them in the same file.

    Needs ``source_file, line_number, _text, _bare, _error, message_summary``. A bare line that has
    no event before it stays an event of its own when it parsed. Nothing is cut: the first
    ``LINES_PER_EVENT`` lines join the head's own event, and each further stretch of as many lines is an
    event of the same head, numbered by its first line, so no message gathers more lines than that.
    """
    alone = F.col("_error").isNull()
    # the first event of a file may itself be a bare line that parsed; it can then own others
    owner = F.when(alone & ~F.col("_bare"), F.col("line_number"))
    first_alone = parsed.where(alone).groupBy("source_file").agg(F.min("line_number").alias("_first_event"))
    # one row per file comes to the lines: a shuffle by file would put all lines of a file into one task
    owned, _ = joined_narrow(carried(parsed, {"_owner": owner}), first_alone, ["source_file"])
    head = F.coalesce("_owner", F.when(F.col("line_number") >= F.col("_first_event"), F.col("_first_event")))
    staged = owned.withColumn("_head", head).withColumn(
        "_joins", F.col("_bare") & F.col("_head").isNotNull() & (F.col("_head") < F.col("line_number"))
    )
    tails = staged.where(F.col("_joins")).select("source_file", "_head", "line_number", "_text")
    extra = stretches(tails, LINES_PER_EVENT).groupBy("source_file", "_head", "_stretch").agg(
        F.min("line_number").alias("_from"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "_text"))), lambda s: s["_text"]), "\n").alias("_extra")
    )
    keys = [F.col("h.source_file") == F.col("e.source_file"), F.col("h.line_number") == F.col("e._head")]
    heads = staged.where(~F.col("_joins")).alias("h").join(extra.alias("e"), keys, "left")
    further = F.coalesce(F.col("e._stretch") > 0, F.lit(False))
    combined = F.when(further, F.col("e._extra")).otherwise(F.concat_ws("\n", "h.message_summary", "e._extra"))
    combined = F.when(F.col("e._extra").isNull(), F.col("h.message_summary")).otherwise(combined)
    names = [c for c in parsed.columns if c not in ("message_summary", "_bare", "line_number")]
    return heads.select(
        *[F.col(f"h.{c}").alias(c) for c in names], F.when(further, F.col("e._from")).otherwise(F.col("h.line_number")).alias("line_number"),
        combined.alias("message_summary"))


def stretches(tails: DataFrame, size: int) -> DataFrame:
    """Numbers the lines of each head in stretches of ``size`` lines."""
    order = W.partitionBy("source_file", "_head").orderBy("line_number")
    return tails.withColumn("_stretch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
