"""Database logs: MySQL/MariaDB, PostgreSQL, SQL Server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions.net import first_ipv4
from tracelight.functions.text import double_quoted_after, extract, sha256_hex, single_quoted_after
from tracelight.functions.times import naive_iso
from tracelight.functions.values import let
from tracelight.schema import DB_EVENT
from tracelight.sources.jsonfields import to_f64, to_u64, with_fields
from tracelight.sources.lines import Parsed, finish, parse_cases

REDACTED = ("db_user", "db_name", "statement_summary", "error_code")

# Statement classes in the order they are tested.
STATEMENT_CLASSES = [
    ("auth_failure", ["access denied", "login failed", "password authentication failed", "error: 18456"]),
    ("file_read", ["load_file", "pg_read_file", "pg_ls_dir"]),
    ("file_write", ["into outfile", "into dumpfile"]),
    ("delay", ["sleep(", "benchmark(", "pg_sleep", "waitfor delay"]),
    ("code_execution", ["create function", "install plugin", "xp_cmdshell", "sp_oacreate", "sp_configure", "create extension"]),
    ("privilege_change", ["grant ", "create user", "alter user", "set password", "create role", "alter role",
                          "create login", "alter login", "sp_addsrvrolemember"]),
    ("enumeration", ["information_schema", "mysql.user"]),
    ("linked_server", ["openquery", "opendatasource"]),
    ("query", ["statement:", " query "]),
]


def classify_statement(text: Column) -> Column:
    """One of ten statement classes; the first class with a matching marker wins."""

    def by_marker(lowered: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(""))
        for name, markers in STATEMENT_CLASSES:
            hit = F.lit(False)
            for marker in markers:
                hit = hit | lowered.contains(marker)
            if name == "code_execution":
                hit = hit | (lowered.contains("copy") & lowered.contains("program"))
            if name == "query":
                hit = hit | lowered.rlike(r"^(select|insert|update|delete) ")
            chain = chain.when(hit, name)
        return chain.otherwise("other")

    return let(F.lower(text), by_marker)


def summarise_statement(text: Column) -> Column:
    """Single-spaced whole statement with quoted literals masked."""
    squeezed = F.trim(F.regexp_replace(text, r"\s+", " "))
    masked = F.trim(F.regexp_replace(squeezed, r"'[^']*('|$)", "'?'"))
    return F.when(squeezed != "", masked)


def _leading(df: DataFrame, tz_offset: str) -> DataFrame:
    """Adds ``_ts`` and ``_rest``: the leading timestamp and what follows it."""
    line = F.ltrim(F.regexp_replace("text", r"^\s+", ""))
    token = F.rtrim(F.regexp_extract(line, r"^(\S+)", 1), F.lit(","))
    staged = df.withColumn("_line", line).withColumn("_tok", token)
    staged = staged.withColumn("_iso1", F.when(F.col("_tok").contains("T"), naive_iso(F.col("_tok"), tz_offset)))
    staged = staged.withColumn(
        "_iso2", F.when(F.col("_iso1").isNull(), naive_iso(F.substring("_line", 1, 19), tz_offset))
    )
    rest1 = F.expr("substring(_line, length(_tok) + 1)")
    rest2 = F.regexp_replace(F.expr("substring(_line, 20)"), r"^[\s.0-9]+", "")
    return staged.withColumn("_ts", F.coalesce("_iso1", "_iso2")).withColumn(
        "_rest", F.regexp_replace(F.when(F.col("_iso1").isNotNull(), rest1).otherwise(rest2), r"^\s+", "")
    )


def _json(df: DataFrame, statement_keys: list[str], user_keys: list[str], name_keys: list[str], ip_keys: list[str],
          session_keys: list[str], duration_keys: list[str], severity_keys: list[str], kind: str, tz_offset: str) -> DataFrame:
    staged = with_fields(df, F.col("text"))
    m = F.col("_m")
    first = lambda keys: F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in keys])
    staged = staged.withColumn("_stmt", F.coalesce(first(statement_keys), F.lit("")))
    stamp = naive_iso(first(["timestamp", "time"]), tz_offset)
    statement = F.col("_stmt")
    error = F.when(m.isNull(), "JSON database log is not an object").when(
        stamp.isNull() & (statement == ""), f"JSON {kind} log missing timestamp and statement"
    )
    return staged.select(
        *df.columns, stamp.alias("timestamp"), first(user_keys).alias("db_user"), first(name_keys).alias("db_name"),
        first(ip_keys).alias("client_ip"), first(session_keys).alias("session_id"),
        classify_statement(statement).alias("statement_type"), summarise_statement(statement).alias("statement_summary"),
        to_f64(first(duration_keys)).alias("duration_ms"), to_u64(first(["rows"])).alias("rows"),
        first(severity_keys).alias("severity"), F.lit(0.86).alias("parser_confidence"), error.alias("_error"),
    )


def _mysql_text(df: DataFrame, tz_offset: str) -> DataFrame:
    staged = _leading(df, tz_offset)
    staged = staged.withColumn("_session", extract(F.col("_rest"), r"^(\d+)(?:\s|$)"))
    staged = staged.withColumn(
        "_rest", F.when(F.col("_session").isNotNull(), F.regexp_replace("_rest", r"^\d+\s*", "")).otherwise(F.col("_rest"))
    )
    command = F.lower(extract(F.col("_rest"), r"(?i)^(query|connect|execute|prepare|quit|init|stmt_execute)(?:\s|$)"))
    staged = staged.withColumn("_cmd", command).withColumn(
        "_msg",
        F.when(command.isNotNull(), F.regexp_replace("_rest", r"^\S+\s*", "")).otherwise(F.col("_rest")),
    )
    message = F.col("_msg")
    denied = F.lower(message).contains("access denied")
    classified = classify_statement(message)
    by_command = F.when(classified != "other", classified).when(F.col("_cmd") == "connect", "connection").when(
        F.col("_cmd") == "quit", "disconnect"
    ).otherwise("query")
    return staged.select(
        *df.columns, F.col("_ts").alias("timestamp"), F.when(denied, single_quoted_after(message, "user ")).alias("db_user"),
        first_ipv4(message).alias("client_ip"), F.col("_session").alias("session_id"),
        F.when(denied, "auth_failure").when(F.col("_cmd").isNotNull(), by_command).otherwise(classified).alias("statement_type"),
        summarise_statement(message).alias("statement_summary"), F.when(denied, "warning").alias("severity"),
        F.lit(0.78).alias("parser_confidence"), F.when(F.col("_ts").isNull(), "missing database timestamp").alias("_error"),
    )


def _postgres_text(df: DataFrame, tz_offset: str) -> DataFrame:
    staged = _leading(df, tz_offset)
    staged = staged.withColumn("_rest", F.regexp_replace("_rest", r"^(UTC)*\s*", ""))
    staged = staged.withColumn("_session", extract(F.col("_rest"), r"^\[([^\]]*)\]"))
    staged = staged.withColumn("_rest", F.regexp_replace("_rest", r"^\[[^\]]*\]\s*", ""))
    first, second = (F.regexp_extract("_rest", r"^(\S+)(?:\s+(\S+))?", i) for i in (1, 2))
    staged = staged.withColumn("_first", first).withColumn("_second", second)
    has_user = F.col("_first").contains("@")
    staged = staged.withColumn(
        "_rest", F.when(has_user, F.regexp_replace("_rest", r"^\S+(\s+\S+)?\s*", "")).otherwise(F.col("_rest"))
    )
    level = F.element_at(F.split(F.trim(F.substring_index("_rest", ":", 1)), r"\s+"), -1)
    staged = staged.withColumn("_level", F.when(F.col("_rest").contains(":") & (F.length(level) > 0) & (F.octet_length(level) <= 12), F.lower(level)))
    staged = staged.withColumn(
        "_msg", F.when(F.col("_level").isNotNull(), F.regexp_replace("_rest", r"^[^:]*:\s*", "")).otherwise(F.col("_rest"))
    )
    message = F.col("_msg")
    failed = F.lower(message).contains("password authentication failed")
    statement = F.when(message.contains("statement:"), F.trim(F.regexp_replace(message, r"(?s)^.*?statement:", ""))).otherwise(message)
    staged = staged.withColumn("_stmt", statement)
    user = F.when(has_user, F.substring_index("_first", "@", 1))
    address = F.when(has_user & F.col("_second").rlike(r"^\d*\.\d*\.\d*\.\d*$"), F.col("_second"))
    return staged.select(
        *df.columns, F.col("_ts").alias("timestamp"),
        F.coalesce(user, F.when(failed, double_quoted_after(message, "user "))).alias("db_user"),
        F.when(has_user, F.regexp_extract("_first", r"^[^@]*@(.*)$", 1)).alias("db_name"),
        F.coalesce(address, first_ipv4(message)).alias("client_ip"), F.col("_session").alias("session_id"),
        F.when(failed, "auth_failure").otherwise(classify_statement(F.col("_stmt"))).alias("statement_type"),
        summarise_statement(F.col("_stmt")).alias("statement_summary"),
        F.when(failed, "fatal").otherwise(F.col("_level")).alias("severity"), F.lit(0.8).alias("parser_confidence"),
        F.when(F.col("_ts").isNull(), "missing database timestamp").alias("_error"),
    )


def _mssql_text(df: DataFrame, tz_offset: str) -> DataFrame:
    staged = _leading(df, tz_offset).withColumn("_msg", F.regexp_replace("_rest", r"(?i)^spid\S*\s+", ""))
    message = F.col("_msg")
    failed = F.lower(message).contains("login failed") | F.lower(message).contains("error: 18456")
    client = F.trim(extract(message, r"(?i)\[client:([^\]]*)\]"))
    return staged.select(
        *df.columns, F.col("_ts").alias("timestamp"), F.when(failed, single_quoted_after(message, "user ")).alias("db_user"),
        F.coalesce(client, first_ipv4(message)).alias("client_ip"),
        F.when(failed, "auth_failure").otherwise(classify_statement(message)).alias("statement_type"),
        summarise_statement(message).alias("statement_summary"), F.when(failed, "18456").alias("error_code"),
        F.when(failed, "error").alias("severity"), F.lit(0.8).alias("parser_confidence"),
        F.when(F.col("_ts").isNull(), "missing database timestamp").alias("_error"),
    )


def _dialect(db_type: str | None) -> Column:
    """Dialect per line: the given one, else from the path, else from the line, else auto."""
    if db_type and db_type != "auto":
        return F.lit(db_type)
    path, line = F.lower("source_file"), F.lower("text")
    name = F.element_at(F.split("source_file", r"[/\\]"), -1)
    return (
        F.when(path.contains("postgres") | line.contains("pgaudit"), "postgresql")
        .when(path.contains("mssql") | path.contains("sql server") | (F.lower(name) == "errorlog"), "mssql")
        .when(path.contains("mariadb"), "mariadb")
        .when(path.contains("mysql") | line.contains("mysqld"), "mysql")
        .otherwise("auto")
    )


def parse_db(lines: DataFrame, db_type: str | None = None, tz_offset: str = "+00:00", redact_secrets: bool = False) -> Parsed:
    """Database log lines in any supported dialect.

    For undetermined text the MySQL reading accepts every line with a timestamp, so the other
    dialects could add nothing; undetermined and MariaDB lines are read as MySQL.
    """
    tagged = lines.withColumn("_dialect", _dialect(db_type))
    is_json, dialect = F.ltrim("text").startswith("{"), F.col("_dialect")
    postgres, mssql = dialect == "postgresql", dialect == "mssql"
    cases = [
        (mssql, lambda df: _mssql_text(df, tz_offset)),
        (postgres & is_json, lambda df: _json(
            df, ["statement", "message"], ["user", "username"], ["database", "db"], ["client_ip", "remote_host"], ["session_id"],
            ["duration_ms"], ["level", "severity"], "PostgreSQL", tz_offset)),
        (postgres, lambda df: _postgres_text(df, tz_offset)),
        (is_json, lambda df: _json(
            df, ["statement", "query", "sql", "message"], ["user"], ["db", "database"], ["client_ip", "ip"], ["session_id", "thread_id"],
            ["duration_ms", "query_time_ms"], ["severity"], "database", tz_offset)),
        (F.lit(True), lambda df: _mysql_text(df, tz_offset)),
    ]
    merged = parse_cases(tagged, "text", cases, DB_EVENT)
    named = merged.withColumn("db_type", F.when(F.col("_dialect").isin("postgresql", "mssql"), F.col("_dialect")).otherwise("mysql"))
    return finish(named.withColumn("raw_hash", sha256_hex(F.col("text"))), DB_EVENT, parser="db_log", redacted=REDACTED, redact_secrets=redact_secrets)
