"""Queries that render logs and files from the tables, read them back and compare with the source columns."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.functions import text as X
from tracelight.functions.net import canonical_ip, classify_ip, first_ipv4, is_placeholder_ip
from tracelight.operators.records import inventory_records, record_map
from tracelight.plans.registry import WEB_SQL, clf_line, query, table, web_view
from tracelight.sources import app, binary, containers, database, host_config, host_events, inventory, waf, web, webconfig
from tracelight.sources.lines import lines_from

_EVENT = "line_number"
NOW = datetime(1970, 3, 1, tzinfo=timezone.utc)  # the derived clock runs in early 1970
_HTTP = ["timestamp", "remote_ip", "method", "uri_path", "uri_query", "status", "bytes_sent", "user_agent"]
_HTTP_SQL = ("event_id, stamp AS timestamp, ip AS remote_ip, method, path AS uri_path, query AS uri_query, status, bytes AS bytes_sent, agent AS user_agent")


def _lines(view: DataFrame, text: Column, file: Column | str = "derived.log") -> DataFrame:
    return lines_from(view, text, file, F.col("event_id"))


def _day_time() -> Column:
    return F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd HH:mm:ss")


def _s(name: str) -> Column:
    return F.col(name).cast("string")


@query("access_log_roundtrip", "SRC-01 SRC-03 FN-01 FN-02 FN-08 FN-09", f"WITH {WEB_SQL} SELECT {_HTTP_SQL} FROM web")
def access_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = web_view(spark, sf_dir)
    events = web.parse_access(_lines(view, clf_line(), F.col("file"))).events
    return events.select(F.col(_EVENT).alias("event_id"), *_HTTP)


def _json_line() -> Column:
    uri = F.concat("path", F.when(F.col("query").isNotNull(), F.concat(F.lit("?"), F.col("query"))).otherwise(""))
    return F.to_json(F.struct(
        F.col("stamp").alias("@timestamp"), F.col("ip").alias("client_ip"), F.col("method").alias("request_method"), uri.alias("url"),
        F.col("status").alias("sc_status"), F.col("bytes").alias("body_bytes_sent"), F.col("agent").alias("ua"), F.lit("-").alias("referer")))


@query("json_access_roundtrip", "SRC-04", f"WITH {WEB_SQL} SELECT {_HTTP_SQL} FROM web")
def json_access_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = web.parse_json_access(_lines(web_view(spark, sf_dir), _json_line())).events
    return events.select(F.col(_EVENT).alias("event_id"), *_HTTP)


@query("json_props", "SRC-04", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelight.sources.jsonfields import pick, to_u64, with_fields

    staged = with_fields(table(spark, sf_dir, "events"), F.col("props"))
    return staged.select("event_id", to_u64(pick(F.col("_m"), "k")).alias("k"))


_IIS_A = "#Fields: date time c-ip cs-method cs-uri-stem cs-uri-query sc-status sc-bytes cs(User-Agent)"
_IIS_B = "#Fields: time date cs-method c-ip cs-uri-stem cs-uri-query sc-bytes sc-status cs(User-Agent)"


def _iis_lines(view: DataFrame, file: Column, switch: int) -> DataFrame:
    """Two headers per file: the column order changes at line ``switch``."""
    q = F.coalesce("query", F.lit("-"))
    day, time = F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd"), F.date_format(F.timestamp_seconds("sec"), "HH:mm:ss")
    row_a = F.concat_ws(" ", day, time, "ip", "method", "path", q, _s("status"), _s("bytes"), "agent")
    row_b = F.concat_ws(" ", time, day, "method", "ip", "path", q, _s("bytes"), _s("status"), "agent")
    row = F.when(F.col("event_id") < switch, row_a).otherwise(row_b)
    row = F.when(F.col("event_id") % 97 == 0, F.concat(row, F.lit(" extra"))).otherwise(row)
    data = view.select(file.alias("source_file"), (F.col("event_id") * 2 + 1).alias("n"), row.alias("value"))
    files = view.select(file.alias("source_file")).distinct()
    heads = files.select("source_file", F.lit(0).alias("n"), F.lit(_IIS_A).alias("value")).unionByName(
        files.select("source_file", F.lit(switch * 2).alias("n"), F.lit(_IIS_B).alias("value")))
    both = data.unionByName(heads)
    return lines_from(both, F.col("value"), F.col("source_file"), F.col("n"))


@query("iis_roundtrip", "SRC-05 WIN-07", f"""
WITH {WEB_SQL} SELECT {_HTTP_SQL}, 'ok' AS outcome FROM web WHERE event_id % 97 <> 0
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'IIS row has 10 fields but #Fields declares 9' FROM web WHERE event_id % 97 = 0""")
def iis_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.concat(F.lit("u_ex"), (F.col("event_id") % 4).cast("string"), F.lit(".log"))
    parsed = web.parse_iis(_iis_lines(web_view(spark, sf_dir), file, 5000))
    event = ((F.col("line_number") - 1) / 2).cast("bigint").alias("event_id")
    good = parsed.events.select(event, *_HTTP, F.lit("ok").alias("outcome"))
    return good.unionByName(parsed.rejects.select(event, F.col("message").alias("outcome")), allowMissingColumns=True)


@query("mixed_formats", "SRC-06", f"WITH {WEB_SQL} SELECT {_HTTP_SQL} FROM web WHERE event_id % 97 <> 0 OR event_id % 4 <> 2")
def mixed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in three formats side by side; each is detected from its first lines."""
    view = web_view(spark, sf_dir)
    kind = F.col("event_id") % 4
    number = F.col("event_id") * 2 + 1
    common = lines_from(view.where(kind.isin(0, 3)), clf_line(), F.concat(F.lit("mix-"), kind.cast("string"), F.lit(".log")), number.alias("n"))
    as_json = lines_from(view.where(kind == 1), _json_line(), "mix-1.json", number.alias("n"))
    iis = _iis_lines(view.where(kind == 2), F.lit("u_ex2.log"), 5000)
    events = web.parse_web(common.unionByName(as_json).unionByName(iis)).events
    return events.select(((F.col("line_number") - 1) / 2).cast("bigint").alias("event_id"), *_HTTP)


@query("db_log_roundtrip", "SRC-07 SRC-08 SRC-09 SRC-10 PRJ-04 PRJ-05 FN-11 FN-12", f"""
WITH {WEB_SQL}
SELECT event_id, stamp AS timestamp,
  CASE event_id % 4 WHEN 0 THEN 'mysql' WHEN 1 THEN 'postgresql' WHEN 2 THEN 'mssql' ELSE 'mysql' END AS db_type,
  CASE event_id % 4 WHEN 1 THEN 'u' || user_id WHEN 2 THEN 'u' || user_id WHEN 3 THEN 'j' || user_id END AS db_user,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 3 THEN NULL ELSE ip END AS client_ip,
  CASE event_id % 4 WHEN 0 THEN 'query' WHEN 1 THEN 'privilege_change' WHEN 2 THEN 'auth_failure' ELSE 'file_write' END AS statement_type,
  CASE event_id % 4 WHEN 0 THEN 'SELECT a FROM t WHERE b = ''?'' AND c = 1' WHEN 1 THEN 'GRANT ALL ON x TO u' || user_id
    WHEN 2 THEN 'Login failed for user ''?''. [CLIENT: ' || ip || ']' ELSE 'select 1 into outfile ''?''' END AS statement_summary,
  CASE event_id % 4 WHEN 1 THEN 'log' WHEN 2 THEN 'error' END AS severity
FROM web""")
def db_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = web_view(spark, sf_dir)
    user, kind = _s("user_id"), F.col("event_id") % 4
    mysql = F.concat(F.col("stamp"), F.lit(" "), user, F.lit(" Query SELECT a   FROM t WHERE b = 'secret"), _s("event_id"), F.lit("' AND c = 1"))
    postgres = F.concat(_day_time(), F.lit(" UTC u"), user, F.lit("@shop "), F.col("ip"), F.lit(" LOG:  statement: GRANT ALL ON x TO u"), user)
    mssql = F.concat(_day_time(), F.lit(".42 spid51      Login failed for user 'u"), user, F.lit("'. [CLIENT: "), F.col("ip"), F.lit("]"))
    as_json = F.to_json(F.struct(F.col("stamp").alias("time"), F.concat(F.lit("j"), user).alias("user"), F.lit("select 1 into outfile '/tmp/x'").alias("sql")))
    line = F.when(kind == 0, mysql).when(kind == 1, postgres).when(kind == 2, mssql).otherwise(as_json)
    file = F.when(kind == 1, "postgresql.log").when(kind == 2, "/var/opt/ERRORLOG").otherwise("mysql-general.log")
    events = database.parse_db(_lines(view, line, file)).events
    return events.select(F.col(_EVENT).alias("event_id"), "timestamp", "db_type", "db_user", "client_ip", "statement_type", "statement_summary", "severity")


@query("waf_log_roundtrip", "SRC-11 SRC-12 SRC-13 PRJ-08", f"""
WITH {WEB_SQL}
SELECT event_id, CASE WHEN event_id % 3 = 1 THEN NULL ELSE stamp END AS timestamp,
  CASE event_id % 3 WHEN 0 THEN 'edge' WHEN 1 THEN 'modsecurity' ELSE 'cloudflare' END AS vendor,
  CASE event_id % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'block' ELSE 'challenge' END AS action,
  CAST(event_id AS VARCHAR) AS rule_id, 'attack number ' || event_id AS rule_name, ip AS client_ip, path, status,
  CASE event_id % 3 WHEN 2 THEN CAST(event_id % 100 AS DOUBLE) END AS score FROM web""")
def waf_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = web_view(spark, sf_dir)
    kind, event = F.col("event_id") % 3, _s("event_id")
    name = F.concat(F.lit("attack number "), event)
    as_json = F.to_json(F.struct(
        F.col("stamp").alias("Timestamp"), F.lit("edge").alias("vendor"), F.lit("DENY").alias("waf_action"), F.col("event_id").alias("RuleID"),
        name.alias("message"), F.col("ip").alias("ClientIP"), F.col("path").alias("request_uri"), F.col("status").alias("EdgeResponseStatus")))
    bracket = F.format_string('[Thu Feb 02 1970] ModSecurity: Access denied [id "%s"] [msg "%s"] [client "%s"] [uri "%s"] [status "%d"]',
                              event, name, "ip", "path", "status")
    pairs = F.format_string('time=%s action=captcha rule="%s" rule-name=\'%s\' src_ip=%s uri=%s status=%d score=%d',
                            "stamp", event, name, "ip", "path", "status", F.col("event_id") % 100)
    pairs = F.replace(pairs, F.lit("rule-name"), F.lit("rule_name"))
    line = F.when(kind == 0, as_json).when(kind == 1, bracket).otherwise(pairs)
    events = waf.parse_waf(_lines(view, line, "/logs/cloudflare/waf.log")).events
    return events.select(F.col(_EVENT).alias("event_id"), "timestamp", "vendor", "action", "rule_id", "rule_name", "client_ip", "path", "status", "score")


@query("kv_log_roundtrip", "SRC-13", f"""
WITH {WEB_SQL} SELECT event_id, ip AS client_ip, method, path, agent || ' extra words' AS rule_name FROM web""")
def kv_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = web_view(spark, sf_dir)
    line = F.format_string('client-ip="%s" method=%s path="%s" rule.name=\'%s extra words\' event=%d', "ip", "method", "path", "agent", "event_id")
    staged = view.select("event_id", waf.key_values(line).alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    return staged.select(get("event").cast("bigint").alias("event_id"), get("client_ip").alias("client_ip"), get("method").alias("method"),
                         get("path").alias("path"), get("rule_name").alias("rule_name"))


@query("app_log_roundtrip", "SRC-14 SRC-15 PRJ-09", f"""
WITH {WEB_SQL}
SELECT event_id, stamp AS timestamp, CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'warning' END AS level,
  CASE WHEN event_id % 2 = 0 THEN 'java.lang.IllegalStateException' ELSE 'TimeoutError' END AS exception_type,
  CASE WHEN event_id % 2 = 0 THEN 'spring' ELSE 'shop-api' END AS framework,
  CASE WHEN event_id % 2 = 0 THEN 'com.acme.Login' END AS logger, path AS http_path, 't' || event_id AS trace_id,
  CASE WHEN event_id % 2 = 0 THEN 'u' || user_id ELSE CAST(user_id AS VARCHAR) END AS user_summary FROM web""")
def app_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = web_view(spark, sf_dir)
    plain = F.format_string("%s,123 ERROR com.acme.Login java.lang.IllegalStateException: bad state path=%s user=u%d trace_id=t%d; spring boot",
                            _day_time(), "path", "user_id", "event_id")
    as_json = F.to_json(F.struct(
        F.concat(F.regexp_replace("stamp", "Z$", ""), F.lit(".123Z")).alias("time"), F.lit("WARNING").alias("severity"), F.lit("shop-api").alias("service"),
        F.lit("TimeoutError: upstream").alias("msg"), F.col("path").alias("url"), F.concat(F.lit("t"), _s("event_id")).alias("traceId"), F.col("user_id")))
    events = app.parse_app(_lines(view, F.when(F.col("event_id") % 2 == 0, plain).otherwise(as_json), F.lit("server-7.log"))).events
    return events.select(F.col(_EVENT).alias("event_id"), "timestamp", "level", "exception_type", "framework", "logger", "http_path", "trace_id", "user_summary")


_JOINED_SQL = "regexp_replace(text, '[ \\t\\n\\r\\f]+', '_', 'g')"  # no blanks, so that no word stands alone as a level


@query("multiline_merge", "SRC-16 WIN-07", f"""
WITH t AS (SELECT conv_id, turn, {_JOINED_SQL} AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, '1970-02-02 00:00:00 ERROR conversation ' || conv_id || coalesce(string_agg(chr(10) || 'at ' || body || ';', '' ORDER BY turn) FILTER (n > 1), '') AS message
FROM t GROUP BY conv_id""")
def multiline_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as one event: the first is a dated line, the others continue it."""
    from pyspark.sql import Window as W

    talk = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    body = F.concat(F.regexp_replace("text", r"[ \t\n\r\f]+", "_"), F.lit(";"))
    line = F.when(F.col("n") == 1, F.concat(F.lit("1970-02-02 00:00:00 ERROR conversation "), _s("conv_id"))).otherwise(F.concat(F.lit("at "), body))
    file = F.concat(F.lit("talk-"), (F.col("conv_id") % 7).cast("string"), F.lit(".log"))
    lines = lines_from(talk, line, file, F.col("conv_id") * 1000 + F.col("n"))
    events = app.parse_app(lines).events
    return events.select(F.floor(F.col("line_number") / 1000).cast("bigint").alias("conv_id"), F.col("message_summary").alias("message"))


@query("audit_roundtrip", "SRC-17 SRC-18 FN-02 FN-16", f"""
WITH {WEB_SQL}
SELECT event_id, stamp AS timestamp,
  CASE event_id % 4 WHEN 0 THEN 'execve' WHEN 1 THEN 'login_failed' WHEN 2 THEN 'sudo' ELSE 'service_started' END AS action,
  CASE event_id % 4 WHEN 0 THEN 'www-data' WHEN 1 THEN 'u' || user_id WHEN 2 THEN 'u' || user_id END AS user,
  CASE event_id % 4 WHEN 1 THEN ip END AS src_ip,
  CASE event_id % 4 WHEN 0 THEN 'cat /etc/passwd 2026' WHEN 2 THEN '/bin/cat /item/' || event_id END AS command,
  CASE event_id % 4 WHEN 3 THEN 'unit' || event_id || '.service' END AS unit,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'failure' WHEN 2 THEN 'success' END AS result
FROM web""")
def audit_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = web_view(spark, sf_dir)
    kind = F.col("event_id") % 4
    sys = F.date_format(F.timestamp_seconds("sec"), "MMM dd HH:mm:ss")
    audit = F.format_string('type=EXECVE msg=audit(%d.123:%d): argc=3 uid=33 a0="cat" a1=2f6574632f706173737764 a2=2026', "sec", "event_id")
    failed = F.format_string("%s web01 sshd[77]: Failed password for invalid user u%d from %s port 22 ssh2", sys, "user_id", "ip")
    sudo = F.format_string("%s web01 sudo:    u%d : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/cat /item/%d", sys, "user_id", "event_id")
    unit = F.format_string("%s web01 systemd[1]: Started unit%d.service.", sys, "event_id")
    line = F.when(kind == 0, audit).when(kind == 1, failed).when(kind == 2, sudo).otherwise(unit)
    events = host_events.parse_audit(_lines(view, line), NOW).events
    return events.select(F.col(_EVENT).alias("event_id"), "timestamp", "action", "user", "src_ip", F.col("command_line_summary").alias("command"), "unit", "result")


@query("journald_roundtrip", "SRC-19", f"""
WITH {WEB_SQL}
SELECT event_id, stamp AS timestamp, CASE WHEN event_id % 2 = 0 THEN 'nginx.service' ELSE 'cron.service' END AS unit,
  CASE WHEN event_id % 2 = 0 THEN 'uid=' || user_id END AS user, 'service_started' AS action,
  CASE WHEN event_id % 2 = 0 THEN 'nginx' ELSE substr(stamp, 12, 2) END AS process_name FROM web""")
def journald_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = web_view(spark, sf_dir)
    as_json = F.to_json(F.struct(
        (F.col("sec") * 1_000_000).cast("string").alias("__REALTIME_TIMESTAMP"), F.lit("Started nginx").alias("MESSAGE"), F.lit("nginx.service").alias("_SYSTEMD_UNIT"),
        _s("user_id").alias("_UID"), F.lit("nginx").alias("_COMM")))
    plain = F.concat(F.date_format(F.timestamp_seconds("sec"), "MMM dd HH:mm:ss"), F.lit(" web01 systemd[1]: Started cron.service."))
    events = host_events.parse_journald(_lines(view, F.when(F.col("event_id") % 2 == 0, as_json).otherwise(plain)), NOW).events
    user = F.when(F.col("user") == "www-data", "uid=33").when(F.col("user") == "apache", "uid=48").otherwise(F.col("user"))
    return events.select(F.col(_EVENT).alias("event_id"), "timestamp", "unit", user.alias("user"), "action", "process_name")


_WIN_SQL = f"""
WITH {WEB_SQL}
SELECT event_id, stamp AS timestamp, CASE WHEN event_type = 'error' THEN '4625' WHEN event_type = 'signup' THEN '4624' ELSE '4688' END AS event_code,
  CASE WHEN event_type = 'error' THEN 'logon_failure' WHEN event_type = 'signup' THEN 'logon_success' ELSE 'process_create' END AS action,
  CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'signup' THEN 'success' END AS result,
  ip AS source_ip, 'u<' || user_id || '>' AS target_user, 'C:\\Windows\\cmd.exe' AS process_name, 'cmd /c "dir & echo ' || event_id || '"' AS command,
  'Security' AS channel, 'Provider-A' AS provider FROM web"""


def _code() -> Column:
    kind = F.col("event_type")
    return F.when(kind == "error", "4625").when(kind == "signup", "4624").otherwise("4688")


def _windows_columns(events: DataFrame) -> DataFrame:
    return events.select(F.col(_EVENT).alias("event_id"), "timestamp", "event_code", "action", "result", "source_ip", "target_user", "process_name",
                         F.col("command_line_summary").alias("command"), "channel", "provider")


def windows_block() -> Column:
    """One event in XML, up to its end tag."""
    return F.format_string(
        '<Event xmlns="x"><System><Provider Name="Provider-A"/><EventID>%s</EventID><TimeCreated SystemTime="%s"/><Channel>Security</Channel></System>'
        '<EventData><Data Name="IpAddress">%s</Data><Data Name="TargetUserName">u&lt;%d&gt;</Data><Data Name="NewProcessName">C:\\Windows\\cmd.exe</Data>'
        '<Data Name="CommandLine">cmd /c &quot;dir &amp; echo %d&quot;</Data></EventData>', _code(), "stamp", "ip", "user_id", "event_id")


@query("windows_xml_roundtrip", "SRC-20 FN-19 PRJ-07", _WIN_SQL)
def windows_xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    view, block = web_view(spark, sf_dir), windows_block()
    records = view.select(F.lit("security.xml").alias("source_file"), block.alias("value"), F.col("event_id").alias("start_line"))
    return _windows_columns(host_events.parse_windows_xml(records).events)


@query("windows_json_roundtrip", "SRC-21 PRJ-07", _WIN_SQL)
def windows_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = web_view(spark, sf_dir)
    pair = lambda name, value: F.struct(F.lit(name).alias("@Name"), value.alias("#text"))
    target = F.concat(F.lit("u<"), _s("user_id"), F.lit(">"))
    command = F.concat(F.lit('cmd /c "dir & echo '), _s("event_id"), F.lit('"'))
    nested = F.to_json(F.struct(
        F.struct(F.struct(F.lit("Provider-A").alias("Name")).alias("Provider"), _code().alias("EventID"), F.struct(F.col("stamp").alias("SystemTime")).alias("TimeCreated"),
                 F.lit("Security").alias("Channel")).alias("System"),
        F.struct(F.array(pair("IpAddress", F.col("ip")), pair("TargetUserName", target), pair("NewProcessName", F.lit("C:\\Windows\\cmd.exe")), pair("CommandLine", command)).alias("Data")).alias("EventData")))
    flat = F.to_json(F.struct(
        F.lit("Provider-A").alias("ProviderName"), _code().cast("int").alias("Id"), F.col("stamp").alias("TimeCreated"), F.lit("Security").alias("LogName"),
        F.col("ip").alias("IpAddress"), target.alias("TargetUserName"), F.lit("C:\\Windows\\cmd.exe").alias("NewProcessName"), command.alias("CommandLine")))
    lines = _lines(view, F.when(F.col("event_id") % 2 == 0, nested).otherwise(flat))
    return _windows_columns(host_events.parse_windows_json(lines).events)


@query("container_log_roundtrip", "SRC-22", f"""
WITH {WEB_SQL}
SELECT event_id, stamp AS timestamp, CASE WHEN event_id % 2 = 0 THEN 'c' || user_id END AS container_id, CASE WHEN event_id % 2 = 0 THEN 'pod-' || user_id END AS pod_name,
  CASE WHEN event_id % 2 = 0 THEN 'GET ' || path ELSE stamp || ' plain ' || path END AS message FROM web""")
def container_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = web_view(spark, sf_dir)
    as_json = F.to_json(F.struct(F.col("stamp").alias("time"), F.concat(F.lit("c"), _s("user_id")).alias("containerID"),
                                 F.struct(F.concat(F.lit("pod-"), _s("user_id")).alias("pod_name")).alias("kubernetes"), F.concat(F.lit("GET   "), "path").alias("log")))
    plain = F.concat("stamp", F.lit("  plain "), "path")
    events = host_events.parse_container_log(_lines(view, F.when(F.col("event_id") % 2 == 0, as_json).otherwise(plain)), "docker").events
    return events.select(F.col(_EVENT).alias("event_id"), "timestamp", "container_id", "pod_name", F.col("message_summary").alias("message"))


@query("inventory_record_text", "SRC-23 PRJ-03", """
SELECT s_suppkey, s_name || ' ' || CAST(s_nationkey AS VARCHAR) || ' ' || s_name || ' ' || CAST(s_suppkey AS VARCHAR) AS record,
  sha256(s_name || ' ' || CAST(s_nationkey AS VARCHAR) || ' ' || s_name || ' ' || CAST(s_suppkey AS VARCHAR)) AS raw_hash FROM supplier""")
def inventory_record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``command_line`` also appears as ``command``; values follow the order of the field names."""
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("Command-Line"), F.col("s_nationkey").alias("command nation"), F.lit(" ").alias("empty"), F.col("s_suppkey").alias("pid"))
    records = record_map(inventory_records(rows, "process", "process", 1))
    # names in order: command, command_line, command_nation, pid
    return records.select(F.col("fields")["pid"].cast("bigint").alias("s_suppkey"), F.concat_ws(
        " ", F.col("fields")["command"], F.col("fields")["command_nation"], F.col("fields")["command_line"], F.col("fields")["pid"]).alias("record"),
        F.sha2(F.concat_ws(" ", F.col("fields")["command"], F.col("fields")["command_nation"], F.col("fields")["command_line"], F.col("fields")["pid"]), 256).alias("raw_hash"))


def _redact_sql(expr: str) -> str:
    for marker in X.SECRET_MARKERS:
        expr = f"regexp_replace({expr}, '(?i)({marker}[ \\t]*)[^&;,\"''\\r\\n ]+', '\\1<redacted>', 'g')"
    return expr


@query("redacted_text", "PRJ-06", f"""
WITH {WEB_SQL}, l AS (SELECT event_id, 'user=' || user_id || '&Token=' || event_id || 'x; Authorization: Basic' || user_id || ' cookie=a' || event_id || ',password: "p' || event_id || '" end' AS line FROM web)
SELECT event_id, {_redact_sql('line')} AS line FROM l UNION ALL SELECT -doc_id - 1, {_redact_sql('text')} FROM documents""")
def redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string('user=%d&Token=%dx; Authorization: Basic%d cookie=a%d,password: "p%d" end', "user_id", "event_id", "user_id", "event_id", "event_id")
    logs = web_view(spark, sf_dir).select("event_id", X.redact(line).alias("line"))
    docs = table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("event_id"), X.redact(F.col("text")).alias("line"))
    return logs.unionByName(docs)


@query("first_ipv4", "FN-11", r"""
SELECT doc_id, list_filter(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b'), lambda q: len(list_filter(string_split(q, '.'), lambda o: CAST(o AS INT) > 255)) = 0)[1] AS ip
FROM documents""")
def first_ipv4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", first_ipv4(F.col("text")).alias("ip"))


_ADDRESS_SQL = """
a AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS n FROM events),
d AS (SELECT event_id, n, (n // 16777216) || '.' || ((n // 65536) % 256) || '.' || ((n // 256) % 256) || '.' || (n % 256) AS dotted FROM a)"""


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.expr("(event_id * 2654435761) % 4294967296")
    part = lambda div: F.expr(f"cast((n div {div}) % 256 as string)")
    rows = table(spark, sf_dir, "events").select("event_id", n.alias("n"))
    return rows.withColumn("dotted", F.concat_ws(".", part(16777216), part(65536), part(256), part(1)))


@query("ip_classes", "FN-03 FN-04 FN-05 FLT-09", f"""
WITH {_ADDRESS_SQL}
SELECT event_id, dotted AS canonical, CASE
  WHEN n // 16777216 = 127 THEN 'loopback'
  WHEN n // 16777216 = 10 OR n // 1048576 = 2753 OR n // 65536 = 49320 THEN 'private'
  WHEN n // 65536 = 43518 THEN 'linklocal'
  WHEN n = 0 OR n = 4294967295 OR n // 268435456 = 14 OR n // 256 IN (12582914, 12989028, 13303921) OR n // 4194304 = 401 OR n // 256 = 12582912 OR n // 131072 = 25353 THEN 'reserved'
  ELSE 'public' END AS ip_class, n = 0 AS placeholder FROM d""")
def ip_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address in one of five spellings."""
    d, kind = F.col("dotted"), F.col("event_id") % 5
    spelled = (
        F.when(kind == 0, d).when(kind == 1, F.concat(F.lit("::ffff:"), d)).when(kind == 2, F.concat(F.lit('"'), d, F.lit(':8080"')))
        .when(kind == 3, F.concat(F.lit("[::FFFF:"), d, F.lit("]:443"))).otherwise(F.concat(F.lit(" <"), d, F.lit(">")))
    )
    rows = _addresses(spark, sf_dir).withColumn("s", spelled)
    return rows.select("event_id", canonical_ip(F.col("s")).alias("canonical"), classify_ip(F.col("s")).alias("ip_class"), is_placeholder_ip(F.col("s")).alias("placeholder"))


@query("url_parts", "FN-09 FN-13", r"""
SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://[^/]+([^?]*)', 1), '') AS uri_path,
  CASE WHEN url LIKE '%?%' THEN nullif(regexp_extract(url, '\?(.*)$', 1), '') END AS uri_query, lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) AS host FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.regexp_replace("url", r"^[a-z]+://[^/]+", "")
    host = X.domain_host(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1))
    return table(spark, sf_dir, "pages").select("page_id", X.uri_path(rest).alias("uri_path"), X.uri_query(rest).alias("uri_query"), host.alias("host"))


@query("path_normalised", "FN-06 FN-07", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, '/a' || rtrim(path, '/') || '/c d%zz' AS normal, 'a' || rtrim(path, '/') || '/c d%zz' AS relative FROM p""")
def path_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    messy = F.concat(F.lit("/%61/./"), path, F.lit("//b/../c%20d%zz"))
    return table(spark, sf_dir, "pages").select(
        "page_id", X.normalise_path(messy).alias("normal"), X.normalise_allow_path(F.substring(messy, 2, 10_000)).alias("relative"))


@query("shell_history_rows", "SRC-29 WIN-07", f"""
WITH {WEB_SQL},
h AS (SELECT event_id, user_id, event_type, sec, CASE event_type WHEN 'error' THEN sec WHEN 'click' THEN -1 WHEN 'view' THEN NULL ELSE -1 END AS state FROM web),
b AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h)
SELECT event_id, CASE event_type WHEN 'click' THEN 'zsh ' || event_id WHEN 'view' THEN 'part ' || event_id || ' \\' ELSE 'run ' || event_id END AS command,
  CASE WHEN event_type = 'click' THEN strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H:%M:%SZ') WHEN before >= 0 THEN strftime(make_timestamp(before * 1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS timestamp
FROM b WHERE event_type <> 'error'""".replace("\\\\", "\\"))
def shell_history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = web_view(spark, sf_dir)
    kind, event = F.col("event_type"), _s("event_id")
    line = (
        F.when(kind == "error", F.concat(F.lit("#"), _s("sec"))).when(kind == "click", F.concat(F.lit(": "), _s("sec"), F.lit(":0;zsh "), event))
        .when(kind == "view", F.concat(F.lit("part "), event, F.lit(" \\"))).otherwise(F.concat(F.lit("run "), event))
    )
    rows = host_config.parse_shell_history(_lines(view, line, F.concat(F.lit("/home/u"), _s("user_id"), F.lit("/.bash_history"))))
    return rows.select(F.col("line_no").alias("event_id"), "command", "timestamp")


@query("sudoers_flags", "SRC-30 FN-18", f"""
WITH {WEB_SQL}
SELECT event_id, CASE event_type WHEN 'error' THEN 'nopasswd' WHEN 'click' THEN 'full_grant' WHEN 'view' THEN 'setenv' WHEN 'signup' THEN 'defaults_or_alias' ELSE '' END AS flags,
  CASE WHEN event_type = 'signup' THEN '' ELSE 'u' || user_id END AS user,
  CASE event_type WHEN 'error' THEN 'NOPASSWD: /bin/cat' WHEN 'click' THEN 'ALL' WHEN 'view' THEN 'SETENV: /bin/ls' WHEN 'signup' THEN 'Defaults env_reset' ELSE '/bin/id' END AS commands,
  CASE event_type WHEN 'error' THEN 'root' WHEN 'click' THEN 'ALL:ALL' ELSE '' END AS runas FROM web""")
def sudoers_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.concat(F.lit("u"), _s("user_id"))
    line = (
        F.when(kind == "error", F.concat(user, F.lit(" web01=(root) NOPASSWD: /bin/cat"))).when(kind == "click", F.concat(user, F.lit(" ALL=(ALL:ALL) ALL")))
        .when(kind == "view", F.concat(user, F.lit(" ALL= SETENV: /bin/ls"))).when(kind == "signup", F.lit("Defaults env_reset")).otherwise(F.concat(user, F.lit(" ALL=/bin/id")))
    )
    rows = host_config.parse_sudoers(_lines(web_view(spark, sf_dir), line, "/etc/sudoers"))
    return rows.select(F.col("line_no").alias("event_id"), "flags", "user", "commands", "runas")


@query("ssh_config_flags", "SRC-31", f"""
WITH {WEB_SQL}
SELECT event_id, CASE event_type WHEN 'error' THEN 'root_login_allowed' WHEN 'click' THEN 'non_default_authorized_keys_file' ELSE 'ssh_client_execution_or_include' END AS flag,
  CASE event_type WHEN 'error' THEN 'yes' WHEN 'click' THEN '/opt/keys/' || user_id ELSE 'nc ' || ip END AS value FROM web WHERE event_type IN ('error', 'click', 'view')""")
def ssh_config_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    view, kind = web_view(spark, sf_dir), F.col("event_type")
    server = F.when(kind == "error", F.lit("PermitRootLogin yes")).when(kind == "click", F.concat(F.lit("AuthorizedKeysFile  /opt/keys/"), _s("user_id"))).otherwise(F.lit("Port 22"))
    client = F.when(kind == "view", F.concat(F.lit("ProxyCommand nc "), F.col("ip"))).otherwise(F.lit("# none"))
    rows = host_config.parse_sshd_config(_lines(view, server, "/etc/ssh/sshd_config")).unionByName(host_config.parse_ssh_client_config(_lines(view, client, "/etc/ssh/ssh_config")))
    return rows.select(F.col("line_no").alias("event_id"), "flag", "value")


@query("cron_entries", "SRC-32", f"""
WITH {WEB_SQL} SELECT event_id, 'u' || user_id AS user, 'curl http://' || ip || path AS command, 'jobs:' || event_id AS name FROM web""")
def cron_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string("*/5 * * * *  u%d curl  http://%s%s", "user_id", "ip", "path")
    rows = host_config.parse_cron(_lines(web_view(spark, sf_dir), line, "/etc/cron.d/jobs"), "cron_d")
    return rows.select(F.regexp_extract("name", r"(\d+)$", 1).cast("bigint").alias("event_id"), "user", "command", "name")


@query("systemd_units", "SRC-32", """
SELECT 'svc' || p_partkey || '.service' AS name, '/opt/' || p_brand || '; /bin/pre' AS path, 'enabled_target:multi-user.target' AS start_mode, p_name AS display_name FROM part""")
def systemd_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("*", F.posexplode(F.array(
        F.lit("[Service]"), F.concat(F.lit("ExecStartPre = /bin/pre"), F.lit("")), F.concat(F.lit("ExecStart=/opt/"), "p_brand"), F.lit("ExecStart=/never"),
        F.concat(F.lit("Description="), "p_name"), F.lit("WantedBy=multi-user.target"), F.lit("# User=nobody"))).alias("n", "v"))
    lines = lines_from(rows, F.col("v"), F.concat(F.lit("/etc/systemd/system/svc"), _s("p_partkey"), F.lit(".service")), F.col("n") + 1)
    services, _ = host_config.parse_systemd(lines)
    return services.select("name", "path", "start_mode", "display_name")


@query("account_tables", "SRC-33 AGG-18 AGG-19", """
WITH c AS (SELECT c_custkey, 'c' || c_custkey AS name, CASE WHEN c_custkey % 50 = 0 THEN '0' ELSE CAST(900 + c_custkey % 300 AS VARCHAR) END AS uid,
  CASE WHEN c_custkey % 3 = 0 THEN '/sbin/nologin' ELSE '/bin/bash' END AS shell, c_custkey % 7 AS s FROM customer),
dup AS (SELECT uid FROM c GROUP BY uid HAVING count(*) > 1)
SELECT name AS user, 'empty_password' AS issue FROM c WHERE s = 0 UNION ALL SELECT name, 'weak_hash_md5' FROM c WHERE s = 1
UNION ALL SELECT name, 'additional_uid0_account' FROM c WHERE uid = '0'
UNION ALL SELECT name, 'service_or_hidden_account_with_login_shell' FROM c WHERE CAST(uid AS INT) < 1000 AND shell = '/bin/bash'
UNION ALL SELECT name, 'duplicate_uid:' || uid FROM c WHERE uid IN (SELECT uid FROM dup)""")
def account_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select(
        k, F.concat(F.lit("c"), k.cast("string")).alias("name"), F.when(k % 50 == 0, "0").otherwise((F.lit(900) + k % 300).cast("string")).alias("uid"),
        F.when(k % 3 == 0, "/sbin/nologin").otherwise("/bin/bash").alias("shell"))
    passwd = lines_from(people, F.concat_ws(":", "name", F.lit("x"), "uid", F.lit("100"), F.lit("someone"), F.lit("/home"), "shell"), "/etc/passwd", k)
    secret = F.when(k % 7 == 0, "").when(k % 7 == 1, "$1$abc").otherwise("$6$abc")
    shadow = lines_from(people, F.concat("name", F.lit(":"), secret, F.lit(":19000")), "/etc/shadow", k)
    return host_config.account_issues(passwd, shadow).select("user", "issue")


@query("docker_containers", "SRC-34 PRJ-15", """
SELECT 'id' || o_orderkey AS container_id, 'web' || o_custkey AS container_name,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 'host_network;privileged' WHEN o_orderstatus = 'F' THEN 'privileged' WHEN o_orderpriority LIKE '1%' THEN 'host_network' ELSE '' END AS risk_flags,
  CASE WHEN o_orderkey % 2 = 0 THEN 'sensitive_mount;writable_mount' ELSE 'web_root_mount' END AS mount_flags FROM orders""")
def docker_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    host = F.when(F.col("o_orderpriority").startswith("1"), "host").otherwise("bridge")
    mount = F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.lit("/etc").alias("Source"), F.lit("/data").alias("Destination"), F.lit("rw").alias("Mode"))).otherwise(
        F.struct(F.lit("/srv/x").alias("Source"), F.lit("/var/www/html").alias("Destination"), F.lit("ro").alias("Mode")))
    doc = F.to_json(F.struct(
        F.concat(F.lit("id"), _s("o_orderkey")).alias("ID"), F.concat(F.lit("/web"), _s("o_custkey")).alias("Name"),
        F.struct((F.col("o_orderstatus") == "F").alias("Privileged"), host.alias("NetworkMode")).alias("HostConfig"), F.struct(F.lit("nginx:1").alias("Image")).alias("Config"),
        F.array(mount).alias("Mounts")))
    found = containers.parse_docker(o.select(F.concat(F.lit("/d/"), _s("o_orderkey"), F.lit("/config.v2.json")).alias("source_file"), doc.alias("text")))
    return found.containers.select("container_id", "container_name", "risk_flags").join(
        found.mounts.select("container_id", F.col("risk_flags").alias("mount_flags")), "container_id")


@query("k8s_mounts", "SRC-35 PRJ-15", """
SELECT 'k8s-shop-pod' || s_suppkey || '-app' AS container_id, '/host/' || s_suppkey AS source, '/data' AS destination FROM supplier
UNION ALL SELECT 'k8s-shop-pod' || s_suppkey, '/proc', '/proc' FROM supplier""")
def k8s_mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-document YAML per supplier: one mounted volume, one idle one, and a broken document."""
    template = ("kind: Deployment\nmetadata:\n  name: pod%d\n  namespace: shop\nspec:\n  template:\n    spec:\n      containers:\n      - name: app\n        image: a:1\n"
                "        volumeMounts:\n        - name: data\n          mountPath: /data\n      volumes:\n      - name: data\n        hostPath:\n          path: /host/%d\n"
                "      - name: idle\n        hostPath:\n          path: /proc\n---\nkind: [broken\n---\nkind: Service\nmetadata:\n  name: s\n")
    files = table(spark, sf_dir, "supplier").select(F.concat(_s("s_suppkey"), F.lit(".yaml")).alias("source_file"), F.format_string(template, "s_suppkey", "s_suppkey").alias("text"))
    return containers.parse_k8s(files).mounts.select("container_id", "source", "destination")


@query("tomcat_components", "SRC-36 PRJ-16", """
SELECT 'web' || p_partkey || '.xml' AS source_file, 'filter_mapping' AS component_type, 'F' || p_partkey AS name, 'com.acme.Shell' || p_size AS class_name, '/*' AS route_or_pattern, 'broad_mapping;suspicious_class' AS risk_flags, 'high' AS confidence FROM part
UNION ALL SELECT 'web' || p_partkey || '.xml', 'filter', 'F' || p_partkey, 'com.acme.Shell' || p_size, '', 'suspicious_class', 'high' FROM part
UNION ALL SELECT 'web' || p_partkey || '.xml', 'valve', 'AccessLogValve', 'org.x.AccessLogValve', '', '', 'low' FROM part""")
def tomcat_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = ("<web-app><!-- <filter><filter-name>no</filter-name></filter> --><filter><filter-name>F%d</filter-name><filter-class>com.acme.Shell%d</filter-class></filter>"
           "<filter-mapping><filter-name>F%d</filter-name><url-pattern>/*</url-pattern></filter-mapping><Valve className=\"org.x.AccessLogValve\"/></web-app>")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("web"), _s("p_partkey"), F.lit(".xml")).alias("source_file"), F.format_string(xml, "p_partkey", "p_size", "p_partkey").alias("text"))
    return webconfig.parse_tomcat_xml(files).select("source_file", "component_type", "name", "class_name", "route_or_pattern", "risk_flags", "confidence")


@query("iis_components", "SRC-37 PRJ-16", """
SELECT 'c' || p_partkey AS source_file, 'handler' AS component_type, 'H' || p_partkey AS name, '*' AS route_or_pattern, 'broad_mapping;global_handler;handler_script_processor' AS risk_flags FROM part
UNION ALL SELECT 'c' || p_partkey, 'app_pool_identity', 'pool' || p_size, '', 'privileged_app_pool_identity' FROM part""")
def iis_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = ('<configuration><applicationPools><add name="pool%d"><processModel identityType="LocalSystem"/></add><add name="ok" /></applicationPools>'
           '<handlers><add name="H%d" path="*" scriptProcessor="x.dll"/></handlers></configuration>')
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("c"), _s("p_partkey")).alias("source_file"), F.format_string(xml, "p_size", "p_partkey").alias("text"))
    return webconfig.parse_iis_config(files).select("source_file", "component_type", "name", "route_or_pattern", "risk_flags")


@query("spring_routes", "SRC-38 PRJ-16", f"""
WITH {WEB_SQL} SELECT event_id, method AS http_method, path AS route, 'com.acme.ItemController' AS class_name FROM web WHERE path NOT LIKE '%..%'""")
def spring_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = web_view(spark, sf_dir).where(~F.col("path").contains(".."))
    line = F.concat(F.lit("Mapped {"), F.col("method"), F.lit(" ["), F.col("path"), F.lit("]} onto com.acme.ItemController"))
    rows = webconfig.spring_mappings_from_logs(_lines(view, line, _s("event_id")))
    return rows.select(F.col("source_file").cast("bigint").alias("event_id"), "http_method", F.col("route_or_pattern").alias("route"), "class_name")


@query("login_records", "SRC-27 SRC-28", f"""
WITH {WEB_SQL} SELECT event_id, 'user_process' AS record_type, 'u' || user_id AS user, ip AS host, CAST(event_id % 30000 AS VARCHAR) AS pid, stamp AS timestamp,
  ((user_id % 256) || '.' || ((user_id // 256) % 256) || '.0.203') AS address FROM web""")
def login_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wtmp files with one 384-byte record per event, 500 records each."""
    hexed = lambda value, width: F.rpad(F.hex(F.encode(value, "UTF-8")), width * 2, "0")
    le = lambda value: F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(value.cast("bigint"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)])
    user_byte, high_byte = F.col("user_id") % 256, F.expr("(user_id div 256) % 256")
    address = F.concat(F.lit("CB00"), F.lpad(F.hex(high_byte.cast("bigint")), 2, "0"), F.lpad(F.hex(user_byte.cast("bigint")), 2, "0"), F.lit("0" * 24))
    record = F.concat(
        F.lit("07000000"), le(F.col("event_id") % 30000), hexed(F.lit("pts/0"), 32), F.lit("0" * 8), hexed(F.concat(F.lit("u"), _s("user_id")), 32),
        hexed(F.col("ip"), 256), F.lit("0" * 16), le(F.col("sec")), F.lit("0" * 8), address, F.lit("0" * 40))
    view = web_view(spark, sf_dir).select(F.expr("event_id div 500").alias("part"), "event_id", record.alias("r"))
    per_file = view.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("event_id", "r"))).alias("rs"))  # at most 500 records
    files = per_file.select(F.concat(F.lit("/var/log/wtmp."), _s("part")).alias("path"), F.unhex(F.array_join(F.transform("rs", lambda s: s["r"]), "")).alias("content"),
                            F.transform("rs", lambda s: s["event_id"]).alias("ids"))
    rows = binary.parse_utmp(files.select("path", "content"), "wtmp").join(files.select("path", "ids"), "path")
    return rows.select(F.get("ids", F.col("record_no")).alias("event_id"), "record_type", "user", "host", "pid", "timestamp", "address")


@query("ioc_feed_types", "SRC-25 FN-14", f"""
WITH {_ADDRESS_SQL}
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ip' WHEN 1 THEN 'cidr' WHEN 2 THEN 'hash' WHEN 3 THEN 'url_path' WHEN 4 THEN 'domain' ELSE 'user_agent' END AS indicator_type FROM d""")
def ioc_feed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, kind = F.col("dotted"), F.col("event_id") % 6
    value = (
        F.when(kind == 0, d).when(kind == 1, F.concat(d, F.lit("/24"))).when(kind == 2, F.md5(d)).when(kind == 3, F.concat(F.lit("x"), _s("event_id"), F.lit(".jsp")))
        .when(kind == 4, F.concat(F.lit("h"), _s("event_id"), F.lit(".example.net"))).otherwise(F.concat(F.lit("agent "), _s("event_id")))
    )
    kept, _ = inventory.shape_iocs(_addresses(spark, sf_dir).select(F.col("event_id").alias("seq"), value.alias("value")), "derived", strict_type=False)
    return kept.select(F.col("seq").alias("event_id"), "indicator_type")
