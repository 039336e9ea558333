"""Queries over files: rendered from the tables, written to the shared folder, read back as a fleet's files would be.

Files are left in folders named ``tracelight-files-…`` beneath the checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.plans.correlation_queries import FINDINGS_SQL, derived_findings
from tracelight.plans.enrichment_queries import _CONTENT_SQL, _SIGNATURES, _SIGNATURES_SQL, _content
from tracelight.plans.ingest_queries import _HTTP, _HTTP_SQL, _IIS_A, _IIS_B, _JOINED_SQL, _WIN_SQL, _json_line, _s, _windows_columns, windows_block
from tracelight.plans.registry import WEB_SQL, clf_line, query, table, web_view
from tracelight.session import ensure_checkpoint_dir
from tracelight.sinks import committed, writers
from tracelight.sources import app, binary, host_config, host_events, ranges, signatures, web
from tracelight.sources.lines import read_log_lines

FILES = 4
LINES_PER_PART = 100_000


def fresh_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tracelight-files-{uuid.uuid4().hex}"


def written_logs(rows: DataFrame) -> str:
    """Folder with one log for each ``file`` of ``rows(file, n, value)``, its lines in the order of ``n``.

    A log is a folder of part files, in the order of their names, so that a task sorts and writes ``LINES_PER_PART`` lines.
    """
    folder = fresh_folder(rows.sparkSession)
    tasks = max(1, -(-rows.count() // LINES_PER_PART))
    rows.repartitionByRange(tasks, "file", "n").sortWithinPartitions("file", "n").select("file", "value").write.partitionBy("file").text(folder)
    return folder


def _file_no(path: str = "source_file") -> Column:
    return F.regexp_extract(path, r"file=[^/]*?(\d+)[^/]*(?:/|$)", 1).cast("bigint")


def _iis_rows(view: DataFrame, file: Column, switch: int) -> DataFrame:
    """IIS lines whose columns change their order at event ``switch``, where a second header stands."""
    q = F.coalesce("query", F.lit("-"))
    day, time = F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd"), F.date_format(F.timestamp_seconds("sec"), "HH:mm:ss")
    row = F.when(F.col("event_id") < switch, F.concat_ws(" ", day, time, "ip", "method", "path", q, _s("status"), _s("bytes"), "agent")).otherwise(
        F.concat_ws(" ", time, day, "method", "ip", "path", q, _s("bytes"), _s("status"), "agent"))
    data = view.select(file.alias("file"), (F.col("event_id") * 2 + 1).alias("n"), F.when(F.col("event_id") % 97 == 0, F.concat(row, F.lit(" extra"))).otherwise(row).alias("value"))
    heads = data.select("file").distinct().select("file", F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(_IIS_A).alias("value")), F.struct(F.lit(switch * 2).cast("bigint").alias("n"), F.lit(_IIS_B).alias("value")))).alias("h"))
    return data.unionByName(heads.select("file", "h.n", "h.value"))


_RANKED = f"web_ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id % {FILES} ORDER BY event_id) AS rn FROM web)"
_HTTP_ROW = _HTTP_SQL.replace("event_id, ", "", 1)


@query("iis_files", "SRC-01 SRC-05 WIN-07", f"""
WITH {WEB_SQL}, {_RANKED}, l AS (SELECT *, event_id % {FILES} AS file_no, rn + 1 + CASE WHEN event_id >= 300 THEN 1 ELSE 0 END AS line_number FROM web_ranked)
SELECT file_no, line_number, {_HTTP_ROW}, 'ok' AS outcome FROM l WHERE event_id % 97 <> 0
UNION ALL SELECT file_no, line_number, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'IIS row has 10 fields but #Fields declares 9' FROM l WHERE event_id % 97 = 0""")
def iis_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file changes its columns at a second header; lines stay in their splits."""
    file = F.concat(F.lit("u_ex"), (F.col("event_id") % FILES).cast("string"), F.lit(".log"))
    parsed = web.parse_iis(read_log_lines(spark, written_logs(_iis_rows(web_view(spark, sf_dir), file, 300)), recursive=True, parts=True))
    good = parsed.events.select(_file_no().alias("file_no"), "line_number", *_HTTP, F.lit("ok").alias("outcome"))
    return good.unionByName(parsed.rejects.select(_file_no().alias("file_no"), "line_number", F.col("message").alias("outcome")), allowMissingColumns=True)


@query("mixed_files", "SRC-02 SRC-06", f"""
WITH {WEB_SQL}, {_RANKED}
SELECT event_id % {FILES} AS file_no, rn + CASE WHEN event_id % {FILES} <> 2 THEN 0 WHEN event_id >= 300 THEN 2 ELSE 1 END AS line_number, {_HTTP_ROW}
FROM web_ranked WHERE event_id % 97 <> 0 OR event_id % {FILES} <> 2""")
def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common, JSON and IIS files in one folder; the format is found from a file's first lines."""
    view, kind = web_view(spark, sf_dir), F.col("event_id") % FILES
    named = F.concat(F.lit("access-"), kind.cast("string"), F.lit(".log"))
    plain = view.where(kind != 2).select(named.alias("file"), F.col("event_id").alias("n"), F.when(kind == 1, _json_line()).otherwise(clf_line()).alias("value"))
    folder = written_logs(plain.unionByName(_iis_rows(view.where(kind == 2), named, 300)))
    events = web.parse_web(read_log_lines(spark, folder, recursive=True, name_pattern=r"\.txt$", parts=True)).events
    return events.select(_file_no().alias("file_no"), "line_number", *_HTTP)


@query("history_files", "SRC-01 SRC-29 WIN-07", f"""
WITH {WEB_SQL},
h AS (SELECT event_id, user_id % 16 AS u, event_type, sec, CASE event_type WHEN 'error' THEN sec WHEN 'click' THEN -1 WHEN 'view' THEN NULL ELSE -1 END AS state FROM web),
b AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY event_id) AS line_no, last_value(state IGNORE NULLS) OVER (PARTITION BY u ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h)
SELECT u AS file_no, line_no, CASE event_type WHEN 'click' THEN 'zsh ' || event_id WHEN 'view' THEN 'part ' || event_id || ' \\' ELSE 'run ' || event_id END AS command,
  CASE WHEN event_type = 'click' THEN strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H:%M:%SZ') WHEN before >= 0 THEN strftime(make_timestamp(before * 1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS timestamp
FROM b WHERE event_type <> 'error'""")
def history_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, event = F.col("event_type"), _s("event_id")
    line = F.when(kind == "error", F.concat(F.lit("#"), _s("sec"))).when(kind == "click", F.concat(F.lit(": "), _s("sec"), F.lit(":0;zsh "), event)).when(
        kind == "view", F.concat(F.lit("part "), event, F.lit(" \\"))).otherwise(F.concat(F.lit("run "), event))
    rows = web_view(spark, sf_dir).select(F.concat(F.lit("u"), (F.col("user_id") % 16).cast("string")).alias("file"), F.col("event_id").alias("n"), line.alias("value"))
    found = host_config.parse_shell_history(read_log_lines(spark, written_logs(rows), recursive=True, parts=True))
    return found.select(_file_no("history_file").alias("file_no"), "line_no", "command", "timestamp")


@query("talk_files", "SRC-01 SRC-16 WIN-07", f"""
WITH t AS (SELECT conv_id, turn, {_JOINED_SQL} AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT '1970-02-02 00:00:00 ERROR conversation ' || conv_id || coalesce(string_agg(chr(10) || 'at ' || body || ';', '' ORDER BY turn) FILTER (n > 1), '') AS message
FROM t GROUP BY conv_id""")
def talk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as one event of a log file: the first is a dated line, the others continue it."""
    from pyspark.sql import Window as W

    talk = table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    line = F.when(F.col("k") == 1, F.concat(F.lit("1970-02-02 00:00:00 ERROR conversation "), _s("conv_id"))).otherwise(
        F.concat(F.lit("at "), F.regexp_replace("text", r"[ \t\n\r\f]+", "_"), F.lit(";")))
    rows = talk.select(F.concat(F.lit("talk-"), (F.col("conv_id") % 7).cast("string")).alias("file"), F.struct("conv_id", "k").alias("n"), line.alias("value"))
    return app.parse_app(read_log_lines(spark, written_logs(rows), recursive=True, parts=True)).events.select(F.col("message_summary").alias("message"))


@query("xml_files", "SRC-20 SRC-27", _WIN_SQL)
def xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event blocks of two lines each, read by byte ranges that cut blocks apart."""
    view = web_view(spark, sf_dir)
    block = F.concat(F.replace(windows_block(), F.lit("</System>"), F.lit("</System>\n")), F.lit("</Event>"))
    rows = view.select(F.concat(F.lit("security-"), (F.col("event_id") % FILES).cast("string")).alias("file"), F.col("event_id").alias("n"), block.alias("value"))
    events = host_events.parse_windows_xml(host_events.read_terminated(spark, written_logs(rows), "</Event>")).events
    number = F.regexp_extract("command_line_summary", r"echo (\d+)", 1).cast("bigint")
    return _windows_columns(events.withColumn("line_number", number))


@query("xml_file_lines", "SRC-20", f"""
WITH {WEB_SQL}, {_RANKED} SELECT event_id, rn * 2 - 1 AS start_line FROM web_ranked""")
def xml_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line at which each block of two lines starts, over ranges much smaller than the files."""
    view = web_view(spark, sf_dir)
    block = F.concat(F.lit("<Event>"), _s("event_id"), F.lit("\n</Event>"))
    rows = view.select(F.concat(F.lit("short-"), (F.col("event_id") % FILES).cast("string")).alias("file"), F.col("event_id").alias("n"), block.alias("value"))
    found = ranges.read_terminated_bytes(spark, written_logs(rows), b"</Event>", range_bytes=4096, parts=True)
    text = F.col("content").cast("string")
    # a record begins with the line end behind the block before it
    lead = F.length(text) - F.length(F.ltrim(text, F.lit("\n")))
    return found.where(text.contains("<Event>")).select(F.regexp_extract(text, r"<Event>(\d+)", 1).cast("bigint").alias("event_id"), (F.col("start_line") + lead).alias("start_line"))


@query("wtmp_files", "SRC-27 SRC-28 SNK-01", f"""
WITH {WEB_SQL} SELECT 'user_process' AS record_type, 'u' || user_id AS user, ip AS host, CAST(event_id % 30000 AS VARCHAR) AS pid, stamp AS timestamp,
  ((user_id % 256) || '.' || ((user_id // 256) % 256) || '.0.203') AS address FROM web""")
def wtmp_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Login records in files of any size, written as committed bytes and read by ranges of whole records."""
    hexed = lambda value, width: F.rpad(F.hex(F.encode(value, "UTF-8")), width * 2, "0")
    le = lambda value: F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(value.cast("bigint"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)])
    byte = lambda value: F.lpad(F.hex(value.cast("bigint")), 2, "0")
    address = F.concat(F.lit("CB00"), byte(F.expr("(user_id div 256) % 256")), byte(F.col("user_id") % 256), F.lit("0" * 24))
    record = F.concat(F.lit("07000000"), le(F.col("event_id") % 30000), hexed(F.lit("pts/0"), 32), F.lit("0" * 8), hexed(F.concat(F.lit("u"), _s("user_id")), 32),
                      hexed(F.col("ip"), 256), F.lit("0" * 16), le(F.col("sec")), F.lit("0" * 8), address, F.lit("0" * 40))
    folder = fresh_folder(spark)
    committed.write_lines(web_view(spark, sf_dir).select(F.unhex(record).alias("value")), folder, ".wtmp")
    records = ranges.read_records(spark, folder, binary.UTMP_SIZE, range_bytes=64 << 10, name_pattern=r"\.wtmp$")
    rows = binary.parse_utmp_records(records.select("path", "record_no", F.col("content").alias("r")), "wtmp")
    return rows.select("record_type", "user", "host", "pid", "timestamp", "address")


@query("signature_files", "SRC-27 DET-19", f"""
WITH {_CONTENT_SQL}, {_SIGNATURES_SQL} SELECT rule_name, sum(match_count)::BIGINT AS match_count FROM m GROUP BY 1 HAVING sum(match_count) > 0""")
def signature_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All content in a few large files, scanned for all literals at once in overlapping chunks."""
    rules = signatures.parse_literal_rules(_SIGNATURES, "local")
    folder = fresh_folder(spark)
    # a zero byte between contents: no literal reaches from one into the next
    committed.write_lines(_content(spark, sf_dir).select(F.concat("content", F.unhex(F.lit("00"))).alias("value")), folder, ".bin")
    chunks = ranges.read_chunks(spark, folder, chunk=10_000, overlap=signatures.overlap_of(rules), range_bytes=1 << 20).where("size > 1").where(F.col("name").endswith(".bin"))
    found = signatures.signature_matches(chunks, rules, chunk=10_000)
    return found.groupBy("rule_name").agg(F.sum("match_count").alias("match_count"))


@query("findings_written", "SNK-01 SNK-08", f"""
WITH {FINDINGS_SQL}
SELECT id AS finding_id, 'R-' || e.event_type AS rule_id, score, raw_ip AS remote_ip, fpath AS uri_path, kind AS source_type, category, file AS source_file, event_id AS line_number, sha256(CAST(event_id AS VARCHAR)) AS raw_hash
FROM fnd JOIN events e USING (event_id)""")
def findings_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as JSON lines that count once the job has committed, read back by the list of committed files."""
    findings, folder = derived_findings(spark, sf_dir), fresh_folder(spark)
    writers.write_jsonl(findings, folder)
    back = committed.read_jsonl(spark, folder, findings.schema)
    return back.select("finding_id", "rule_id", "score", "remote_ip", "uri_path", "source_type", "category", "source_file", "line_number", "raw_hash")


@query("sarif_written", "SNK-03 SNK-04", f"""
WITH {FINDINGS_SQL}
SELECT id AS finding_id, 'R-' || e.event_type AS rule_id, CASE WHEN score >= 70 THEN 'error' WHEN score >= 50 THEN 'warning' ELSE 'note' END AS level, CASE WHEN event_id > 0 THEN event_id END AS start_line
FROM fnd JOIN events e USING (event_id)""")
def sarif_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of a written SARIF document, one line each between its head and its tail."""
    folder = fresh_folder(spark)
    writers.write_sarif(derived_findings(spark, sf_dir), folder)
    body = F.regexp_replace("value", "^,", "")
    shape = ("ruleId string, level string, locations array<struct<physicalLocation: struct<region: struct<startLine: bigint>>>>, properties struct<findingId: string>")
    rows = committed.read_lines(spark, folder).select(F.from_json(body, shape).alias("r")).where("r.ruleId is not null")
    return rows.select(F.col("r.properties.findingId").alias("finding_id"), F.col("r.ruleId").alias("rule_id"), "r.level", F.get("r.locations", F.lit(0))["physicalLocation"]["region"]["startLine"].alias("start_line"))
