"""Queries of host detectors as findings, inventories, collection windows and runs kept version by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.operators import baseline as B
from tracelight.operators import detectors as D
from tracelight.operators.brute_force import logon_brute_force
from tracelight.operators.filters import TimeWindow, filtered_count, recently_changed
from tracelight.operators.relations import with_nearest_ids
from tracelight.operators.run_store import RunStore
from tracelight.operators.timeline import timeline
from tracelight.plans.correlation_queries import FINDINGS_SQL, RELATIONS_SQL, derived_findings
from tracelight.plans.enrichment_queries import _linux, _windows
from tracelight.plans.file_queries import fresh_folder
from tracelight.plans.ingest_queries import _lines, _s
from tracelight.plans.registry import WEB_SQL, query, table, web_view
from tracelight.schema import LINUX_EVENT, WINDOWS_EVENT, conform
from tracelight.sinks import writers
from tracelight.sources import host_config, host_events, inventory


def _logon_sql(prefix: str, rule: str, high: int, low: int) -> str:
    return f"""
SELECT '{prefix}' || t.ip AS finding_id, '{rule}' AS rule_id, CASE WHEN EXISTS (SELECT 1 FROM web w WHERE w.ip = t.ip AND w.event_type = 'signup' AND w.sec BETWEEN first AND first + 600) THEN {high} ELSE {low} END AS score,
  t.ip AS remote_ip, 'brute_force' AS category FROM t"""


@query("logon_brute_findings", "DET-07 DET-11 AGG-08 JN-17", f"""
WITH {WEB_SQL},
f AS (SELECT ip, sec, lag(sec, 4) OVER (PARTITION BY ip ORDER BY sec, event_id) AS fifth FROM web WHERE event_type = 'error'),
h AS (SELECT * FROM f WHERE sec - fifth <= 600),
t AS (SELECT ip, min(fifth) AS first FROM h WHERE sec = (SELECT min(sec) FROM h g WHERE g.ip = h.ip) GROUP BY 1)
{_logon_sql('HE-WIN-BF-', 'HOST-WINDOWS-BRUTE-001', 82, 62)} UNION ALL {_logon_sql('HE-LNX-BF-', 'HOST-LINUX-SSHBRUTE-001', 80, 60)}""")
def logon_brute_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logon_brute_force(_windows(spark, sf_dir), "windows").unionByName(logon_brute_force(_linux(spark, sf_dir), "linux"))
    return found.select("finding_id", "rule_id", "score", "remote_ip", "category")


@query("task_findings", "DET-04", f"""
WITH {WEB_SQL} SELECT event_id, 'HOST-WINDOWS-TASK-001' AS rule_id, 66 AS score FROM web WHERE event_type IN ('click', 'view') AND event_id % 3 <> 0""")
def task_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that are created or changed; two of three start from an odd place."""
    kind, third = F.col("event_type"), F.col("event_id") % 3
    action = F.when(kind == "click", "scheduled_task_create").when(kind == "view", "scheduled_task_update").otherwise("scheduled_task_delete")
    events = conform(web_view(spark, sf_dir).select(
        F.col("stamp").alias("timestamp"), F.lit("4698").alias("event_code"), action.alias("action"), F.col("event_id").alias("line_number"), F.lit("Security").alias("channel"),
        F.concat(F.lit("task"), _s("event_id")).alias("task_name"),
        F.when(third == 0, "C:\\Program Files\\backup.exe").when(third == 1, "C:\\Users\\Public\\run.exe").otherwise("C:\\Windows\\Temp\\a.exe").alias("object_path"),
        F.lit("task.evtx").alias("source_file"), F.sha2(_s("event_id"), 256).alias("raw_hash")), WINDOWS_EVENT)
    return D.windows_event_findings(events).select(F.col("line_number").alias("event_id"), "rule_id", "score")


@query("scan_findings", "DET-12 AGG-10 ORD-06", """
WITH p AS (SELECT DISTINCT l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 40 ELSE l_partkey % 4 END AS target, l_orderkey AS sub FROM lineitem WHERE l_returnflag <> 'R'),
g AS (SELECT l_suppkey, '10.0.0.' || target AS target, count(*) AS subs FROM p GROUP BY 1, 2),
s AS (SELECT l_suppkey, count(*) AS n, min(CASE WHEN subs >= 15 THEN target END) AS probed FROM g GROUP BY 1)
SELECT 'p' || s.l_suppkey AS process, 66 AS score, CASE WHEN n >= 10 THEN 'talks to ' || n || ' remote addresses' ELSE 'tries ' || g.subs || ' ports of ' || probed END AS said
FROM s LEFT JOIN g ON g.l_suppkey = s.l_suppkey AND g.target = s.probed WHERE n >= 10 OR probed IS NOT NULL""")
def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as processes, parts as addresses, orders as ports; listening sockets do not count."""
    part = F.col("l_partkey")
    target = F.when(F.col("l_suppkey") % 3 == 0, part % 40).otherwise(part % 4)
    connections = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), _s("l_suppkey")).alias("process_name"), F.concat(F.lit("10.0.0."), target.cast("string")).alias("remote_address"), F.col("l_orderkey").alias("remote_port"),
        F.when(F.col("l_returnflag") == "R", "LISTEN").otherwise("established").alias("state"))
    said = F.regexp_extract("evidence_summary", r"(talks to \d+ remote addresses|tries \d+ ports of [0-9.]+?)(?:,|\. This)", 1)
    return D.scan_findings(connections).select(F.regexp_extract("evidence_summary", "process `([^`]*)`", 1).alias("process"), "score", said.alias("said"))


@query("rc_hooks", "PRJ-22", f"""
WITH {WEB_SQL} SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'suspicious_alias' WHEN 1 THEN 'suspicious_function' WHEN 2 THEN 'prompt_command_hook' WHEN 3 THEN 'trap_hook' ELSE 'ld_preload_export' END AS kind
FROM web WHERE event_id % 7 < 5""")
def rc_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = F.col("event_id") % 7, _s("event_id")
    line = (F.when(n == 0, F.concat(F.lit("alias ls='curl http://x/"), e, F.lit("'"))).when(n == 1, F.concat(F.lit("function f"), e, F.lit("() { wget x; }")))
            .when(n == 2, F.lit("PROMPT_COMMAND='python -c x'")).when(n == 3, F.lit("trap cleanup EXIT")).when(n == 4, F.lit("export LD_PRELOAD=/tmp/x.so"))
            .when(n == 5, F.lit("# alias x='curl y'")).otherwise(F.lit("export PATH=/usr/bin")))
    return host_config.parse_rc_files(_lines(web_view(spark, sf_dir), line, "/root/.bashrc")).select(F.col("line_no").alias("event_id"), "kind")


@query("socket_classes", "PRJ-23", f"""
WITH {WEB_SQL} SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'loopback' WHEN 1 THEN 'private' WHEN 2 THEN 'link_local' WHEN 3 THEN 'multicast' WHEN 4 THEN 'unspecified' WHEN 5 THEN 'reserved' WHEN 6 THEN 'public' ELSE 'invalid' END AS remote_class FROM web""")
def socket_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections of an inventory with the class of their remote address."""
    n, u = F.col("event_id") % 8, (F.col("user_id") % 200 + 1).cast("string")
    address = (F.when(n == 0, F.concat(F.lit("127.0.0."), u)).when(n == 1, F.concat(F.lit("[fd00::"), u, F.lit("]"))).when(n == 2, F.concat(F.lit("169.254.7."), u))
               .when(n == 3, F.concat(F.lit("ff02::"), u)).when(n == 4, F.lit("0.0.0.0")).when(n == 5, F.concat(F.lit("250.1.1."), u)).when(n == 6, F.concat(F.lit("203.0.113."), u))
               .otherwise(F.concat(F.lit("host"), u)))
    rows = web_view(spark, sf_dir).select("event_id", address.alias("remote_address"))
    return inventory.described_connections(rows).select("event_id", "remote_class")


@query("web_processes", "PRJ-23", f"""
WITH {WEB_SQL} SELECT event_id, event_type IN ('click', 'view') OR event_id % 5 = 0 AS web_related FROM web""")
def web_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes that are web servers or runtimes by their name or command line."""
    kind = F.col("event_type")
    name = F.when(kind == "click", "NGINX: worker").when(kind == "view", "php-fpm8.2").otherwise("sshd")
    command = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("/usr/bin/java -jar "), _s("event_id"))).otherwise(F.lit("/sbin/init"))
    return inventory.described_processes(web_view(spark, sf_dir).select("event_id", name.alias("name"), command.alias("command_line"))).select("event_id", "web_related")


_FROM, _TO = "1970-02-02T21:10:00Z", "1970-02-02T21:40:00Z"


@query("collection_window", "FLT-04", f"""
WITH {WEB_SQL} SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN stamp END AS timestamp FROM web WHERE event_id % 9 = 0 OR stamp BETWEEN '{_FROM}' AND '{_TO}'""")
def collection_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside a window; undated ones stay, and no number of records ends the collection."""
    events = conform(web_view(spark, sf_dir).select(F.when(F.col("event_id") % 9 != 0, F.col("stamp")).alias("timestamp"), F.col("event_id").alias("line_number")), LINUX_EVENT)
    bound = lambda text: F.to_timestamp(F.lit(text))
    return host_events.in_collection_window(events, bound(_FROM), bound(_TO)).select(F.col("line_number").alias("event_id"), "timestamp")


@query("changed_files", "FLT-11 ORD-07 FLT-05", f"""
WITH {WEB_SQL}, f AS (SELECT event_id, '/srv/f' || event_id || '.jsp' AS path, CASE WHEN event_id % 9 <> 0 THEN stamp END AS modified_at FROM web)
SELECT path, modified_at, (SELECT count(*) FROM f WHERE modified_at IS NOT NULL AND modified_at NOT BETWEEN '{_FROM}' AND '{_TO}') AS outside FROM f WHERE modified_at BETWEEN '{_FROM}' AND '{_TO}'""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose change time lies in a window, in order, and how many dated ones it leaves out."""
    files = web_view(spark, sf_dir).select(F.concat(F.lit("/srv/f"), _s("event_id"), F.lit(".jsp")).alias("path"), F.when(F.col("event_id") % 9 != 0, F.col("stamp")).alias("modified_at"))
    window = TimeWindow(since=_FROM, until=_TO)
    return recently_changed(files, window).crossJoin(F.broadcast(filtered_count(files, "modified_at", window).withColumnRenamed("filtered", "outside")))  # one row


@query("run_diff", "SRC-40 JN-13 JN-12", """
WITH old AS (SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer WHERE c_custkey % 11 <> 3),
new AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 13 = 5 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_nationkey FROM customer WHERE c_custkey % 17 <> 4)
SELECT CASE WHEN old.c_custkey IS NULL THEN 'new' WHEN new.c_custkey IS NULL THEN 'gone' ELSE 'changed' END AS change, coalesce(new.c_custkey, old.c_custkey) AS c_custkey, coalesce(new.c_acctbal, old.c_acctbal) AS c_acctbal
FROM old FULL JOIN new USING (c_custkey) WHERE old.c_custkey IS NULL OR new.c_custkey IS NULL OR old.c_acctbal <> new.c_acctbal""")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of an inventory kept version by version; only buckets whose summaries differ are read."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    store = RunStore(spark, fresh_folder(spark), ["c_custkey"], buckets=32)
    store.write(rows.where("c_custkey % 11 <> 3"), "2026-01")
    store.write(rows.where("c_custkey % 17 <> 4").withColumn("c_acctbal", F.when(F.col("c_custkey") % 13 == 5, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))), "2026-02")
    return store.diff("2026-01", "2026-02").select("change", "c_custkey", "c_acctbal")


@query("earlier_run_files", "DET-22 SRC-40 FN-15 SNK-01", f"""
WITH {FINDINGS_SQL}, b AS (SELECT fnd.*, event_type FROM fnd JOIN events USING (event_id) WHERE kind = 'file'),
old AS (SELECT *, sha256(CAST(event_id % 50 AS VARCHAR)) AS digest FROM b WHERE event_id % 2 = 0), cur AS (SELECT *, sha256(CAST(event_id % 70 AS VARCHAR)) AS digest FROM b WHERE event_id % 2 = 1)
SELECT id AS finding_id, digest IN (SELECT digest FROM old) AS repeated_file, greatest(0, score - CASE WHEN digest IN (SELECT digest FROM old) THEN 10 ELSE 0 END) AS score FROM cur""")
def earlier_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File findings compared with those an earlier run has written and committed."""
    files = derived_findings(spark, sf_dir).where("source_type = 'file'")
    digest = lambda n: F.sha2((F.col("line_number") % n).cast("string"), 256)
    folder = fresh_folder(spark)
    writers.write_jsonl(files.where("line_number % 2 = 0").withColumn("raw_hash", digest(50)), folder)
    earlier = inventory.earlier_findings(spark, folder)
    current = files.where("line_number % 2 = 1").withColumn("raw_hash", digest(70))
    return B.downrank_repeated(current, earlier, B.known_files(earlier)).select("finding_id", "repeated_file", "score")


_NEAR_SQL = f"""
{RELATIONS_SQL},
side AS (SELECT src AS id, dst AS other, d FROM relation UNION ALL SELECT dst, src, d FROM relation),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS n FROM side),
near AS (SELECT id, string_agg(other, ';' ORDER BY n) AS ids, string_agg(other, ';' ORDER BY other) AS sorted FROM ranked WHERE n <= 10 GROUP BY 1)"""


@query("sarif_related", "SNK-04 GR-02", f"WITH {_NEAR_SQL} SELECT f.id AS finding_id, coalesce(ids, '') AS related FROM fnd f LEFT JOIN near USING (id)")
def sarif_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related locations of SARIF results: the ten nearest related findings."""
    rows = writers.sarif_results(with_nearest_ids(derived_findings(spark, sf_dir)))
    shape = "relatedLocations array<struct<message: struct<text: string>>>"
    told = F.transform(F.from_json("result", shape)["relatedLocations"], lambda x: F.replace(x["message"]["text"], F.lit("Related finding "), F.lit("")))
    return rows.select("finding_id", F.array_join(told, ";").alias("related"))


@query("timeline_related", "PRJ-14 ORD-04 GR-02", f"""
WITH {_NEAR_SQL} SELECT f.id AS finding_id, array_to_string(list_sort(list_append(coalesce(string_split(sorted, ';'), []), f.id)), ';') AS related FROM fnd f LEFT JOIN near USING (id)""")
def timeline_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline rows with the ids of related findings."""
    findings = with_nearest_ids(derived_findings(spark, sf_dir)).withColumn("evidence_summary", F.col("finding_id"))
    return timeline(findings).select(F.regexp_extract("summary", r"(F-\d+)$", 1).alias("finding_id"), F.array_join("related_finding_ids", ";").alias("related"))

