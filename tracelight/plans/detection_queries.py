"""Queries over windows, rules, findings and brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.functions import assess
from tracelight.operators.allowlist import Allowlist, Suppression
from tracelight.operators.brute_force import brute_force
from tracelight.operators.detectors import fanout
from tracelight.operators.findings import group_findings, match_rules, shape_hits
from tracelight.operators.records import RecordSet, WINDOW_FIELDS, http_records, with_window_counts
from tracelight.operators.rollups import source_stats
from tracelight.plans.registry import WEB_SQL, clf_line, event_micros, http_events, query, table, web_view
from tracelight.rules.catalog import BUILTIN, WEB_RULES
from tracelight.rules.model import Adjustment, Condition, Rule
from tracelight.session import cut_lineage
from tracelight.sources.lines import lines_from
from tracelight.sources.web import parse_access

_BY_ID = {r.id: r for r in BUILTIN}

_FAILED_LOGINS_SQL = f"""
WITH {WEB_SQL},
fails AS (
  SELECT *, count(*) OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN 300 PRECEDING AND 300 FOLLOWING) AS n5
  FROM web WHERE method = 'POST' AND status IN (401, 403)),
grp AS (
  SELECT file, ip, path, sec // 300 AS bucket, max(CASE WHEN n5 >= 5 THEN 60 ELSE 35 END) AS score,
    arg_min(stamp, event_id) AS stamp, arg_min(sec, event_id) AS sec
  FROM fails GROUP BY 1, 2, 3, 4)
SELECT ip AS remote_ip, count(*) AS findings, CAST(sum(score) AS BIGINT) AS total_score, max(score) AS max_score,
  CASE WHEN max(score) >= 50 THEN 'medium' ELSE 'low' END AS highest_severity, 'brute_force' AS categories,
  string_agg(DISTINCT path, ';' ORDER BY path) AS top_paths, arg_min(stamp, sec) AS first_seen, arg_max(stamp, sec) AS last_seen
FROM grp GROUP BY ip"""


@query("failed_login_sources", "SRC-01 SRC-03 WIN-01 WIN-04 WIN-05 WIN-08 FLT-01 PRJ-12 AGG-01 AGG-02 ORD-02", _FAILED_LOGINS_SQL)
def failed_login_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: log lines to typed events, windowed failure counts, rule, findings, source statistics."""
    web = web_view(spark, sf_dir)
    lines = lines_from(web, clf_line(), F.col("file"), F.col("event_id"))
    events = cut_lineage(parse_access(lines).events)  # typed events are written once and read several times
    hits = shape_hits(match_rules(http_records(events), [_BY_ID["WEB-BRUTE-001"]]))
    findings = cut_lineage(group_findings(hits, WEB_RULES, number=False))
    return source_stats(findings).select(
        "remote_ip", "findings", "total_score", "max_score", "highest_severity", "categories", "top_paths", "first_seen", "last_seen"
    )


@query("window_counts_5m", "WIN-01 WIN-02 WIN-03 WIN-04", f"""
WITH {WEB_SQL}, w AS (
  SELECT event_id,
    count(*) OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN 300 PRECEDING AND 300 FOLLOWING) AS same_ip_request_count_5m,
    count(*) OVER (PARTITION BY ip, path ORDER BY sec RANGE BETWEEN 300 PRECEDING AND 300 FOLLOWING) AS same_ip_same_path_count_5m,
    count(*) FILTER (status = 404) OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN 300 PRECEDING AND 300 FOLLOWING) AS same_ip_404_count_5m,
    count(*) FILTER (status IN (401, 403)) OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN 300 PRECEDING AND 300 FOLLOWING) AS same_ip_login_fail_count_5m
  FROM web)
SELECT * FROM w""")
def window_counts_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = with_window_counts(http_events(web_view(spark, sf_dir)))
    return counted.select(F.col("line_number").alias("event_id"), *WINDOW_FIELDS)


@query("tumbling_hits", "WIN-05 AGG-01 AGG-18", f"""
WITH {WEB_SQL}
SELECT ip, path, sec // 300 AS bucket, count(*) AS hits, min(event_id) AS first_event, max(status) AS worst_status,
  arg_max(event_id, (value, event_id)) AS largest_event
FROM web GROUP BY 1, 2, 3""")
def tumbling_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = web_view(spark, sf_dir).withColumn("bucket", F.expr("sec div 300"))
    return web.groupBy("ip", "path", "bucket").agg(
        F.count(F.lit(1)).alias("hits"), F.min("event_id").alias("first_event"), F.max("status").alias("worst_status"),
        F.max_by("event_id", F.struct("value", "event_id")).alias("largest_event"),
    )


@query("brute_force_sources", "AGG-08 AGG-09 DET-07 DET-11 WIN-06 JN-17", f"""
WITH {WEB_SQL},
f AS (SELECT user_id, us // 1000 AS ms, lag(us // 1000, 4) OVER (PARTITION BY user_id ORDER BY us, event_id) AS fifth
      FROM web WHERE event_type = 'error'),
t AS (SELECT user_id, min(ms) AS trigger_at, arg_min(fifth, ms) AS first_failure_at FROM f WHERE ms - fifth <= 600000 GROUP BY 1)
SELECT t.user_id AS source, trigger_at, first_failure_at,
  EXISTS (SELECT 1 FROM web w WHERE w.user_id = t.user_id AND w.event_type = 'signup'
          AND w.us // 1000 BETWEEN first_failure_at AND first_failure_at + 600000) AS later_success,
  CAST(0 AS BIGINT) AS untimed_failures
FROM t""")
def brute_force_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = web_view(spark, sf_dir).where(F.col("event_type").isin("error", "signup"))
    attempts = web.select(
        F.col("user_id").alias("source"), F.expr("us div 1000").alias("at"), (F.col("event_type") == "error").alias("failed")
    )
    return brute_force(attempts).select("source", "trigger_at", "first_failure_at", "later_success", "untimed_failures")


@query("fanout_sources", "AGG-10 DET-12", """
WITH p AS (SELECT DISTINCT l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 40 ELSE l_partkey % 4 END AS target, l_orderkey AS sub FROM lineitem),
g AS (SELECT l_suppkey, target, count(*) AS subs FROM p GROUP BY 1, 2),
s AS (SELECT l_suppkey, count(*) AS distinct_targets, min(CASE WHEN subs >= 15 THEN target END) AS probed FROM g GROUP BY 1)
SELECT s.l_suppkey AS source, distinct_targets, distinct_targets >= 10 AS is_fanout,
  CASE WHEN distinct_targets < 10 THEN probed END AS probed_target, CASE WHEN distinct_targets < 10 THEN g.subs END AS distinct_subs
FROM s LEFT JOIN g ON g.l_suppkey = s.l_suppkey AND g.target = s.probed
WHERE distinct_targets >= 10 OR probed IS NOT NULL""")
def fanout_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    target = F.when(F.col("l_suppkey") % 3 == 0, part % 40).otherwise(part % 4)
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), target.alias("target"), F.col("l_orderkey").alias("sub"))
    return fanout(items, "source", "target", "sub")


# every operator of the rule language once
LANGUAGE_RULES = [
    Rule("LANG-ALL-NOT", "all and not", "language", Condition(
        all=(Condition(field="event_type", equals="ERROR"),), negated=Condition(field="value", gt=100.0)), source="events", base=20,
        add=(Adjustment(Condition(field="value", lt=10.0), 30, "small"), Adjustment(Condition(field="user_id", values=("3", "4", "5")), 15, None)),
        subtract=(Adjustment(Condition(field="k", gte=50.0), 25, "high k"),)),
    Rule("LANG-ANY", "any", "language", Condition(any=(
        Condition(field="props", contains='"k": 7'), Condition(field="event_type", contains_any=("purch", "nothing")))), source="events", base=65,
        add=(Adjustment(Condition(field="props", regex=r"\d{2}"), 40, "two digits"),)),
    Rule("LANG-RANGE", "range", "language", Condition(field="value", gte=50.0, lte=60.0), source="events", severity="high"),
    Rule("LANG-STATUS", "status", "language", Condition(status_in=(403, 404), negated=Condition(field="absent", regex="x")), source="events", base=90,
         add=(Adjustment(Condition(field="event_type", equals="signup"), 20, "clamped"),)),
]


@query("rule_match_events", "FLT-01 FLT-02 PRJ-10 PRJ-12", f"""
WITH {WEB_SQL}, r AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM web),
hits AS (
  SELECT event_id, 'LANG-ALL-NOT' AS rule_id, greatest(0, least(100, 20 + CASE WHEN value < 10 THEN 30 ELSE 0 END
    + CASE WHEN user_id IN (3, 4, 5) THEN 15 ELSE 0 END - CASE WHEN k >= 50 THEN 25 ELSE 0 END)) AS score
  FROM r WHERE event_type = 'error' AND NOT coalesce(value > 100, false)
  UNION ALL
  SELECT event_id, 'LANG-ANY', least(100, 65 + CASE WHEN regexp_matches(props, '[0-9]{{2}}') THEN 40 ELSE 0 END)
  FROM r WHERE props LIKE '%"k": 7%' OR event_type LIKE '%purch%'
  UNION ALL SELECT event_id, 'LANG-RANGE', 40 FROM r WHERE value BETWEEN 50 AND 60
  UNION ALL SELECT event_id, 'LANG-STATUS', CASE WHEN event_type = 'signup' THEN 100 ELSE 90 END FROM r WHERE status IN (403, 404))
SELECT event_id, rule_id, score, CASE WHEN score < 30 THEN 'info' WHEN score < 50 THEN 'low' WHEN score < 70 THEN 'medium'
  WHEN score < 90 THEN 'high' ELSE 'critical' END AS severity FROM hits""")
def rule_match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = web_view(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k"))
    fields = ["event_id", "event_type", "user_id", "value", "props", "k", "status"]
    records = RecordSet(web.select(*[F.col(c).cast("string").alias(c) for c in fields]), "events", "props")
    hits = match_rules(records, LANGUAGE_RULES)
    return hits.select(F.col("event_id").cast("bigint"), "rule_id", "score", assess.severity(F.col("score")).alias("severity"))


def _sql_regex(rule_id: str) -> str:
    return _BY_ID[rule_id].match.regex.replace("'", "''")


def _flag_sum(condition: str, points: int) -> str:
    return f"CASE WHEN {condition} THEN {points} ELSE 0 END"


_REQUEST = "method || ' ' || path || ' ' || coalesce(query, '') || ' ' || agent"
_WEB_RULES_SQL = f"""
WITH {WEB_SQL},
w AS (SELECT *, {_REQUEST} AS request,
    count(*) OVER (PARTITION BY ip, path ORDER BY sec RANGE BETWEEN 300 PRECEDING AND 300 FOLLOWING) AS np,
    count(*) FILTER (status = 404) OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN 300 PRECEDING AND 300 FOLLOWING) AS n404,
    count(*) FILTER (status IN (401, 403)) OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN 300 PRECEDING AND 300 FOLLOWING) AS nf
  FROM web),
hits AS (
  SELECT event_id, 'WEB-SQLI-001' AS rule_id, 55 + {_flag_sum('status IN (200,201,202,500)', 10)} + {_flag_sum('np >= 3', 10)} AS score
    FROM w WHERE regexp_matches(request, '{_sql_regex("WEB-SQLI-001")}')
  UNION ALL SELECT event_id, 'WEB-RCE-001', 65 + {_flag_sum('status IN (200,201,202,500)', 10)} + {_flag_sum('np >= 2', 10)}
    FROM w WHERE regexp_matches(request, '{_sql_regex("WEB-RCE-001")}')
  UNION ALL SELECT event_id, 'WEB-LFI-001', 55 + {_flag_sum('status IN (200,206,500)', 10)}
    FROM w WHERE regexp_matches(request, '{_sql_regex("WEB-LFI-001")}')
  UNION ALL SELECT event_id, 'WEB-SSRF-001', 55 + {_flag_sum('status IN (200,201,202,500)', 10)}
    FROM w WHERE regexp_matches(query, '{_sql_regex("WEB-SSRF-001")}')
  UNION ALL SELECT event_id, 'WEB-XSS-LOW-001', 35 + {_flag_sum('status IN (200,201,202)', 5)}
    FROM w WHERE regexp_matches(request, '{_sql_regex("WEB-XSS-LOW-001")}')
  UNION ALL SELECT event_id, 'WEB-UPLOAD-001', 50 + {_flag_sum('status IN (200,201,202,302)', 10)}
    FROM w WHERE method = 'POST' AND regexp_matches(path, '(?i)(upload|file|avatar|attachment|media|plugin|theme)')
  UNION ALL SELECT event_id, 'WEB-SCANNER-001', 35 + {_flag_sum('n404 >= 10', 10)}
    FROM w WHERE agent LIKE '%sqlmap%' OR (status = 404 AND n404 >= 10)
  UNION ALL SELECT event_id, 'WEB-BRUTE-001', 35 + {_flag_sum('nf >= 5', 25)}
    FROM w WHERE method = 'POST' AND regexp_matches(path, '(?i)(login|signin|auth|admin)') AND status IN (401, 403, 429)
  UNION ALL SELECT event_id, 'WEB-INFOLEAK-001', 50 + {_flag_sum('status IN (200,206,500)', 15)}
    FROM w WHERE regexp_matches(path, '{_sql_regex("WEB-INFOLEAK-001")}')
  UNION ALL SELECT event_id, 'WEB-FRAMEWORK-001', 60 + {_flag_sum('status IN (200,500)', 10)}
    FROM w WHERE regexp_matches(request, '{_sql_regex("WEB-FRAMEWORK-001")}'))
SELECT event_id, rule_id, score FROM hits"""


@query("builtin_web_rules", "FLT-01 PRJ-03 PRJ-12 WIN-01..04 rules/web", _WEB_RULES_SQL)
def builtin_web_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = match_rules(http_records(http_events(web_view(spark, sf_dir))), WEB_RULES)
    return hits.select(F.col("_line").alias("event_id"), "rule_id", "score")


_TEXT_RULES = ["APP-SQL-ERROR-001", "APP-SSRF-ERROR-001", "APP-DESERIALIZATION-001"]


@query("rules_on_documents", "FLT-01 PRJ-03 rules/app", f"""
SELECT doc_id, rule_id FROM (
  SELECT doc_id, 'APP-SQL-ERROR-001' AS rule_id FROM documents
    WHERE regexp_matches(trim(text), '{_BY_ID["APP-SQL-ERROR-001"].match.any[1].regex}')
  UNION ALL SELECT doc_id, 'APP-SSRF-ERROR-001' FROM documents
    WHERE regexp_matches(trim(text), '{_BY_ID["APP-SSRF-ERROR-001"].match.regex}')
  UNION ALL SELECT doc_id, 'APP-DESERIALIZATION-001' FROM documents
    WHERE regexp_matches(trim(text), '{_BY_ID["APP-DESERIALIZATION-001"].match.any[1].regex}'))""")
def rules_on_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.trim("text").alias("message_summary"))
    hits = match_rules(RecordSet(docs, "app_log", "message_summary"), [_BY_ID[r] for r in _TEXT_RULES])
    return hits.select("doc_id", "rule_id")


_PAD = 700  # repeats of eight characters: what decides lies beyond 5,000 characters


@query("rules_on_long_lines", "SRC-15 FLT-01 rules/app", f"""
SELECT doc_id FROM documents WHERE doc_id % 2 = 0 OR regexp_matches(text, '{_BY_ID["APP-SQL-ERROR-001"].match.any[1].regex}')""")
def rules_on_long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application lines of more than 5,000 characters whose last word is the one a rule looks for."""
    from tracelight.sources.app import parse_app

    docs = table(spark, sf_dir, "documents")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    line = F.concat(F.lit("1970-02-02 00:00:00 ERROR "), body, F.lit(" padding" * _PAD), F.when(F.col("doc_id") % 2 == 0, " SQLSTATE[42000]").otherwise(""))
    events = parse_app(lines_from(docs, line, "long.log", F.col("doc_id"))).events
    hits = match_rules(RecordSet(events.select(F.col("line_number").alias("doc_id"), "message_summary"), "app_log", "message_summary"), [_BY_ID["APP-SQL-ERROR-001"]])
    return hits.select("doc_id")


@query("detectors_on_long_commands", "SRC-20 DET-03", f"""
WITH {WEB_SQL} SELECT event_id, 'HOST-WINDOWS-POWERSHELL-001' AS rule_id, 74 AS score FROM web WHERE event_id % 3 = 0""")
def detectors_on_long_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script blocks of more than 5,000 characters with the telling call at their end."""
    from tracelight.operators.detectors import windows_event_findings
    from tracelight.sources.host_events import parse_windows_xml

    view = web_view(spark, sf_dir)
    tail = F.when(F.col("event_id") % 3 == 0, "(New-Object Net.WebClient).DownloadString()").otherwise("Get-Date")
    block = F.concat(F.lit('<Event><System><Provider Name="PowerShell"/><EventID>4104</EventID><TimeCreated SystemTime="'), F.col("stamp"),
                     F.lit('"/></System><EventData><Data Name="ScriptBlockText">'), F.lit("$a = 12;" * _PAD), tail, F.lit("</Data></EventData>"))
    records = view.select(F.lit("scripts.xml").alias("source_file"), block.alias("value"), F.col("event_id").alias("start_line"))
    found = windows_event_findings(parse_windows_xml(records).events)
    return found.select(F.col("line_number").alias("event_id"), "rule_id", F.col("score").cast("int").alias("score"))


_ALLOW = Allowlist(
    disabled_rules=["web-xss-low-001"], exact_paths=["/docs/./page.html"], path_prefixes=["/static/"],
    exact_ips=["203.0.0.7"], networks=["203.0.0.64/27"], user_agents=["SQLMAP"],
    suppressions=[Suppression(rule_id="WEB-BRUTE-001", path_prefix="/account/sign", source_ip="203.0.0.9")],
)


@query("allowlist_suppressed", "FLT-06 FN-05 FN-07", f"""
WITH {WEB_SQL},
hits AS (
  SELECT *, 'WEB-BRUTE-001' AS rule_id FROM web WHERE method = 'POST' AND status IN (401, 403)
  UNION ALL SELECT *, 'WEB-LFI-001' FROM web WHERE path LIKE '%../%'
  UNION ALL SELECT *, 'WEB-SQLI-001' FROM web WHERE query LIKE '%UNION+SELECT%')
SELECT event_id, rule_id,
  path = '/docs/page.html' OR ip = '203.0.0.7' OR (user_id BETWEEN 64 AND 95) OR agent LIKE 'sqlmap%'
  OR (rule_id = 'WEB-BRUTE-001' AND path LIKE '/account/sign%' AND ip = '203.0.0.9') AS suppressed
FROM hits""")
def allowlist_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [_BY_ID[r] for r in ("WEB-BRUTE-001", "WEB-LFI-001", "WEB-SQLI-001")]
    records = http_records(http_events(web_view(spark, sf_dir)), with_counts=False)
    hits = match_rules(records, rules, _ALLOW)
    return hits.select(F.col("_line").alias("event_id"), "rule_id", "suppressed")


@query("detection_window", "FLT-03 FLT-05 FLT-12", f"""
WITH {WEB_SQL}
SELECT event_type, count(*) AS kept FROM web WHERE stamp BETWEEN '1970-02-02T22:00:00Z' AND '1970-02-02T22:40:00Z' GROUP BY 1""")
def detection_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelight.operators.filters import resolve_window, time_filter

    window = resolve_window(until="1970-02-02T22:40:00Z", since="1970-02-02T22:00:00Z")
    return time_filter(web_view(spark, sf_dir), "stamp", window).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@query("numbered_events", "WIN-08", f"""
SELECT event_id, 'TL-' || lpad(CAST(row_number() OVER (ORDER BY ts, event_id) AS VARCHAR), 6, '0') AS timeline_id FROM events""")
def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelight.operators.ordered import numbered_ids

    events = table(spark, sf_dir, "events").select("event_id", event_micros().alias("us"))
    return numbered_ids(events, ["us", "event_id"], "TL", "timeline_id").select("event_id", "timeline_id")


@query("findings_full", "AGG-01 PRJ-11 PRJ-13 SET-01", f"""
{_WEB_RULES_SQL.rsplit('SELECT event_id, rule_id, score FROM hits', 1)[0]},
g AS (SELECT h.rule_id, w.file, w.ip, w.path, w.sec // 300 AS bucket, count(*) AS match_count, max(h.score) AS score,
        min(h.event_id) AS first_event, arg_max(h.event_id, (h.score, -h.event_id)) AS best_event
      FROM hits h JOIN w USING (event_id) GROUP BY ALL)
SELECT rule_id, file AS source_file, ip AS remote_ip, path AS uri_path, match_count, score, best_event AS line_number,
  CASE WHEN score >= 90 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS confidence,
  (SELECT stamp FROM web x WHERE x.event_id = g.first_event) AS timestamp FROM g""")
def findings_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = shape_hits(match_rules(http_records(http_events(web_view(spark, sf_dir))), WEB_RULES))
    return group_findings(hits, WEB_RULES, number=False).select(
        "rule_id", "source_file", "remote_ip", "uri_path", "match_count", "score", "line_number", "confidence", "timestamp"
    )
