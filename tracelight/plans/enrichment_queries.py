"""Queries over proxies, indicators, networks, files, host detectors and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.operators import detectors as D
from tracelight.operators import enrich as E
from tracelight.operators import files as S
from tracelight.operators import rollups as U
from tracelight.operators.relations import FILE_CATEGORIES, file_context
from tracelight.operators.views import summary_views
from tracelight.plans.correlation_queries import FINDINGS_SQL, derived_findings
from tracelight.plans.registry import WEB_SQL, http_events, query, table, web_view
from tracelight.schema import DB_EVENT, FINDING, LINUX_EVENT, WINDOWS_EVENT, conform
from tracelight.sinks import writers
from tracelight.sources import binary, signatures


def _s(name: str) -> Column:
    return F.col(name).cast("string")


@query("trusted_proxy", "PRJ-01 PRJ-02 FN-05", f"""
WITH {WEB_SQL}, p AS (SELECT event_id, ip, user_id % 4 = 0 AS proxied, event_id % 4 AS k FROM web)
SELECT event_id, CASE WHEN NOT proxied OR k = 3 THEN NULL WHEN k = 0 THEN '198.51.100.' || (event_id % 200) WHEN k = 1 THEN '8.8.' || (event_id % 200) || '.1' ELSE '2001:db8::' || printf('%x', event_id % 200 + 1) END AS inferred_client_ip,
  CASE WHEN proxied AND k <> 3 THEN ip END AS proxy_ip FROM p""")
def trusted_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the peers are proxies; the header carries a chain, a Forwarded element or only proxies."""
    view = web_view(spark, sf_dir)
    k, n = F.col("event_id") % 4, (F.col("event_id") % 200)
    header = (
        F.when(k == 0, F.concat(F.lit("198.51.100."), n.cast("string"), F.lit(", 10.1.2.3")))
        .when(k == 1, F.concat(F.lit("for=10.0.0.1;proto=http, For=\"8.8."), n.cast("string"), F.lit(".1:443\"")))
        .when(k == 2, F.concat(F.lit("unknown, [2001:db8:0:0::"), F.lower(F.hex((n + 1).cast("bigint"))), F.lit("]:9"))).otherwise("10.0.0.5, 10.9.9.9")
    )
    proxied = F.col("user_id") % 4 == 0
    networks = ["10.0.0.0/8", "192.168.0.0/16"]
    events = http_events(view).join(view.select(F.col("event_id").alias("line_number"), header.alias("h"), proxied.alias("p"), F.col("ip").alias("peer")), "line_number")
    # proxied users sit behind addresses of the trusted range
    staged = events.withColumn("xff_ip", F.col("h")).withColumn("remote_ip", F.when(F.col("p"), F.regexp_replace("remote_ip", r"^203\.0\.", "10.77.")).otherwise(F.col("remote_ip")))
    done = E.infer_clients(staged, networks)
    return done.select(F.col("line_number").alias("event_id"), "inferred_client_ip", F.regexp_replace("proxy_ip", r"^10\.77\.", "203.0.").alias("proxy_ip"))


def _indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of five kinds derived from the events."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    c = F.col("user_id")
    ip = F.concat(F.lit("203.0."), F.expr("cast((user_id div 256) % 256 as string)"), F.lit("."), (c % 256).cast("string"))
    rows = [
        users.where(c % 10 == 3).select((c * 10).alias("seq"), F.lit("ip").alias("indicator_type"), F.concat(F.lit("::ffff:"), ip).alias("value")),
        users.where(c % 64 == 32).select((c * 10 + 1).alias("seq"), F.lit("cidr").alias("indicator_type"), F.concat(ip, F.lit("/28")).alias("value")),
        users.where(c < 4).select((c * 10 + 2).alias("seq"), F.lit("domain").alias("indicator_type"), F.concat(F.lit("H"), c.cast("string"), F.lit(".example.com.")).alias("value")),
        users.where(c < 12).select((c * 10 + 3).alias("seq"), F.lit("url_path").alias("indicator_type"), F.concat(F.lit("/item/"), c.cast("string")).alias("value")),
        users.where(c == 0).select((c * 10 + 4).alias("seq"), F.lit("url_path").alias("indicator_type"), F.lit("/Account/").alias("value")),
        users.where(c == 0).select((c * 10 + 5).alias("seq"), F.lit("user_agent").alias("indicator_type"), F.lit("QLMap/1").alias("value")),
    ]
    table_ = rows[0]
    for r in rows[1:]:
        table_ = table_.unionByName(r)
    confidence = F.when(F.col("indicator_type") == "ip", "high").when(F.col("indicator_type") == "cidr", "weak").otherwise("medium")
    return table_.withColumn("source", F.lit("derived")).withColumn("confidence", confidence).withColumn("tags", F.lit("")).withColumn("description", F.lit(""))


_IOC_SQL = f"""
{WEB_SQL}, u AS (SELECT DISTINCT user_id AS i FROM events),
w AS (SELECT *, 'www.h' || (user_id % 9) || '.example.com' AS host FROM web),
hit AS (
  SELECT event_id, i * 10 AS seq, 'remote_ip' AS field, 15 AS delta FROM w JOIN u ON i = user_id WHERE i % 10 = 3
  UNION ALL SELECT event_id, i * 10 + 1, 'remote_ip', 5 FROM w JOIN u ON i // 16 = user_id // 16 WHERE i % 64 = 32
  UNION ALL SELECT event_id, i * 10 + 2, 'host', 10 FROM w JOIN u ON i = user_id % 9 WHERE i < 4
  UNION ALL SELECT event_id, i * 10 + 3, 'uri_path', 10 FROM w JOIN u ON path = '/item/' || i WHERE i < 12
  UNION ALL SELECT event_id, 4, 'uri_path', 10 FROM w WHERE path LIKE '/account/%'
  UNION ALL SELECT event_id, 5, 'user_agent', 10 FROM w WHERE agent LIKE 'sqlmap%')"""


def _hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = web_view(spark, sf_dir)
    host = view.select(F.col("event_id").alias("line_number"), F.concat(F.lit("WWW.h"), (F.col("user_id") % 9).cast("string"), F.lit(".example.com:8080")).alias("_h"))
    return http_events(view).join(host, "line_number").withColumn("host", F.col("_h")).drop("_h")


@query("ioc_hits", "JN-09 DET-20 FN-13 FN-14", f"WITH {_IOC_SQL} SELECT event_id, seq, field AS matched_field, delta AS score_delta FROM hit")
def ioc_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = E.ioc_matches(E.ioc_candidates(_hosted(spark, sf_dir)), _indicators(spark, sf_dir))
    return matches.select(F.col("evidence_line").alias("event_id"), "seq", "matched_field", "score_delta")


@query("ioc_finding_scores", "DET-20 PRJ-11 WIN-08", f"""
WITH {_IOC_SQL} SELECT field AS matched_field, least(40, 20 + delta) AS score, count(*) AS findings FROM hit GROUP BY 1, 2""")
def ioc_finding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = E.ioc_findings(E.ioc_matches(E.ioc_candidates(_hosted(spark, sf_dir)), _indicators(spark, sf_dir)))
    field = F.regexp_extract("evidence_summary", r" matched (\w+)\.", 1)
    return findings.groupBy(field.alias("matched_field"), "score").agg(F.count(F.lit(1)).alias("findings"))


def _networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping networks in an order where a wide one may come first."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    c = F.col("user_id")
    ip = F.concat(F.lit("203.0."), F.expr("cast((user_id div 256) % 256 as string)"), F.lit("."), (c % 256).cast("string"))
    width = F.when(c % 3 == 0, 26).when(c % 3 == 1, 29).otherwise(31)
    return users.where(c % 5 == 2).select(
        F.concat(ip, F.lit("/"), width.cast("string")).alias("network"), ((c * 7919) % 1009).alias("file_order"), F.concat(F.lit("C"), (c % 6).cast("string")).alias("country"),
        F.lit("").alias("region"), F.lit("").alias("city"), F.concat(F.lit("AS"), c.cast("string")).alias("asn"), F.lit("org").alias("as_org"))


_GEO_SQL = f"""
{WEB_SQL}, u AS (SELECT DISTINCT user_id AS i FROM events),
net AS (SELECT i, (i * 7919) % 1009 AS file_order, CASE i % 3 WHEN 0 THEN 64 WHEN 1 THEN 8 ELSE 2 END AS size, 'C' || (i % 6) AS country, 'AS' || i AS asn FROM u WHERE i % 5 = 2),
geo AS (SELECT u.i AS user_id, arg_min(net.country, file_order) AS country, arg_min(net.asn, file_order) AS asn FROM u JOIN net ON u.i // size = net.i // size GROUP BY 1)"""


@query("geo_first_match", "JN-11", f"WITH {_GEO_SQL} SELECT DISTINCT ip, country, asn FROM web JOIN geo USING (user_id)")
def geo_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    addresses = web_view(spark, sf_dir).select("ip")
    return E.first_network(addresses, "ip", _networks(spark, sf_dir)).select("ip", "country", "asn")


def _ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = web_view(spark, sf_dir)
    null = F.lit(None).cast("string")
    db = conform(view.where(F.col("event_type") == "purchase").select(F.col("stamp").alias("timestamp"), F.col("ip").alias("client_ip")), DB_EVENT)
    ioc = conform(view.where(F.col("event_type") == "view").select(F.col("stamp").alias("timestamp"), F.col("ip").alias("remote_ip"), (F.lit(20) + F.col("event_id") % 21).cast("int").alias("score")), FINDING)
    http = http_events(view.where(~F.col("event_type").isin("purchase", "view"))).withColumn("proxy_ip", F.when(F.col("line_number") % 2 == 0, "10.0.0.1")).withColumn("client_ip_source", null)
    return U.ip_enrichment(http, db, ioc, _networks(spark, sf_dir))


@query("ip_enrichment", "AGG-05 SET-04", f"""
WITH {_GEO_SQL}
SELECT ip, min(stamp) AS first_seen, max(stamp) AS last_seen, count(*) FILTER (event_type NOT IN ('purchase', 'view')) AS request_count,
  count(*) FILTER (event_type = 'view') AS finding_count, max(CASE WHEN event_type = 'view' THEN 20 + event_id % 21 ELSE 0 END) AS max_score,
  string_agg(DISTINCT CASE event_type WHEN 'purchase' THEN 'db' WHEN 'view' THEN 'ioc' ELSE 'http' END, ';' ORDER BY CASE event_type WHEN 'purchase' THEN 'db' WHEN 'view' THEN 'ioc' ELSE 'http' END) AS sources,
  coalesce(max(CASE WHEN event_type NOT IN ('purchase', 'view') AND event_id % 2 = 0 THEN '10.0.0.1' END), '') AS proxy_ips, coalesce(any_value(country), '') AS country
FROM web LEFT JOIN geo USING (user_id) GROUP BY ip""")
def ip_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ips(spark, sf_dir).select("ip", "first_seen", "last_seen", "request_count", "finding_count", F.col("max_score").cast("bigint").alias("max_score"), "sources", "proxy_ips", "country")


@query("country_asn_summary", "AGG-06 AGG-07", f"""
WITH {_GEO_SQL},
i AS (SELECT ip, count(*) FILTER (event_type NOT IN ('purchase', 'view')) AS r, count(*) FILTER (event_type = 'view') AS f, coalesce(any_value(country), 'unknown') AS country, coalesce(any_value(asn), 'unknown') AS asn
  FROM web LEFT JOIN geo USING (user_id) GROUP BY ip)
SELECT country AS name, count(*) AS ip_count, CAST(sum(r) AS BIGINT) AS request_count, CAST(sum(f) AS BIGINT) AS finding_count FROM i GROUP BY 1
UNION ALL SELECT asn, count(*), CAST(sum(r) AS BIGINT), CAST(sum(f) AS BIGINT) FROM i GROUP BY 1""")
def country_asn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ips = _ips(spark, sf_dir)
    pick = lambda df, name: df.groupBy(F.col(name).alias("name")).agg(*[F.sum(c).alias(c) for c in ("ip_count", "request_count", "finding_count")])
    return pick(U.country_summary(ips), "country").unionByName(pick(U.asn_summary(ips), "asn"))


@query("file_context", "JN-08", f"""
WITH {WEB_SQL},
h AS (SELECT event_id, sec FROM web WHERE event_type = 'click' AND query LIKE '%UNION%'),
f AS (SELECT event_id AS seq, sec, '/var/www/f' || (event_id % 40) || '.php' AS path, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS rank FROM web WHERE event_type = 'view'),
m AS (SELECT h.event_id, path, min((rank, seq)) AS best FROM h JOIN f ON abs(h.sec - f.sec) <= 600 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY best) AS n FROM m)
SELECT event_id, CAST(n AS INTEGER) AS n, path, CASE WHEN best[1] = 0 THEN 15 ELSE 10 END AS boost FROM r WHERE n <= 3""")
def file_context_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = web_view(spark, sf_dir)
    files = view.where(F.col("event_type") == "view").select(
        F.concat(F.lit("/var/www/f"), (F.col("event_id") % 40).cast("string"), F.lit(".php")).alias("path"), F.col("stamp").alias("modified_at"), F.lit("changed").alias("reason"),
        F.col("event_id").alias("seq"))
    findings = derived_findings(spark, sf_dir).withColumn("category", F.when(F.col("category") == "sqli", FILE_CATEGORIES[0]).otherwise("other"))
    notes = file_context(findings, files.where(F.col("seq") % 3 == 0), files.where(F.col("seq") % 3 != 0))
    return notes.select(F.regexp_extract("id", r"F-0*(\d+)$", 1).cast("bigint").alias("event_id"), "n", "path", "boost")


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents as files; some documents carry script fragments."""
    d = F.col("doc_id")
    code = (
        F.when(d % 50 == 1, "\n<?php eval(base64_decode($_POST['x'])); ?>").when(d % 50 == 2, "\nretrieval(x); medieval(y)")
        .when(d % 50 == 3, "\nRuntime.getRuntime().exec(request.getParameter(\"c\"))").when(d % 50 == 4, F.concat(F.lit("\n"), F.repeat(F.lit("QUJD"), 40)))
        .when(d % 50 == 5, "\npreg_replace('/a/e', $b)").otherwise("")
    )
    ext = F.when(d % 10 == 1, ".php").when(d % 10 == 2, ".jpg").when(d % 10 == 3, ".jpg.php").otherwise(".txt")
    docs = table(spark, sf_dir, "documents").select(
        d.alias("id"), F.concat(F.lit("/srv/doc"), d.cast("string"), ext).alias("path"), F.encode(F.concat("text", code), "UTF-8").alias("content"))
    pages = table(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("id"), F.concat(F.lit("/srv/upload"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return docs.unionByName(pages)


_CONTENT_SQL = """
fs AS (
  SELECT doc_id AS id, text || CASE doc_id % 50 WHEN 1 THEN chr(10) || '<?php eval(base64_decode($_POST[''x''])); ?>' WHEN 2 THEN chr(10) || 'retrieval(x); medieval(y)'
      WHEN 3 THEN chr(10) || 'Runtime.getRuntime().exec(request.getParameter("c"))' WHEN 4 THEN chr(10) || repeat('QUJD', 40) WHEN 5 THEN chr(10) || 'preg_replace(''/a/e'', $b)' ELSE '' END AS body,
    CASE doc_id % 10 WHEN 1 THEN 'php' WHEN 2 THEN 'jpg' WHEN 3 THEN 'php' ELSE 'txt' END AS ext, doc_id % 10 = 3 AS double_ext, false AS named FROM documents
  UNION ALL SELECT -page_id - 1, html, 'html', false, true FROM pages)"""


@query("entropy", "FN-10", f"""
WITH {_CONTENT_SQL},
b AS (SELECT id, unnest(regexp_extract_all(hex(encode(body)), '..')) AS byte FROM fs), g AS (SELECT id, byte, count(*) AS n FROM b GROUP BY 1, 2),
t AS (SELECT id, sum(n) AS total FROM g GROUP BY 1), e AS (SELECT id, -sum((n / total) * log2(n / total)) AS entropy FROM g JOIN t USING (id) GROUP BY 1)
SELECT id, round(entropy, 6) AS entropy, CAST(coalesce(list_max(list_transform(regexp_extract_all(body, '[A-Za-z0-9+/=]+'), lambda r: len(r))), 0) AS INTEGER) AS base64_run
FROM fs JOIN e USING (id)""")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = _content(spark, sf_dir).select("id", S.content_measures(F.col("content")).alias("m"))
    return measured.select("id", F.round("m.entropy", 6).alias("entropy"), F.col("m.base64_run").alias("base64_run"))


def _rx(*words: str) -> str:
    import re

    return "|".join(re.escape(w).replace("'", "''") for w in words)


@query("script_signals", "PRJ-18 PRJ-19 PRJ-20", f"""
WITH {_CONTENT_SQL},
s AS (SELECT *, lower(body) AS low FROM fs),
x AS (SELECT id, ext, double_ext, named, body,
  regexp_matches(low, 'scriptenginemanager') OR regexp_matches(low, '(^|[^a-z0-9_])({"|".join(S.DYNAMIC_CALLS)})\\(') OR regexp_matches(low, 'preg_replace\\s*\\(\\s*[''"][^''"]*/e') AS dyn,
  regexp_matches(low, '{_rx(*S.COMMAND_WORDS)}') OR regexp_matches(low, '(^|[^a-z0-9_])({"|".join(S.COMMAND_CALLS)})\\(') AS cmd,
  regexp_matches(low, '{_rx(*S.REFLECTION_WORDS)}') AS refl, regexp_matches(low, '{_rx(*S.INPUT_WORDS)}') AS input FROM s)
SELECT id, dyn AS dynamic_execution, cmd AS command_execution, refl AS reflection, input AND (dyn OR cmd OR refl) AS http_param_bridge, named AS suspicious_filename,
  ext = 'php' AS high_risk_extension, double_ext AS double_extension, ext = 'jpg' AS magic_mismatch FROM x""")
def script_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked = S.inspect_files(_content(spark, sf_dir))
    return looked.select("id", "dynamic_execution", "command_execution", "reflection", "http_param_bridge", "suspicious_filename",
                         "high_risk_extension", "double_extension", "magic_mismatch")


@query("static_file_scores", "PRJ-17 DET-18 SRC-27")
def static_file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and findings of all files; the signals they add up are checked by ``script_signals`` and ``entropy``."""
    return S.webshell_findings(S.inspect_files(_content(spark, sf_dir)))


@query("tagged_strings", "SRC-39 PRJ-21", r"""
WITH t AS (SELECT doc_id, text || CASE doc_id % 9 WHEN 0 THEN chr(10) || 'see http://x.example/' || doc_id WHEN 1 THEN chr(10) || 'rm /tmp/' || doc_id || ' now' ELSE '' END AS body FROM documents),
s AS (SELECT doc_id, trim(unnest(regexp_extract_all(body, '[ -~]{8,}'))) AS str FROM t),
c AS (SELECT doc_id, str, lower(str) AS low FROM s WHERE len(str) >= 8)
SELECT doc_id, str AS text, CASE WHEN low LIKE '%http://%' OR low LIKE '%https://%' THEN 'url' WHEN low LIKE '%/tmp/%' OR low LIKE '%/dev/shm%' OR low LIKE '%\temp\%' OR low LIKE '%\users\public\%' THEN 'temp_path'
  WHEN regexp_matches(low, 'powershell|cmd\.exe|certutil|bitsadmin') THEN 'executor' WHEN low LIKE '%authorized_keys%' THEN 'ssh_artifact' WHEN low LIKE '%begin rsa private key%' OR low LIKE '%begin open ssh%' THEN 'private_key'
  WHEN low LIKE '%shadow%' THEN 'credential_artifact' ELSE 'base64_run' END AS tag
FROM c WHERE regexp_matches(low, 'https?://|/tmp/|/dev/shm|\\temp\\|\\users\\public\\|powershell|cmd\.exe|certutil|bitsadmin|authorized_keys|begin rsa private key|begin open ssh|shadow') OR regexp_matches(str, '^[A-Za-z0-9+/=]{64,}$')""")
def tagged_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    tail = F.when(d % 9 == 0, F.concat(F.lit("\nsee http://x.example/"), d.cast("string"))).when(d % 9 == 1, F.concat(F.lit("\nrm /tmp/"), d.cast("string"), F.lit(" now"))).otherwise("")
    files = table(spark, sf_dir, "documents").select(d.cast("string").alias("path"), F.encode(F.concat("text", tail), "UTF-8").alias("content"))
    return binary.extract_strings(files).select(F.col("source_file").cast("bigint").alias("doc_id"), "text", "tag")


_SIGNATURES = """
rule eval_php : web shell
{
  strings:
    $a = "eval("
    $b = "$_POST" nocase
  condition:
    any of them
}
rule plain_words {
  strings:
    $x = "the " nocase
}"""
_SIGNATURES_SQL = """m AS (
  SELECT id, 'plain_words' AS rule_name, len(regexp_extract_all(body, '(?i)the ')) AS match_count FROM fs
  UNION ALL SELECT id, 'eval_php', len(regexp_extract_all(body, 'eval\\(')) + len(regexp_extract_all(body, '(?i)\\$_POST')) FROM fs)"""


@query("signature_matches", "DET-19", f"""
WITH {_CONTENT_SQL}, {_SIGNATURES_SQL}
SELECT * FROM m WHERE match_count > 0""")
def signature_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = signatures.parse_literal_rules(_SIGNATURES, "local")
    files = _content(spark, sf_dir).withColumn("path", F.col("id").cast("string"))
    return signatures.signature_matches(files, rules).select(F.col("path").cast("bigint").alias("id"), "rule_name", F.col("match_count").cast("bigint").alias("match_count"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_type")
    code = F.when(k == "error", "4625").when(k == "signup", "4624").when(k == "click", "4688").when(k == "view", "4104").otherwise("1102")
    action = F.when(k == "error", "logon_failure").when(k == "signup", "logon_success").when(k == "click", "process_create").when(k == "view", "powershell").otherwise("log_clear")
    view = web_view(spark, sf_dir)
    odd = F.col("event_id") % 2 == 1
    return conform(view.select(
        F.col("stamp").alias("timestamp"), code.alias("event_code"), action.alias("action"), F.col("ip").alias("source_ip"), F.when(k == "click", F.when(odd, "C:\\w3wp.exe").otherwise("explorer")).alias("parent_process_name"),
        F.when(k == "click", "cmd.exe").alias("process_name"), F.when(k == "view", F.when(odd, "IEX (New-Object Net.WebClient)").otherwise("Get-Date")).alias("command_line_summary"),
        F.when(odd, "Security").otherwise("Application").alias("channel"), F.lit("host.evtx").alias("source_file"), F.col("event_id").alias("line_number"), F.sha2(_s("event_id"), 256).alias("raw_hash"),
        F.concat(F.lit("WIN-"), _s("event_id")).alias("event_id"), F.lit(0.9).alias("parser_confidence"), F.concat(F.lit("u"), _s("user_id")).alias("user")), WINDOWS_EVENT)


@query("windows_detectors", "DET-01 DET-02 DET-05 DET-06 FN-17", f"""
WITH {WEB_SQL}
SELECT event_id, CASE event_type WHEN 'click' THEN 'HOST-WINDOWS-EXECUTION-001' WHEN 'view' THEN 'HOST-WINDOWS-POWERSHELL-001' WHEN 'purchase' THEN 'HOST-WINDOWS-LOGCLEAR-001' ELSE 'HOST-WIN-REMOTE-LOGON-001' END AS rule_id,
  CASE event_type WHEN 'click' THEN 78 WHEN 'view' THEN 74 WHEN 'purchase' THEN 62 ELSE 58 END AS score FROM web WHERE event_type = 'signup' OR (event_type <> 'error' AND event_id % 2 = 1)""")
def windows_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _windows(spark, sf_dir)
    found = D.windows_event_findings(events).unionByName(D.remote_logon_findings(events))
    return found.select(F.col("line_number").alias("event_id"), "rule_id", "score")


def _linux(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, odd = F.col("event_type"), F.col("event_id") % 2 == 1
    action = F.when(k == "error", "login_failed").when(k == "signup", "login_success").when(k == "click", "execve").when(k == "view", "service_started").otherwise("cron")
    return conform(web_view(spark, sf_dir).select(
        F.col("stamp").alias("timestamp"), action.alias("action"), F.when(k.isin("error", "signup"), F.col("ip")).alias("src_ip"), F.lit("auth_log").alias("source"),
        F.when(odd, "www-data").otherwise("root").alias("user"), F.when(k == "click", "curl http://x").when(k == "purchase", F.when(odd, "CMD (python x.py)").otherwise("CMD (true)")).alias("command_line_summary"),
        F.when(k == "view", F.when(odd, "/tmp/.x.service").otherwise("nginx.service")).alias("object_path"), F.when(k == "view", F.lit("x.service")).alias("unit"), F.lit("auth.log").alias("source_file"),
        F.col("event_id").alias("line_number"), F.sha2(_s("event_id"), 256).alias("raw_hash"), F.concat(F.lit("LNX-"), _s("event_id")).alias("event_id"), F.lit(0.8).alias("parser_confidence")), LINUX_EVENT)


@query("linux_detectors", "DET-08 DET-09 DET-10 FN-17", f"""
WITH {WEB_SQL}
SELECT event_id, CASE event_type WHEN 'click' THEN 'HOST-LINUX-EXECUTION-001' WHEN 'view' THEN 'HOST-LINUX-PERSISTENCE-001' ELSE 'HOST-LINUX-CRON-001' END AS rule_id,
  CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 66 ELSE 64 END AS score FROM web WHERE event_type IN ('click', 'view', 'purchase') AND event_id % 2 = 1""")
def linux_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.linux_event_findings(_linux(spark, sf_dir)).select(F.col("line_number").alias("event_id"), "rule_id", "score")


@query("event_views", "PRJ-24 SET-02", f"""
WITH {WEB_SQL}
SELECT 'auth' AS view, count(*) AS rows_seen FROM (SELECT 1 FROM web UNION ALL SELECT 1 FROM web WHERE event_type IN ('error', 'signup'))
UNION ALL SELECT 'process', count(*) FROM (SELECT 1 FROM web WHERE event_type IN ('click', 'view') UNION ALL SELECT 1 FROM web WHERE event_type IN ('click', 'purchase'))
UNION ALL SELECT 'service', count(*) FROM web WHERE event_type = 'view'
UNION ALL SELECT 'scheduled_task', count(*) FROM web WHERE event_type = 'purchase'
UNION ALL SELECT 'powershell', count(*) FROM web WHERE event_type = 'view'""")
def event_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = summary_views(_windows(spark, sf_dir), _linux(spark, sf_dir))
    return writers.run_metrics(views).withColumnRenamed("stage", "view").withColumnRenamed("rows", "rows_seen")


@query("container_risks", "DET-14 DET-15 DET-16", f"""
WITH {WEB_SQL}
SELECT 'CONTAINER-RUNTIME-001' AS rule_id, 65 + 5 * ((event_type = 'error')::INT + (event_id % 2 = 0)::INT) AS score, count(*) AS findings FROM web WHERE event_type = 'error' OR event_id % 2 = 0 GROUP BY 2
UNION ALL SELECT 'CONTAINER-MOUNT-001', CASE WHEN event_type = 'error' THEN 68 ELSE 58 END, count(*) FROM web WHERE event_type IN ('error', 'view') GROUP BY 2
UNION ALL SELECT 'CONTAINER-LOG-001', 70, count(*) FROM web WHERE path LIKE '%../%'""")
def container_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = web_view(spark, sf_dir)
    k, even = F.col("event_type"), F.col("event_id") % 2 == 0
    base = [F.concat(F.lit("c"), _s("user_id")).alias("container_id"), F.lit("web").alias("container_name"), F.col("event_id").alias("line_number")]
    cs = view.select(*base, F.lit("img").alias("image"), F.when(k == "error", "TRUE").otherwise("no").alias("is_privileged"), F.when(even, "1").otherwise("0").alias("host_pid"), F.lit("false").alias("host_network"), F.lit("").alias("risk_flags"))
    ms = view.select(*base, F.lit("/a").alias("source"), F.lit("/b").alias("destination"), (k == "error").alias("is_sensitive"), F.when(k == "view", "web_root_mount").otherwise("").alias("risk_flags"))
    ls = view.select(*base, F.concat(F.lit("GET "), "path").alias("message_summary"), _s("event_id").alias("event_id"), F.lit("c.log").alias("source_file"), F.lit("h").alias("raw_hash"), F.col("stamp").alias("timestamp"))
    return D.container_findings(cs, ms, ls).groupBy("rule_id", "score").agg(F.count(F.lit(1)).alias("findings"))


@query("runtime_scores", "DET-17 FN-18", """
WITH p AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN 'broad_mapping' WHEN 1 THEN 'suspicious_name;baseline_new' WHEN 2 THEN 'fastcgi;other' ELSE 'broad_mapping;suspicious_class;handler_script_processor' END AS flags FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 55 WHEN 1 THEN 70 ELSE 100 END AS score,
  CASE WHEN p_size % 3 = 0 THEN 'RUNTIME-SPRING-MAPPING-001' WHEN p_size % 3 = 1 THEN 'RUNTIME-IIS-MODULE-001' ELSE 'RUNTIME-JAVA-COMPONENT-001' END AS rule_id FROM p WHERE p_partkey % 4 <> 2""")
def runtime_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey") % 4, F.col("p_size") % 3
    rows = table(spark, sf_dir, "part").select(
        F.when(s == 0, "spring").when(s == 1, "aspnet").otherwise("tomcat").alias("runtime_type"), F.lit("x").alias("component_type"), F.col("p_name").alias("name"), F.lit("").alias("class_name"),
        F.when(k == 0, "broad_mapping").when(k == 1, "suspicious_name;baseline_new").when(k == 2, "fastcgi;other").otherwise("broad_mapping;suspicious_class;handler_script_processor").alias("risk_flags"),
        F.lit("unknown").alias("mtime"), F.lit("f").alias("source_file"), F.col("p_partkey").alias("line_number"), F.lit("").alias("route_or_pattern"), F.lit("").alias("sha256"))
    return D.runtime_findings(rows).select(F.col("line_number").alias("p_partkey"), "score", "rule_id")


@query("ransom_names", "DET-13", f"""
WITH {WEB_SQL}, f AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '/srv/README_RESTORE_' || event_id || '.txt' WHEN 1 THEN '/srv/a' || event_id || '.docx.Locked' WHEN 2 THEN '/srv/b.lockedx' ELSE path END AS path FROM web)
SELECT path, CASE WHEN path LIKE '%README%' THEN 80 ELSE 74 END AS score FROM f WHERE event_id % 5 IN (0, 1)""")
def ransom_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("event_id") % 5, _s("event_id")
    path = F.when(k == 0, F.concat(F.lit("/srv/README_RESTORE_"), e, F.lit(".txt"))).when(k == 1, F.concat(F.lit("/srv/a"), e, F.lit(".docx.Locked"))).when(k == 2, "/srv/b.lockedx").otherwise(F.col("path"))
    files = web_view(spark, sf_dir).select(path.alias("path"))
    found = D.ransom_findings([("temp_files", files)], limit=None)
    return found.select(F.regexp_extract("evidence_summary", "`([^`]*)`", 1).alias("path"), "score")


@query("csv_guard", "SNK-02", """
WITH c AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '=HYPERLINK(' || event_id || ')' WHEN 1 THEN '-cmd' WHEN 2 THEN '-' WHEN 3 THEN '+1' WHEN 4 THEN '@x' ELSE event_type END AS cell FROM events)
SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 3, 4) THEN '''' || cell ELSE cell END AS cell FROM c""")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    cell = F.when(k == 0, F.concat(F.lit("=HYPERLINK("), _s("event_id"), F.lit(")"))).when(k == 1, "-cmd").when(k == 2, "-").when(k == 3, "+1").when(k == 4, "@x").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", writers.guard_formula(cell).alias("cell"))


@query("sarif_results", "SNK-04", f"""
WITH {FINDINGS_SQL}
SELECT id AS finding_id, 'R-' || e.event_type AS rule_id, CASE WHEN score >= 70 THEN 'error' WHEN score >= 50 THEN 'warning' ELSE 'note' END AS level, fnd.file AS uri FROM fnd JOIN events e USING (event_id)""")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = writers.sarif_results(derived_findings(spark, sf_dir))
    get = lambda p: F.get_json_object("result", p)
    return rows.select("finding_id", get("$.ruleId").alias("rule_id"), get("$.level").alias("level"), get("$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"))


@query("sarif_rules", "SNK-04", f"""
WITH {FINDINGS_SQL}
SELECT 'R-' || event_type AS rule_id, 'rule of ' || event_type AS name, count(*) > 0 AS used FROM events GROUP BY 1, 2""")
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = writers.sarif_rules(derived_findings(spark, sf_dir))
    return rules.select("rule_id", F.get_json_object("descriptor", "$.name").alias("name"), F.lit(True).alias("used"))


@query("suspicious_events", "SNK-05 JN-10", f"""
WITH {FINDINGS_SQL} SELECT id AS finding_id, w.path AS uri_path, w.status AS status, w.agent AS user_agent FROM fnd JOIN web w USING (event_id) WHERE kind = 'access_log'""")
def suspicious_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = http_events(web_view(spark, sf_dir))
    rows = writers.suspicious_events(derived_findings(spark, sf_dir), events, "access_log", ["uri_path", "status", "user_agent"])
    return rows.select("finding_id", "uri_path", "status", "user_agent")


@query("run_metrics", "SNK-06", f"""
WITH {FINDINGS_SQL} SELECT 'events' AS stage, count(*) AS "rows" FROM events UNION ALL SELECT 'findings', count(*) FROM fnd UNION ALL SELECT 'high', count(*) FROM fnd WHERE score >= 70""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = derived_findings(spark, sf_dir)
    return writers.run_metrics({"events": table(spark, sf_dir, "events"), "findings": findings, "high": U.high_risk_events(findings)})
