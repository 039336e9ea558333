"""Operators against brute force on small random tables, and the boundary cases of their rules."""

from __future__ import annotations

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracelight.functions import assess
from tracelight.operators import baseline, detectors, gaps, relations, rollups
from tracelight.operators.allowlist import Allowlist
from tracelight.operators.bands import band_runs, band_sums
from tracelight.operators.brute_force import brute_force, logon_brute_force
from tracelight.operators.components import connected_components
from tracelight.operators.filters import resolve_window, time_filter
from tracelight.operators.findings import detect
from tracelight.operators.ordered import carry_forward, global_index, smallest_distinct
from tracelight.operators.records import WINDOW_FIELDS, http_records, with_window_counts
from tracelight.rules.catalog import BUILTIN
from tracelight.rules.model import RuleError, load_rules, parse_rules
from tracelight.schema import FINDING, HTTP_EVENT, LINUX_EVENT, WINDOWS_EVENT, conform

BASE = datetime.datetime(2026, 5, 15, 8, 0, 0)


def _stamp(seconds: float) -> str:
    return (BASE + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def _partition(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def marks(spark):
    random.seed(1)
    rows = [(i, random.choice(["a", "b", None]), random.randint(-500, 3000), random.randint(0, 2)) for i in range(600)]
    return rows, spark.createDataFrame(rows, "id long, k string, t long, w int").cache()


def test_band_sums_equal_brute_force(marks):
    rows, df = marks
    got = {(r.k, r.t): (r.n, r.s) for r in band_sums(df, ["k"], "t", {"n": F.lit(1), "s": F.col("w")}, 30, 17).collect()}
    want = {
        (k, t): (sum(1 for r in rows if r[1] == k and -30 <= r[2] - t <= 17), sum(r[3] for r in rows if r[1] == k and -30 <= r[2] - t <= 17))
        for _, k, t, _ in rows
    }
    assert got == want


@pytest.mark.parametrize("width,same", [(3, False), (8, True), (20, False)])
def test_band_runs_keep_the_components(marks, width, same):
    rows, df = marks
    small = df.where("id < 200").withColumn("side", F.col("w") >= 1)
    pts = [(r.id, r.k, r.t, r.side) for r in small.collect()]
    true = [(a[0], b[0]) for a, b in itertools.combinations(pts, 2) if a[1] == b[1] and abs(a[2] - b[2]) <= width and (a[3] != b[3] or (same and a[3]))]
    edges = [(r.src, r.dst) for r in band_runs(small, ["k"], "t", "id", "side", width, width, F.lit(same), chunk=2 * width).collect()]
    nodes = [p[0] for p in pts]
    assert _partition(true, nodes) == _partition(edges, nodes)
    assert len(edges) <= 3 * len(nodes)


def test_ordered_operators(marks):
    rows, df = marks
    got = {r.id: r.idx for r in global_index(df, ["t", "id"], "idx").collect()}
    assert got == {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1)}
    keyed = df.withColumn("k", F.coalesce("k", F.lit("z")))
    for r in carry_forward(keyed, "k", "id", {"last": F.when(F.col("w") == 2, F.col("id"))}, block=37).collect():
        seen = [x[0] for x in rows if (x[1] or "z") == r.k and x[0] <= r.id and x[3] == 2]
        assert r.last == (max(seen) if seen else None)
    top = {r.k: r.v for r in smallest_distinct(keyed, ["k"], F.lpad(F.col("id").cast("string"), 4, "0"), 3, "v").collect()}
    assert top["a"].split(";") == sorted(f"{r[0]:04d}" for r in rows if r[1] == "a")[:3]


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.member: r.component for r in connected_components(df).collect()}
    assert got == _partition(edges, {n for e in edges for n in e})


def _http(spark, rows):
    names = "timestamp string, source_file string, line_number long, remote_ip string, method string, uri_path string, uri_query string, status int, user_agent string"
    return conform(spark.createDataFrame(rows, names), HTTP_EVENT)


def test_window_counts_match_brute_force_and_skip_untimed(spark):
    random.seed(2)
    rows = []
    for i in range(150):
        t = None if random.random() < 0.1 else _stamp(random.uniform(0, 1500))
        rows.append((t, "a.log", i, random.choice(["1.1.1.1", "2.2.2.2", "", None]), "POST", random.choice(["/login", "/x", None]), None, random.choice([200, 401, 404]), None))
    rows += [(_stamp(3000), "a.log", 900, "9.9.9.9", "GET", "/b", None, 404, None), (_stamp(3300.999999), "a.log", 901, "9.9.9.9", "GET", "/b", None, 404, None),
             (_stamp(3301), "a.log", 902, "9.9.9.9", "GET", "/b", None, 404, None), ("garbage", "a.log", 903, "9.9.9.9", "GET", "/b", None, 404, None)]
    parse = lambda t: None if not t or t == "garbage" else datetime.datetime.strptime(t, "%Y-%m-%dT%H:%M:%S.%fZ")
    got = {r.line_number: tuple(r[f] for f in WINDOW_FIELDS) for r in with_window_counts(_http(spark, rows)).collect()}
    for row in rows:
        at, near = parse(row[0]), []
        if at and row[3]:
            near = [o for o in rows if o[3] == row[3] and parse(o[0]) and abs((parse(o[0]) - at).total_seconds()) < 301]
        want = (len(near), sum(o[5] == row[5] for o in near), sum(o[7] == 404 for o in near), sum(o[7] in (401, 403, 429) and (o[5] or "").startswith("/login") for o in near))
        assert got[row[2]] == want, row


def test_rules_to_findings(spark):
    rows = [(f"2026-05-15T08:00:{i:02d}Z", "a.log", i + 1, "203.0.113.9", "POST", "/login", None, 401, "curl") for i in range(6)]
    rows += [("2026-05-15T08:10:00Z", "a.log", 10, "198.51.100.7", "GET", "/search", "q=UNION+SELECT+1", 200, "sqlmap"),
             (None, "a.log", 11, "198.51.100.7", "POST", "/admin", None, 403, None), (None, "a.log", 12, "198.51.100.7", "POST", "/login", None, 302, None)]
    findings, hits = detect([http_records(_http(spark, rows))], BUILTIN, Allowlist.from_toml('[rules]\ndisabled = ["web-scanner-001"]'))
    got = {(r.rule_id, r.uri_path): r for r in findings.collect()}
    assert set(got) == {("WEB-BRUTE-001", "/login"), ("WEB-BRUTE-001", "/admin"), ("WEB-SQLI-001", "/search")}
    brute = got[("WEB-BRUTE-001", "/login")]
    assert (brute.score, brute.severity, brute.line_number, brute.score_breakdown.context_score) == (60, "medium", 1, 25)
    assert "6 records in all" in brute.evidence_summary and brute.finding_id == "F-000002"
    assert hits.where("suppressed").count() == 1


def test_contains_reads_the_decoded_view(spark):
    from tracelight.operators.findings import match_rules
    from tracelight.operators.records import RecordSet
    from tracelight.rules.model import Condition, Rule

    rule = Rule("A", "a", "c", Condition(field="q", contains="union select"), source="s")
    none = Rule("B", "b", "c", Condition(negated=Condition(field="missing", equals="x")), source="s")
    df = spark.createDataFrame([("q=UNION+SELECT",), ("union%20select",), ("union%2select",), (None,)], "q string")
    assert sorted((r.rule_id, r.q or "") for r in match_rules(RecordSet(df, "s", "q"), [rule, none]).collect() if r.rule_id == "A") == [
        ("A", "q=UNION+SELECT"), ("A", "union%20select")]


def test_rule_files(tmp_path):
    text = "rules:\n  - {id: X-1, name: n, category: c, match: {contains: a}, score: {base: 50, add: [{when: {status in: [200]}, value: 5}]}}\n"
    assert parse_rules(text)[0].add[0].when.status_in == (200,)
    with pytest.raises(RuleError, match="duplicate"):
        parse_rules(text + text.split("\n")[1] + "\n")
    with pytest.raises(RuleError, match="regex"):
        parse_rules("rules: [{id: a, name: n, category: c, match: {regex: '('}}]")
    with pytest.raises(RuleError, match="condition"):
        parse_rules("rules: [{id: a, name: n, category: c, match: {}}]")
    (tmp_path / "a.yml").write_text(text)
    (tmp_path / "b.yml").write_text(text + "# other content\n")
    with pytest.raises(RuleError, match="across"):
        load_rules([str(tmp_path)])
    (tmp_path / "b.yml").write_text(text)
    assert len(load_rules([str(tmp_path)])) == 2  # built-in plus one: equal content is loaded once
    assert len(BUILTIN) == 57


def test_brute_force_equals_a_direct_restatement(spark):
    random.seed(4)
    rows = [(f"s{random.randint(0, 25)}", random.randint(0, 200_000) * 100 if random.random() > 0.05 else None, random.random() < 0.7) for _ in range(900)]
    got = {r.source: (r.trigger_at, r.first_failure_at, r.later_success, r.untimed_failures) for r in brute_force(spark.createDataFrame(rows, "source string, at long, failed boolean")).collect()}
    want = {}
    for source in {r[0] for r in rows}:
        timed = sorted((a, f) for s, a, f in rows if s == source and a is not None)
        for i, (at, _) in enumerate(timed):
            window = [a for a, f in timed[: i + 1] if f and at - a <= 600_000]
            if len(window) >= 5:
                first = min(window)
                want[source] = (at, first, any(not f and first <= a <= first + 600_000 for a, f in timed), sum(1 for s, a, f in rows if s == source and a is None and f))
                break
    assert got == want and want


def test_success_outside_the_window_gives_no_uplift(spark):
    rows = [("logon_failure", _stamp(i), "1.2.3.4", i) for i in range(5)] + [("logon_success", _stamp(700), "1.2.3.4", 9), ("logon_failure", None, "1.2.3.4", 10)]
    events = conform(spark.createDataFrame(rows, "action string, timestamp string, source_ip string, line_number long"), WINDOWS_EVENT)
    row = logon_brute_force(events, "windows").head()
    assert (row.score, row.line_number) == (62, 0) and "1 further failed logon" in row.evidence_summary
    linux = conform(spark.createDataFrame([(a.replace("logon_failure", "login_failed").replace("logon", "login"), t, ip, n) for a, t, ip, n in rows[:5]] + [("login_success", _stamp(60), "1.2.3.4", 7)],
                                          "action string, timestamp string, src_ip string, line_number long"), LINUX_EVENT)
    assert logon_brute_force(linux, "linux").head().score == 80


def test_log_clear_and_scan(spark):
    events = conform(spark.createDataFrame([("log_clear", "Security"), ("log_clear", "Application")], "action string, channel string"), WINDOWS_EVENT)
    assert [r.score for r in detectors.windows_event_findings(events).collect()] == [62]
    wide = [("scan", f"10.0.0.{i}", "22", "ESTABLISHED") for i in range(12)] + [("ok", f"10.0.0.{i}", "22", "LISTEN") for i in range(12)] + [("probe", "10.0.0.1", str(p), "SYN_SENT") for p in range(15)]
    found = detectors.scan_findings(spark.createDataFrame(wide, "process_name string, remote_address string, remote_port string, state string"))
    assert sorted(r.evidence_summary.split("`")[1] for r in found.collect()) == ["probe", "scan"]


def _random_findings(spark, seed, n=140):
    random.seed(seed)
    kinds = ["access_log"] * 6 + ["waf_log", "app_log", "db_log", "process", "network", "persistence", "account", "file", "ioc", "linux_event", "container", "runtime"]
    rows = []
    for i in range(n):
        kind = random.choice(kinds)
        category = random.choice(["db_auth_failure", "db_delay", "other"]) if kind == "db_log" else random.choice(["sqli", "rce", "lfi", "scanner", "brute_force", "upload_webshell"])
        at = None if random.random() < 0.07 else random.randint(0, 9000)
        rows.append((f"F-{i:06d}", at, random.randint(20, 90), category, kind, random.choice(["1.1.1.1", "2.2.2.2", "::ffff:1.1.1.1", "-", None, "0.0.0.0"]),
                     random.choice(["/a", "/a/./", "/b", "", None]), random.choice([200, 500, 404, None])))
    frame = spark.createDataFrame([(r[0], None if r[1] is None else _stamp(r[1]), *r[2:]) for r in rows],
                                  "finding_id string, timestamp string, score int, category string, source_type string, remote_ip string, uri_path string, status int")
    full = conform(frame, FINDING).withColumn("score_breakdown", assess.breakdown()).withColumn("evidence_summary", F.lit("x")).withColumn("rule_id", F.lit("R")).withColumn("severity", F.lit("low"))
    return rows, full.cache()


def _relation(a, b):
    """Direct restatement of the pair rules: points for the HTTP side and the partner."""
    if a[1] is None or b[1] is None:
        return None
    d = abs(a[1] - b[1])
    h, o = (a, b) if a[4] == "access_log" else (b, a)
    if h[4] != "access_log":
        return None
    ip = lambda v: {"1.1.1.1": 1, "::ffff:1.1.1.1": 1, "2.2.2.2": 2}.get(v)
    path = lambda v: {"/a": "/a", "/a/./": "/a", "/b": "/b"}.get(v)
    hip, oip, hp, op = ip(h[5]), ip(o[5]), path(h[6]), path(o[6])
    same_ip, same_path = hip is not None and hip == oip, hp is not None and hp == op
    if o[4] == "waf_log":
        return (10, 5, h, o) if d <= 300 and (same_ip or same_path) else None
    if o[4] == "app_log":
        return (15, 10, h, o) if d <= 300 and (same_path or (h[7] or 0) // 100 == 5 or h[3] in relations.APP_CATEGORIES) else None
    if same_ip and d <= 120:
        return (5, 5, h, o)
    if o[4] in relations.HOST_TYPES:
        window, x, y = relations.HOST_TYPES[o[4]]
        veto = (hip and oip and hip != oip) or (hp and op and hp != op)
        return (x, y, h, o) if d <= window and not veto else None
    if o[4] == "db_log":
        return (15, 10, h, o) if h[3] in relations.DB_CATEGORIES and o[3].startswith("db_") and d <= (900 if o[3] == "db_auth_failure" else 300) else None
    if o[4] == "file":
        return (20, 10, h, o) if h[3] in relations.FILE_CATEGORIES and d <= 600 else None
    return None


@pytest.mark.parametrize("seed", [3, 8])
def test_correlation_without_pairs_equals_all_pairs(spark, seed):
    rows, findings = _random_findings(spark, seed)
    points, count, kinds, pairs = {}, {}, {r[0]: {r[4]} for r in rows}, {}
    for a, b in itertools.combinations(rows, 2):
        related = _relation(a, b)
        if related:
            x, y, h, o = related
            for row, value, other in ((h, x, o), (o, y, h)):
                points[row[0]] = points.get(row[0], 0) + value
                count[row[0]] = count.get(row[0], 0) + 1
                kinds[row[0]].add(other[4])
            pairs[tuple(sorted((a[0], b[0])))] = (x, y)
    done = {r.finding_id: r for r in relations.correlate(findings).collect()}
    for r in rows:
        got = done[r[0]]
        assert (got.related_count, got.boost, got.score) == (count.get(r[0], 0), min(points.get(r[0], 0), 30), min(100, r[2] + min(points.get(r[0], 0), 30)))
        assert got.evidence_chain_basis.split("sources=")[1].split(";")[0] == "+".join(sorted(kinds[r[0]]))
    listed = {tuple(sorted((r.src, r.dst))): (r.boost_src, r.boost_dst) for r in relations.relation_pairs(findings, hot=3).collect()}
    assert listed == pairs
    parts = {r.member: r.component for r in connected_components(relations.component_edges(relations.prepared(findings))).collect()}
    whole = _partition(pairs, [r[0] for r in rows])
    sizes = {c: sum(1 for v in whole.values() if v == c) for c in set(whole.values())}
    assert parts == {n: c for n, c in whole.items() if sizes[c] > 1}
    chains = rollups.attack_chains(relations.correlate(findings), connected_components(relations.component_edges(relations.prepared(findings))))
    assert sorted(r.findings for r in chains.collect()) == sorted(s for s in sizes.values() if s > 1)


def test_placeholders_stay_out_of_source_statistics(spark):
    rows, findings = _random_findings(spark, 5)
    stats = {r.remote_ip: r.findings for r in rollups.source_stats(findings).collect()}
    assert set(stats) == {"1.1.1.1", "2.2.2.2", "::ffff:1.1.1.1"}
    assert rollups.placeholder_sources(findings).head()[0] == sum(1 for r in rows if r[5] in ("-", "0.0.0.0"))


def test_first_and_last_seen_use_instants(spark):
    rows = [("2026-05-15T10:00:00+08:00", 1), ("2026-05-15T03:00:00Z", 2), ("bad", 3), (None, 4)]
    f = conform(spark.createDataFrame(rows, "timestamp string, score int"), FINDING).withColumn("remote_ip", F.lit("1.1.1.1")).withColumn("category", F.lit("c"))
    r = rollups.source_stats(f).head()
    assert (r.first_seen, r.last_seen, r.findings) == ("2026-05-15T10:00:00+08:00", "2026-05-15T03:00:00Z", 4)


def test_gaps_and_baseline(spark):
    errors = spark.createDataFrame([("t", "windows_evtx", "/e", "parse", "permission denied", None), ("t", "ioc", "/i", "load", "x", None), ("t", "process", "/p", "read", "denied", None),
                                    ("t", "yara", "y", "initialize", "feature not compiled", None), ("t", "runtime", "/r", "discover", "x", None)],
                                   "timestamp string, source string, path string, operation string, message string, detail string")
    found = gaps.evidence_gaps(errors, "analyze")
    assert sorted(r.source for r in found.collect()) == ["runtime", "windows_evtx"]
    status = {r.scope: r.status for r in gaps.coverage(found).collect()}
    assert status == {"core_collection": "collected", "runtime": "not_collected", "host_events": "partial", "container": "collected"}
    assert {r.rule_id for r in gaps.gap_findings(found).collect()} == {"GAP-RUNTIME-UNAVAILABLE-001", "GAP-WINDOWS-EVTX-UNAVAILABLE-001"}
    expected = spark.createDataFrame([("t", "windows_evtx", "/e", "discover", "EVTX path does not exist", ""), ("t", "journald", "/j", "discover", "path does not exist", "")],
                                     "timestamp string, source string, path string, operation string, message string, detail string")
    assert gaps.evidence_gaps(errors, "analyze", expected).count() == 3
    now = conform(spark.createDataFrame([("F-1", "R", "file", "/a.php", "h1", 60, "webshell_static"), ("F-2", "R", "access_log", "a.log", "h2", 5, "sqli"), ("F-3", "R2", "access_log", "a.log", "h3", 50, "sqli")],
                                        "finding_id string, rule_id string, source_type string, source_file string, raw_hash string, score int, category string"), FINDING).withColumn("evidence_summary", F.lit("e"))
    earlier = now.where("finding_id <> 'F-3'")
    got = {r.finding_id: (r.score, r.evidence_chain_basis) for r in baseline.downrank_repeated(now, earlier, baseline.known_files(earlier)).collect()}
    assert got == {"F-1": (40, "baseline repeated finding; baseline repeated file"), "F-2": (0, "baseline repeated finding"), "F-3": (50, None)}


def test_windows_of_time(spark):
    window = resolve_window(hours=1, until="2026-05-15T09:00:00Z")
    rows = spark.createDataFrame([("2026-05-15T07:59:59Z",), ("2026-05-15T08:00:00Z",), ("2026-05-15T09:00:00Z",), ("2026-05-15T09:00:01Z",), (None,), ("junk",)], "t string")
    assert sorted(r.t or "" for r in time_filter(rows, "t", window).collect()) == ["", "2026-05-15T08:00:00Z", "2026-05-15T09:00:00Z", "junk"]
    with pytest.raises(ValueError):
        resolve_window(since="2026-05-16T00:00:00Z", until="2026-05-15T00:00:00Z")


def test_allowlist_paths_and_networks(spark):
    allow = Allowlist.from_toml('[paths]\nprefix = ["/health"]\n[source_ips]\ninternal = ["10.0.0.0/8", "nonsense"]\nexact = ["::ffff:1.2.3.4"]\n[[suppress]]\nrule_id = "R"\npath_prefix = "/admin/"\nsource_ip = "9.9.9.9"\n')
    assert len(allow.warnings()) == 1
    rows = spark.createDataFrame([("/x/../health/a", None), ("/y", "10.1.1.1"), ("/y", "1.2.3.4"), ("/admin/x", "9.9.9.9"), ("/admin/x", "9.9.9.8"), (None, None)], "p string, ip string")
    got = [r.s for r in rows.select(allow.suppresses("R", F.col("p"), F.col("ip"), None).alias("s")).collect()]
    assert got == [True, True, True, True, False, False]
