from __future__ import annotations

import gzip
import struct
from datetime import datetime

from pyspark.sql import functions as F

from tracelight.sources import app, binary, containers, database, host_config, host_events, inventory, signatures, waf, web, webconfig
from tracelight.sources.lines import read_log_lines, select_log_lines


def _rows(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_line_numbers_over_many_splits(spark, tmp_path):
    body = "".join(f"line {i}\n" if i % 10 else "\n" for i in range(1, 4001))
    (tmp_path / "big.log").write_text("﻿" + body)
    with gzip.open(tmp_path / "old.log.gz", "wt") as out:
        out.write("first\r\n\nthird\r\n")
    (tmp_path / "bad.log").write_bytes(b"ok\n\xff\xfe broken\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = read_log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by_file = {}
    for r in rows:
        by_file.setdefault(r.source_file.rsplit("/", 1)[1], {})[r.line_number] = r
    assert {n: r.text for n, r in by_file["big.log"].items()} == {i: f"line {i}" for i in range(1, 4001) if i % 10}
    assert {n: r.text for n, r in by_file["old.log.gz"].items()} == {1: "first", 3: "third"}
    assert by_file["bad.log"][2].had_invalid_utf8 and not by_file["bad.log"][1].had_invalid_utf8


def test_log_selection_by_name(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "access.log").write_text("a\n")
    (tmp_path / "notes.md").write_text("b\n")
    assert _rows(select_log_lines(spark, str(tmp_path), "http"), "text") == [("a",)]


def test_name_test_prunes_files(spark, tmp_path):
    (tmp_path / "access.log").write_text("a\nb\n")
    (tmp_path / "other.md").write_text("c\n")
    df = select_log_lines(spark, str(tmp_path), "http")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    scan = plan[plan.rindex("Filter"):]
    assert "RLIKE" in scan and "monotonically_increasing_id" not in scan
    assert sorted(_rows(df, "line_number", "text")) == [(1, "a"), (2, "b")]


def test_long_lines_stay_whole(lines):
    text = "2025-02-03 21:15:09 ERROR a.B " + "pad " * (1 << 18) + "tail"
    row = lines([text]).head()
    assert row.text == text and row.is_long
    event = app.parse_app(lines([text[:9000], *["at line"] * 2500])).events.collect()
    assert sorted(r.line_number for r in event) == [1, 1002, 2002] and sum(r.message_summary.count("at line") for r in event) == 2500


def test_feeds_of_several_files(spark, tmp_path):
    for name, entries in (("a", ["one.example", "two.example"]), ("b", ["three.example", "four.example"])):
        (tmp_path / f"{name}.txt").write_text("\n".join(entries) + "\n")
    kept, _ = inventory.read_ioc(spark, str(tmp_path))
    assert sorted(_rows(kept, "seq", "value")) == [(1, "one.example"), (2, "two.example"), (3, "three.example"), (4, "four.example")]
    folder = tmp_path / "nets.csv"
    folder.mkdir()
    for name, net in (("2", "10.0.0.0/8"), ("1", "11.0.0.0/8")):
        (folder / f"{name}.csv").write_text(f"cidr,country_iso\n{net},AA\n")
    nets, _ = inventory.read_geoip(spark, str(folder))
    assert [r.network for r in sorted(nets.collect(), key=lambda r: r.file_order)] == ["11.0.0.0/8", "10.0.0.0/8"]


def test_access_log_cases(lines):
    parsed = web.parse_access(lines([
        '192.0.2.8 - - [03/Feb/2025:21:15:09 +0000] "GET /shop/list.php?page=4 HTTP/1.1" 200 871 "-" "probe/2.1"',
        '192.0.2.8 - - [03/Feb/2025:21:15:09 +0000] "GET /pics/red door 7.gif?w=90 HTTP/1.1" 200 44',
        '192.0.2.8 - - [03/Feb/2025:21:15:09 +0000] "GET /q\\"r?s=5 HTTP/1.1" 500 6', "garbage", '1.1.1.1 - - [x] "GET" 200 1', "# comment"]))
    assert _rows(parsed.events, "uri_path", "uri_query", "status", "bytes_sent", "referer", "user_agent") == [
        ("/shop/list.php", "page=4", 200, 871, None, "probe/2.1"), ("/pics/red door 7.gif", "w=90", 200, 44, None, None), ('/q\\"r', "s=5", 500, 6, None, None)]
    assert sorted(_rows(parsed.rejects, "line_number", "message")) == [(4, "missing timestamp"), (5, "request does not contain method and URI")]


def test_json_access_and_iis(lines):
    js = web.parse_json_access(lines(['{"timestamp":"2026-05-15T08:00:00Z","remote_ip":"198.51.100.10","method":"POST","uri":"/api/login?u=a","status":403}',
                                      '{"request":"GET /x?y=1 HTTP/1.1","status":"200"}', "[1]", '{"a":1}']))
    assert _rows(js.events, "method", "uri_path", "uri_query", "status") == [("POST", "/api/login", "u=a", 403), ("GET", "/x", "y=1", 200)]
    assert js.rejects.count() == 2
    iis = web.parse_iis(lines(["1 2", "#Fields: date time cs-method cs-uri-stem sc-status time-taken", "2026-05-15 08:00:00 GET /a 200 1500", "2026-05-15 08:00:00 GET /a 200"]))
    assert _rows(iis.events, "timestamp", "method", "uri_path", "status", "request_time") == [("2026-05-15T08:00:00Z", "GET", "/a", 200, 1.5)]
    assert sorted(_rows(iis.rejects, "line_number")) == [(1,), (4,)]


def test_database_waf_app(lines):
    pg = database.parse_db(lines(["2025-02-03 21:15:09 UTC keeper@ledger 127.0.0.1 LOG:  statement: select 41"], "postgresql.log")).events
    row = pg.head()
    assert (row.db_user, row.db_name, row.statement_type) == ("keeper", "ledger", "query")
    assert row.client_ip == "127.0.0.1" and "select 41" in row.statement_summary and row.severity == "log"
    denied = database.parse_db(lines(["2026-05-15T08:00:00Z 12 Connect Access denied for user 'bob'@'10.0.0.5'", "数据库错误日志中文内容测试文本"], "mysql.log"))
    assert _rows(denied.events, "db_user", "client_ip", "statement_type", "session_id") == [("bob", "10.0.0.5", "auth_failure", "12")]
    assert _rows(denied.rejects, "message") == [("missing database timestamp",)]
    text = "[2026-05-15 08:00:02] production.ERROR: SQLSTATE[42000] path=/login trace_id=def PDOException token=secret laravel"
    event = app.parse_app(lines([text])).events.head()
    assert (event.level, event.http_path, event.trace_id, event.exception_type) == ("error", "/login", "def", "PDOException")
    mod = waf.parse_waf(lines(['[2026-05-15 08:00:00] ModSecurity: Warning. [id "942100"] [msg "SQL Injection"] [uri "/a"] [status "403"]', "nothing here"]))
    assert _rows(mod.events, "action", "rule_id", "status", "timestamp") == [("log", "942100", 403, "2026-05-15T08:00:00Z")]
    assert mod.rejects.count() == 1


def test_level_token_stands_alone(lines):
    got = _rows(lines(["user_INFO_x", "level=INFO", "[ERROR] boom", "a warn b"]).select(app.level(F.col("text")).alias("l")), "l")
    assert got == [(None,), (None,), ("error",), ("warn",)]


def test_stack_trace_joins_its_event(lines):
    parsed = app.parse_app(lines(["2026-05-15 08:00:00 ERROR a.B boom", "  at x.Y", "  at x.Z", "Caused by: q"]))
    assert _rows(parsed.events, "line_number", "message_summary") == [(1, "2026-05-15 08:00:00 ERROR a.B boom\nat x.Y\nat x.Z\nCaused by: q")]
    assert parsed.rejects.count() == 0
    orphan = app.parse_app(lines(["  at x.Y", "java.lang.FooException", "  at z"]))
    assert _rows(orphan.events, "line_number", "message_summary") == [(2, "java.lang.FooException\nat z")] and orphan.rejects.count() == 1


def test_audit_and_journal(lines):
    now = datetime(2026, 5, 20)
    ev = host_events.parse_audit(lines([
        "Feb 03 21:15:09 edge7 sshd[77]: Failed password for daemon from 198.51.100.66 port 40022 ssh2",
        'type=EXECVE msg=audit(1715000000.1:2): argc=3 a0=cat a1=2f6574632f706173737764 a2=2026', "kernel: nothing"]), now).events
    got = {r.line_number: r for r in ev.collect()}
    assert (got[1].action, got[1].src_ip, got[1].user, got[1].pid) == ("login_failed", "198.51.100.66", "daemon", "77")
    assert got[2].command_line_summary == "cat /etc/passwd 2026" and set(got) == {1, 2}
    j = host_events.parse_journald(lines(["May 15 08:00:01 edge7 systemd[1]: Started relay.service."]), now).events.head()
    assert (j.action, j.unit, j.timestamp) == ("service_started", "relay.service", "2026-05-15T08:00:01Z")


def test_windows_xml_file(spark, tmp_path):
    path = tmp_path / "e.xml"
    path.write_text('<Events>\n<Event xmlns="x"><System><EventID>4625</EventID></System>\n<EventData><Data Name="IpAddress">1.2.3.4</Data></EventData></Event>\n'
                    "<Event><System></System></Event>\n</Events>\n")
    parsed = host_events.parse_windows_xml(host_events.read_terminated(spark, str(path), "</Event>"))
    assert _rows(parsed.events, "event_code", "action", "source_ip", "line_number") == [("4625", "logon_failure", "1.2.3.4", 2)]
    assert _rows(parsed.rejects, "message", "line_number") == [("missing EventID", 4)]


def test_shell_history(lines):
    rows = host_config.parse_shell_history(lines(["#1700000000", "whoami", "#1700000100", "id -u \\", "uname -a", "ls"], "/root/.bash_history"))
    assert [(r.command, r.timestamp) for r in rows.orderBy("line_no").collect()] == [
        ("whoami", "2023-11-14T22:13:20Z"), ("id -u \\", "2023-11-14T22:15:00Z"), ("uname -a", "2023-11-14T22:15:00Z"), ("ls", "")]


def test_kubernetes_documents(spark):
    pod = ("kind: Pod\nmetadata: {name: p, namespace: n}\nspec:\n  hostPID: true\n  nodeName: n1\n  containers:\n  - name: a\n    image: i\n    securityContext: {privileged: true}\n"
           "    volumeMounts: [{name: v, mountPath: /data}]\n  volumes:\n  - {name: v, hostPath: {path: /etc}}\n  - {name: w, hostPath: {path: /srv}}\n---\nkind: Pod\nmetadata: {name: q}\n---\na: [\n")
    found = containers.parse_k8s(spark.createDataFrame([("m.yaml", pod)], "source_file string, text string"))
    assert _rows(found.containers, "container_id", "is_privileged", "host_pid", "risk_flags") == [("k8s-n-p-a", True, True, "host_pid;privileged;node:n1;pod_privileged_containers=a")]
    assert sorted(_rows(found.mounts, "source", "destination", "is_sensitive")) == [("/etc", "/data", True), ("/srv", "/srv", False)]
    assert sorted(m for (m,) in _rows(found.rejects, "message"))[0] == "Pod document has no spec mapping" and found.rejects.count() == 2


def test_containerd_and_images(spark):
    doc = '{"containers":[{"id":"c1","image":"i","labels":{"io.kubernetes.pod.name":"p"},"hostNetwork":true,"mounts":[{"source":"/proc","destination":"/p","options":"ro"}]}]}'
    found = containers.parse_containerd(spark.createDataFrame([("f.json", doc), ("bad", "{")], "source_file string, text string"))
    assert _rows(found.containers, "container_id", "pod_name", "risk_flags") == [("c1", "p", "host_network")]
    assert _rows(found.mounts, "risk_flags") == [("sensitive_mount",)] and found.networks.count() == 1 and found.rejects.count() == 1
    images = containers.parse_docker_images(spark.createDataFrame([("i", '[{"Id":"x","RepoTags":["a:1"],"Size":5},{}]')], "source_file string, text string"))
    assert _rows(images, "image", "image_id", "size") == [("a:1", "x", 5)]


def test_utmp_lastlog_and_strings(spark):
    def record(kind, pid, line, user, host, sec, addr):
        return struct.pack("<hxxi32s4s32s256s4xi", kind, pid, line, b"", user, host, 0)[:340].ljust(340, b"\0") + struct.pack("<Ii", sec, 0) + addr.ljust(16, b"\0") + b"\0" * 20

    blob = record(7, 42, b"pts/1", b"root", b"h", 1700000000, bytes([4, 3, 2, 1])) + record(99, 1, b"", b"", b"", 1, b"") + b"tail"
    files = spark.createDataFrame([("/wtmp", bytearray(blob))], "path string, content binary")
    assert _rows(binary.parse_utmp(files, "wtmp"), "record_type", "user", "pid", "address", "timestamp") == [("user_process", "root", "42", "1.2.3.4", "2023-11-14T22:13:20Z")]
    last = struct.pack("<q32s256s", 0, b"", b"") + struct.pack("<q32s256s", 1700000000, b"tty1", b"h")
    rows = binary.parse_lastlog(spark.createDataFrame([("/l", bytearray(last))], "path string, content binary"))
    assert _rows(rows, "user", "terminal") == [("uid:1", "tty1")]
    wide = "powershell hidden".encode("utf-16le")
    blob = b"normal\x00http://evil.example/payload\x00" + wide + b"\x00\x01" + b"q" * 5000 + b"\x00/tmp/.ice/unix"
    files = spark.createDataFrame([("/m", bytearray(blob))], "path string, content binary")
    whole = sorted(_rows(binary.extract_strings(files), "offset", "encoding", "text", "tag"))
    for chunk in (64, 37, 1024):
        assert sorted(_rows(binary.extract_strings(files, chunk=chunk), "offset", "encoding", "text", "tag")) == whole
    assert sorted(r[1:] for r in whole) == [
        ("ascii", "/tmp/.ice/unix", "temp_path"), ("ascii", "http://evil.example/payload", "url"), ("ascii", "q" * 5000, "base64_run"), ("utf16le", "dpowershell hidden", "executor")]


def test_literal_signatures(spark):
    rules = signatures.parse_literal_rules('rule a : t1 {\n strings:\n $x = "EvAl(" nocase\n}\nrule none {\n condition: true }', "ns")
    assert [(r.name, r.tags, r.literals) for r in rules] == [("a", ("t1",), (("EvAl(", True),))]
    files = spark.createDataFrame([("f", bytearray(b"xx eval(eval("))], "path string, content binary")
    assert _rows(signatures.signature_matches(files, rules), "match_count", "matched_offsets_summary") == [(2, "0x3;0x8")]
    assert sorted(_rows(signatures.signature_offsets(files, rules), "rule_name", "offset")) == [("a", 3), ("a", 8)]
    two = signatures.parse_literal_rules('private rule p { strings: $a = "one }" wide nocase condition: $a == "two" }\nrule q : x y\n{\n  meta:\n    author = "me"\n  strings:\n    $s1 = "a\\"b"\n    $s2 = { 4d 5a }\n  condition:\n    any of them\n}\n', "n")
    assert [(r.name, r.tags, r.literals) for r in two] == [("p", (), (("one }", True),)), ("q", ("x", "y"), (("a\"b", False),))]


def test_feeds(spark, tmp_path):
    (tmp_path / "i.csv").write_text("type,value,confidence\nip,1.2.3.4,high\nbogus,x,low\ncidr,10.0.0.0/99,low\nmd5,d41d8cd98f00b204e9800998ecf8427e,low\n")
    kept, counts = inventory.read_ioc(spark, str(tmp_path / "i.csv"))
    assert sorted(_rows(kept, "indicator_type", "value")) == [("hash", "d41d8cd98f00b204e9800998ecf8427e"), ("ip", "1.2.3.4")]
    assert tuple(counts.head()) == (2, 2, 1)
    (tmp_path / "i.txt").write_text("# remark\nevil.example\nip, 9.9.9.9\nshell.php\n")
    kept, _ = inventory.read_ioc(spark, str(tmp_path / "i.txt"))
    assert sorted(_rows(kept, "indicator_type", "value")) == [("domain", "evil.example"), ("ip", "9.9.9.9"), ("url_path", "shell.php")]
    (tmp_path / "g.csv").write_text("cidr,country_iso\n1.0.0.0/8,AA\nbad,BB\n")
    nets, skipped = inventory.read_geoip(spark, str(tmp_path / "g.csv"))
    assert _rows(nets, "network", "country") == [("1.0.0.0/8", "AA")] and skipped.head()[0] == 1


def test_spring_configuration(lines, spark):
    flags = spark.createDataFrame([("management.endpoints.web.exposure.include=*",), ("a=b",)], "t string").select(webconfig.spring_config_flags(F.col("t")).alias("f"))
    assert _rows(flags, "f") == [("management_endpoint_exposure",), ("",)]
    code = spark.createDataFrame([("A.java", '@GetMapping("/env/x") class A')], "source_file string, text string")
    assert _rows(webconfig.spring_mappings_from_code(code), "http_method", "route_or_pattern", "risk_flags") == [("GET", "/env/x", "management_endpoint_exposure")]
