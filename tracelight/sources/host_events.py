"""Host event exports: auditd, auth/syslog, journald, Windows event XML/JSON, container stdout."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.functions.frames import settled
from tracelight.functions.text import extract, sha256_hex
from tracelight.functions.times import audit_iso, instant, micros_iso, syslog_iso
from tracelight.functions.values import let
from tracelight.schema import CONTAINER_LOG, LINUX_EVENT, WINDOWS_EVENT
from tracelight.sources.jsonfields import json_map, lower_keys
from tracelight.sources.lines import Parsed, finish, parse_cases
from tracelight.sources.ranges import read_terminated_bytes

_AUDIT_PAIR = r"""([A-Za-z0-9_]+)=("[^"]*"|'[^']*'|\S+)"""


def single_spaced(value: Column) -> Column:
    """The whole text with every run of white space as one space; rules read it, displays may cut it."""
    def spaced(v: Column) -> Column:
        uneven = v.rlike(r"\s(?:(?<! )|(?= ))")  # a long text that is single-spaced already is not rebuilt
        return F.trim(F.when(uneven, F.regexp_replace(v, r"\s+", " ")).otherwise(v))

    return let(value, spaced)


def _user_from_uid(uid: Column) -> Column:
    return F.when(uid == "33", "www-data").when(uid == "48", "apache").otherwise(F.concat(F.lit("uid="), uid))


def _audit_fields(line: Column) -> Column:
    keys = F.regexp_extract_all(line, F.lit(_AUDIT_PAIR), F.lit(1))
    raw = F.regexp_extract_all(line, F.lit(_AUDIT_PAIR), F.lit(2))
    values = F.transform(raw, lambda v: F.btrim(F.btrim(F.trim(v), F.lit('"')), F.lit("'")))

    def last_wins(ks: Column) -> Column:
        names = F.array_distinct(ks)
        back_keys, back_values = F.reverse(ks), F.reverse(values)
        return F.map_from_arrays(
            names, F.transform(names, lambda k: F.get(back_values, (F.array_position(back_keys, k) - 1).cast("int")))
        )

    return let(keys, last_wins)


def decode_argument(value: Column) -> Column:
    """A hex-encoded command argument as text when the bytes look like text, else unchanged."""

    def judge(v: Column) -> Column:
        count = (F.length(v) / 2).cast("int")
        pairs = F.regexp_extract_all(F.lower(v), F.lit(r"([0-9a-f]{2})"), F.lit(1))
        printable = F.size(F.filter(pairs, lambda p: ((p >= "20") & (p <= "7e")) | (p >= "80")))
        plausible = (printable / count >= 0.9) & ((F.array_contains(pairs, "20") & (count >= 4)) | (count >= 6))
        hexed = v.rlike(r"^[0-9A-Fa-f]+$") & (F.length(v) >= 4) & (F.length(v) % 2 == 0)
        return F.when(hexed & plausible, F.make_valid_utf8(F.unhex(v).cast("string"))).otherwise(v)

    return let(value, judge)


def _exec_command(fields: Column) -> Column:
    numbered = F.filter(F.map_entries(fields), lambda e: e["key"].rlike(r"^a\d+$"))
    ordered = F.array_sort(F.transform(
        numbered, lambda e: F.struct(F.substring(e["key"], 2, 9).cast("int").alias("n"), decode_argument(e["value"]).alias("v"))
    ))
    return single_spaced(F.array_join(F.transform(ordered, lambda s: s["v"]), " "))


def _base_name(value: Column) -> Column:
    return F.element_at(F.split(value, "/"), -1)


def _audit_columns(df: DataFrame) -> DataFrame:
    staged = df.withColumn("_f", _audit_fields(F.col("_text")))
    f = lambda *keys: F.coalesce(*[F.try_element_at("_f", F.lit(k)) for k in keys])
    kind = f("type")
    known = kind.isin("EXECVE", "SYSCALL", "USER_LOGIN", "USER_AUTH", "CRED_ACQ")
    action = F.when(kind == "EXECVE", "execve").when(kind == "SYSCALL", "syscall").when(known, "auth").otherwise(F.lower(kind))
    command = F.when(F.upper(kind) == "EXECVE", F.when(known, _exec_command(F.col("_f"))).otherwise(single_spaced(f("cmd")))).when(
        known, single_spaced(f("cmd", "command"))
    ).otherwise(single_spaced(f("cmd")))
    success = f("success")
    return staged.select(
        *df.columns, audit_iso(extract(F.col("_text"), r"msg=audit\((\d+)(?:\.\d+)?:\d+\)")).alias("timestamp"),
        F.lit("auditd").alias("source"), F.coalesce(f("acct", "user"), _user_from_uid(f("uid"))).alias("user"),
        f("uid").alias("uid"), f("pid").alias("pid"), f("ppid").alias("ppid"), _base_name(f("comm", "exe")).alias("process_name"),
        command.alias("command_line_summary"), f("cwd").alias("cwd"), f("addr", "src").alias("src_ip"), f("tty").alias("tty"),
        f("ses").alias("session"), action.alias("action"), f("exe", "path").alias("object_path"),
        F.coalesce(F.when(success == "yes", "success").when(success.isNotNull(), "failure"), f("res")).alias("result"),
        F.when(known, 0.85).otherwise(0.75).alias("parser_confidence"),
        F.when(kind.isNull(), "missing auditd type").alias("_error"),
    )


def _syslog_stamp(line: Column, now: datetime, tz_offset: str) -> Column:
    first = F.regexp_extract(line, r"^(\S+)", 1)
    return F.when(first.contains("T"), first).otherwise(syslog_iso(line, now, tz_offset))


def _auth_columns(df: DataFrame, now: datetime, tz_offset: str) -> DataFrame:
    line, lowered = F.col("_text"), F.lower("_text")
    failed = lowered.contains("failed password")
    accepted = lowered.rlike("accepted (password|publickey)")
    sudo = lowered.contains("sudo:") & lowered.contains("command=")
    cron = lowered.contains("cron[") & (lowered.contains(" cmd ") | lowered.contains("cmd ("))
    broken = lowered.contains("failed to start ")
    service = lowered.contains("systemd") & (lowered.contains("started ") | broken)
    action = (
        F.when(failed, "login_failed").when(accepted, "login_success").when(sudo, "sudo").when(cron, "cron")
        .when(service, F.when(broken, "service_failed").otherwise("service_started"))
    )
    login = failed | accepted
    unit = F.regexp_extract(
        F.rtrim(F.trim(F.when(lowered.contains("started "), F.regexp_replace(line, r"(?is)^.*?started ", "")).otherwise(
            F.regexp_replace(line, r"(?is)^.*?failed to start ", ""))), F.lit(".")), r"^(\S+)", 1)
    command = F.when(sudo, single_spaced(extract(line, r"(?s)COMMAND=\s*(\S.*)$"))).when(cron, F.trim(extract(line, r"(?s)(CMD.*)$")))
    plain_service = ~login & ~sudo & ~cron & service
    staged = df.withColumn("action", action).withColumn("command_line_summary", F.when(~login, command)).withColumn(
        "unit", F.when(plain_service & (unit != ""), unit)
    )
    return staged.select(
        *df.columns, _syslog_stamp(line, now, tz_offset).alias("timestamp"), F.lit("auth_log").alias("source"), "unit",
        F.when(login, extract(line, r"\bfor (?:invalid user )?(\S+)")).when(sudo, F.trim(extract(line, r"sudo:\s+([^:]+)\s+:"))).alias("user"),
        extract(line, r"\[(\d+)\]:").alias("pid"), extract(line, r"\s([A-Za-z0-9_.-]+)(?:\[\d+\])?:").alias("process_name"),
        "command_line_summary", F.when(login, extract(line, r"\bfrom ([0-9a-fA-F:.]+)")).alias("src_ip"), "action",
        F.coalesce("command_line_summary", "unit").alias("object_path"),
        F.when(failed, "failure").when(accepted | sudo, "success").alias("result"), F.lit(0.75).alias("parser_confidence"),
        F.lit(None).cast("string").alias("_error"), F.col("action").isNull().alias("_skip"),
    )


def _trimmed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_text", F.regexp_replace("text", r"^\s+|\s+$", ""))


def _done(df: DataFrame, schema, prefix: str, parser: str) -> Parsed:
    kept = df if "_line_hash" in df.columns else df.withColumnRenamed("raw_hash", "_line_hash")
    hashed = kept.withColumn("raw_hash", sha256_hex(F.col("_text")))
    named = hashed.withColumn("event_id", F.concat(F.lit(prefix), F.substring("raw_hash", 1, 16)))
    return finish(named, schema, parser=F.lit(parser))


def parse_audit(lines: DataFrame, now: datetime, tz_offset: str = "+00:00") -> Parsed:
    """auditd records and auth/syslog lines; other lines are ignored."""
    line = F.col("_text")
    cases = [
        (line.contains("type=") & line.contains("msg=audit("), _audit_columns), (F.lit(True), lambda df: _auth_columns(df, now, tz_offset)),
    ]
    return _done(parse_cases(_trimmed(lines), "_text", cases, LINUX_EVENT), LINUX_EVENT, "LNX-", "linux_audit")


def _journal_action(message: Column) -> Column:
    lowered = F.lower(message)
    return (
        F.when(lowered.contains("failed to start "), "service_failed").when(lowered.contains("started "), "service_started")
        .when(lowered.rlike("accepted (password|publickey)"), "login_success").when(lowered.contains("failed password"), "login_failed")
        .when(lowered.contains("sudo"), "sudo").when(lowered.contains("cron"), "cron")
    )


def _unit_in(message: Column) -> Column:
    return extract(message, r"(?i)\b([A-Za-z0-9_.@-]+\.(?:service|timer|socket))\b")


def _journal_json(df: DataFrame) -> DataFrame:
    js = df.withColumn("_m", json_map(F.col("_text")))
    get = lambda *keys: F.coalesce(*[
        let(F.trim(F.try_element_at("_m", F.lit(k))), lambda v: F.when((v != "") & ~v.rlike(r"^[\[{]"), v)) for k in keys
    ])
    js = js.withColumn("_msg", get("MESSAGE")).withColumn("_stamp", get("timestamp", "__REALTIME_TIMESTAMP"))
    return js.select(
        *df.columns,
        F.coalesce(F.when(F.col("_stamp").contains("T"), F.col("_stamp")), micros_iso(F.col("_stamp")),
                   micros_iso(get("_SOURCE_REALTIME_TIMESTAMP"))).alias("timestamp"),
        F.lit("journald").alias("source"), F.coalesce(get("_SYSTEMD_UNIT", "UNIT"), _unit_in(F.col("_msg"))).alias("unit"),
        _user_from_uid(get("_UID")).alias("user"), get("_UID").alias("uid"), get("_PID").alias("pid"),
        get("_COMM", "SYSLOG_IDENTIFIER").alias("process_name"), single_spaced(F.col("_msg")).alias("command_line_summary"),
        _journal_action(F.col("_msg")).alias("action"), F.col("_msg").alias("object_path"), F.lit(0.8).alias("parser_confidence"),
        F.when(F.col("_m").isNull(), "invalid journald JSON record").alias("_error"),
    )


def _journal_text(df: DataFrame, now: datetime, tz_offset: str) -> DataFrame:
    line = F.col("_text")
    staged = df.withColumn("_msg", F.when(line.contains(": "), F.regexp_replace(line, r"(?s)^.*?: ", "")).otherwise(line))
    return staged.select(
        *df.columns, _syslog_stamp(line, now, tz_offset).alias("timestamp"), F.lit("journald").alias("source"),
        _unit_in(F.col("_msg")).alias("unit"), extract(line, r"\[(\d+)\]:").alias("pid"),
        extract(line, r"\s([A-Za-z0-9_.@-]+)(?:\[\d+\])?:").alias("process_name"),
        single_spaced(F.col("_msg")).alias("command_line_summary"), extract(line, r"\bfrom ([0-9a-fA-F:.]+)").alias("src_ip"),
        _journal_action(F.col("_msg")).alias("action"), F.col("_msg").alias("object_path"), F.lit(0.7).alias("parser_confidence"),
        F.lit(None).cast("string").alias("_error"),
    )


def parse_journald(lines: DataFrame, now: datetime, tz_offset: str = "+00:00") -> Parsed:
    """journald JSON exports and text output; text lines of other programs are ignored."""
    cases = [
        (F.col("_text").startswith("{"), _journal_json),
        (F.lower("_text").rlike("systemd|sshd|cron|sudo"), lambda df: _journal_text(df, now, tz_offset)),
    ]
    return _done(parse_cases(_trimmed(lines), "_text", cases, LINUX_EVENT), LINUX_EVENT, "LNX-", "journald")


# What a Windows event code stands for.
WINDOWS_ACTIONS = {
    "4624": "logon_success", "4625": "logon_failure", "4648": "explicit_credentials", "4672": "special_privileges",
    "4688": "process_create", "4103": "powershell", "4104": "powershell", "7045": "service_install",
    "4698": "scheduled_task_create", "106": "scheduled_task_create", "4697": "service_install",
    "4699": "scheduled_task_delete", "4700": "scheduled_task_enable", "4701": "scheduled_task_disable",
    "4702": "scheduled_task_update", "140": "scheduled_task_update", "4720": "user_create", "4728": "group_add",
    "4732": "group_add", "4756": "group_add", "4768": "kerberos_tgt_request", "4769": "kerberos_service_ticket",
    "4771": "kerberos_preauth_failure", "5140": "smb_share_access", "5145": "smb_share_access",
    "4657": "registry_value_change", "4719": "audit_policy_change", "4946": "firewall_policy_change",
    "4947": "firewall_policy_change", "4948": "firewall_policy_change", "4950": "firewall_policy_change",
    "4951": "firewall_policy_change", "1102": "log_clear", "104": "log_clear", "6005": "event_log_service_start",
    "6006": "event_log_service_stop", "1000": "application_crash", "1001": "windows_error_report",
    "11707": "msi_install_complete", "1116": "defender_detection", "1117": "defender_detection",
    "1149": "rdp_activity", "21": "rdp_activity", "24": "rdp_activity", "25": "rdp_activity",
    "5857": "wmi_activity", "5858": "wmi_activity", "7036": "service_state_change",
    "6008": "unexpected_shutdown", "41": "unexpected_shutdown",
}


def windows_action(code: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in WINDOWS_ACTIONS.items() for v in pair])
    return F.try_element_at(table, code)


def windows_result(code: Column) -> Column:
    return F.when(code == "4624", "success").when(code == "4625", "failure")


def decode_xml(value: Column) -> Column:
    def decode(v: Column) -> Column:
        decoded = v
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")):
            decoded = F.replace(decoded, F.lit(entity), F.lit(char))
        return F.when(v.contains("&"), decoded).otherwise(v)

    return let(F.trim(value), decode)


def read_terminated(spark: SparkSession, path: str, terminator: str, encoding: str = "UTF-8") -> DataFrame:
    """Records ended by ``terminator`` with the line number at which each starts; files are read by byte ranges.

    The encoding is one in which ASCII characters are single bytes.
    """
    found = read_terminated_bytes(spark, path, terminator.encode(encoding))
    text = F.make_valid_utf8(F.col("content").cast("string")) if encoding.upper() == "UTF-8" else F.decode("content", encoding)
    return found.select(F.col("path").alias("source_file"), text.alias("value"), "start_line")


def _windows_columns(df: DataFrame, carry: list[str]) -> DataFrame:
    """Event columns from ``provider, event_code, timestamp, channel, computer, severity`` and the lower-keyed ``_data`` map."""
    data = lambda *keys: F.coalesce(*[
        let(F.trim(F.try_element_at("_data", F.lit(k.lower()))), lambda v: F.when(v != "", v)) for k in keys
    ])
    source_ip = data("IpAddress", "SourceNetworkAddress", "ClientAddress", "SourceAddress")
    return df.select(
        *carry, "provider", "event_code", "timestamp", "channel", "computer", "severity",
        data("SubjectUserName", "User", "AccountName", "TargetUserName", "Security ID").alias("user"),
        data("NewProcessName", "ProcessName", "Image", "Application", "ProcessPath").alias("process_name"),
        data("NewProcessId", "ProcessId", "ExecutionProcessID").alias("process_id"),
        data("ParentProcessName", "ParentImage", "CreatorProcessName").alias("parent_process_name"),
        single_spaced(data("CommandLine", "ProcessCommandLine", "ScriptBlockText", "Message", "Image")).alias("command_line_summary"),
        F.when(~source_ip.isin("-", "::1"), source_ip).alias("source_ip"),
        data("TargetUserName", "AccountName", "TargetAccount").alias("target_user"),
        data("ServiceName", "param1", "Service").alias("service_name"), data("TaskName", "Task", "TaskContent").alias("task_name"),
        data("ImagePath", "ServiceFileName", "param2", "Path", "ObjectName", "TargetObject").alias("object_path"),
        windows_action(F.col("event_code")).alias("action"), windows_result(F.col("event_code")).alias("result"),
        F.lit(0.9).alias("parser_confidence"), "_error",
    )


def parse_windows_xml(records: DataFrame) -> Parsed:
    """``<Event>`` blocks: rows ``(source_file, value, start_line)`` cut at ``</Event>``."""
    found = settled(records, ["source_file", "start_line", "value", F.regexp_extract("value", r"(?is)^(.*?)<Event\b", 0).alias("_lead")])
    before = F.length("_lead") - len("<Event")  # characters before the block
    lead = F.substr("_lead", F.lit(1), before)
    blocks = settled(found.where(F.col("_lead") != ""), [
        F.col("source_file"), (F.col("start_line") + F.length(lead) - F.length(F.replace(lead, F.lit("\n"), F.lit("")))).alias("line_number"),
        F.concat(F.substr("value", before + 1), F.lit("</Event>")).alias("_text"),
    ])
    # one pass says which names occur; the others are not searched: long blocks lack most of them
    named = F.regexp_extract_all("_text", F.lit(r"(?i)<(EventID|Channel|Computer|Level|Provider|TimeCreated)\b"), F.lit(1))
    blocks = settled(blocks, [*blocks.columns, F.transform(named, F.lower).alias("_names")])
    block = F.col("_text")
    first = lambda element, pattern: F.when(F.array_contains("_names", element.lower()), F.regexp_extract(block, pattern, 1))
    tag = lambda name: let(
        decode_xml(first(name, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>")), lambda v: F.when(F.trim(v) != "", v)
    )
    attribute = lambda element, name: let(
        first(element, rf"(?is)<{element}\b[^>]*\b{name}\s*=\s*[\"']([^\"']+)[\"']"), lambda v: F.when(v != "", decode_xml(v))
    )
    # elements are cut out once; key and value are then places in the element
    head, close = r"(?is)<Data\b[^>]*\bName\s*=\s*[\"']([^\"']+)[\"'][^>]*>", "</Data>"

    def entry(element: Column, opening: Column) -> Column:
        inside = F.length(element) - F.length(opening) - len(close)
        return F.struct(F.lower(decode_xml(F.regexp_extract(opening, head, 1))).alias("key"),
                        decode_xml(F.substr(element, F.length(opening) + 1, inside)).alias("value"))

    def opened(element: Column) -> Column:  # a quoted name may run into the closing mark, then the shorter opening holds
        return let(F.regexp_extract(element, head, 0), lambda o: F.when(F.length(o) + len(close) <= F.length(element), o).otherwise(
            F.regexp_extract(element, rf"{head}(?=.*{close})", 0)))

    entries = F.filter(
        F.transform(F.regexp_extract_all(block, F.lit(rf"{head}[^<]*+.*?{close}"), F.lit(0)), lambda e: let(opened(e), lambda o: entry(e, o))),
        lambda e: (e["key"] != "") & (e["value"] != ""),
    )
    staged = blocks.select(
        "source_file", "line_number", "_text", attribute("Provider", "Name").alias("provider"), tag("EventID").alias("event_code"),
        attribute("TimeCreated", "SystemTime").alias("timestamp"), tag("Channel").alias("channel"),
        tag("Computer").alias("computer"), tag("Level").alias("severity"), _last_wins(entries).alias("_data"),
    ).withColumn("_error", F.when(F.col("event_code").isNull(), "missing EventID"))
    return _windows_done(_windows_columns(staged, ["source_file", "line_number", "_text"]))


def _last_wins(entries: Column) -> Column:
    def build(es: Column) -> Column:
        keys = F.transform(es, lambda e: e["key"])
        back = F.reverse(es)
        names = F.array_distinct(keys)
        back_keys = F.transform(back, lambda e: e["key"])
        return F.map_from_arrays(
            names, F.transform(names, lambda k: F.get(back, (F.array_position(back_keys, k) - 1).cast("int"))["value"])
        )

    return let(entries, build)


def _windows_done(df: DataFrame) -> Parsed:
    undamaged = df.withColumn("raw_hash", F.lit(None).cast("string")).withColumn("text", F.col("_text")).withColumn(
        "is_long", F.lit(False)
    ).withColumn("had_invalid_utf8", F.lit(False))
    return _done(undamaged, WINDOWS_EVENT, "WIN-", "windows_event")


def parse_windows_json(records: DataFrame) -> Parsed:
    """One JSON object per row in ``text``: flat exports and ``System``/``EventData.Data`` nesting."""
    staged = _trimmed(records).withColumn("_m", json_map(F.col("_text")))
    m = F.col("_m")
    scalar = lambda v: let(F.trim(v), lambda t: F.when((t != "") & ~t.rlike(r"^[\[{]"), t))
    top = lambda *keys: F.coalesce(*[scalar(F.try_element_at(m, F.lit(k))) for k in keys])
    staged = staged.withColumn("_sys", json_map(F.coalesce(F.try_element_at(m, F.lit("System")), F.lit(""))))
    staged = staged.withColumn(
        "_evd", json_map(F.coalesce(F.try_element_at(m, F.lit("EventData")), F.try_element_at(m, F.lit("event_data")), F.lit("")))
    )
    system = lambda key: scalar(F.try_element_at("_sys", F.lit(key)))
    inner = lambda outer, *keys: let(
        json_map(F.coalesce(F.try_element_at("_sys", F.lit(outer)), F.lit(""))),
        lambda o: F.coalesce(*[scalar(F.try_element_at(o, F.lit(k))) for k in keys]),
    )
    data_text = F.coalesce(F.try_element_at("_evd", F.lit("Data")), F.try_element_at("_evd", F.lit("data")))
    entry = lambda k, v: F.struct(F.lower(k).alias("key"), F.trim(v).alias("value"))
    entries_of = lambda mp: F.transform(F.coalesce(F.map_entries(mp), F.array()), lambda e: entry(e["key"], e["value"]))
    listed = F.transform(
        F.coalesce(F.from_json(F.when(data_text.startswith("["), data_text), "array<map<string,string>>"), F.array()),
        lambda o: entry(
            F.coalesce(*[F.try_element_at(o, F.lit(k)) for k in ("Name", "name", "@Name")]),
            F.coalesce(*[F.try_element_at(o, F.lit(k)) for k in ("#text", "text", "Value", "value", "$")]),
        ),
    )
    mapped = entries_of(json_map(F.coalesce(data_text, F.lit(""))))
    # earlier entries lose: nested values, then top-level ones, then EventData.Data
    merged = F.filter(
        F.concat(entries_of(F.col("_sys")), entries_of(F.col("_evd")), entries_of(m), mapped, listed),
        lambda e: e["key"].isNotNull() & (e["value"] != "") & ~e["value"].rlike(r"^[\[{]"),
    )
    code = F.coalesce(top("event_code", "event_id", "EventID", "Id", "id"), system("EventID"))
    shaped = staged.select(
        "source_file", "line_number", "_text",
        F.coalesce(top("provider", "Provider", "provider_name", "ProviderName"), inner("Provider", "Name", "name", "@Name")).alias("provider"),
        code.alias("event_code"),
        F.coalesce(top("timestamp", "time_created", "TimeCreated", "SystemTime", "EventTime"),
                   inner("TimeCreated", "SystemTime", "system_time", "@SystemTime")).alias("timestamp"),
        F.coalesce(top("channel", "Channel", "LogName"), system("Channel")).alias("channel"),
        F.coalesce(top("computer", "Computer", "ComputerName"), system("Computer")).alias("computer"),
        top("severity", "level", "Level").alias("severity"), _last_wins(merged).alias("_data"),
        F.when(m.isNull(), "invalid JSONL EVTX record").when(code.isNull(), "missing event id").alias("_error"),
    )
    return _windows_done(_windows_columns(shaped, ["source_file", "line_number", "_text"]))


def windows_json_array(files: DataFrame) -> DataFrame:
    """Rows of ``parse_windows_json`` from files that are one JSON array: ``(source_file, text)``."""
    return files.select(
        "source_file", F.posexplode(F.from_json("text", "array<string>")).alias("_pos", "text")
    ).select("source_file", (F.col("_pos") + 1).cast("long").alias("line_number"), "text")


def _container_json(df: DataFrame) -> DataFrame:
    js = df.withColumn("_m", json_map(F.col("_text")))
    js = js.withColumn("_k", json_map(F.coalesce(F.try_element_at("_m", F.lit("kubernetes")), F.lit(""))))
    scalar = lambda v: let(F.trim(v), lambda t: F.when((t != "") & ~t.startswith("{"), t))
    get = lambda *keys: F.coalesce(*[scalar(F.try_element_at("_m", F.lit(k))) for k in keys])
    kube = lambda key: F.coalesce(scalar(F.try_element_at("_m", F.lit(f"kubernetes.{key}"))), scalar(F.try_element_at("_k", F.lit(key))))
    return js.select(
        *df.columns, get("time", "timestamp", "@timestamp", "ts").alias("timestamp"),
        get("container_id", "containerID", "id").alias("container_id"), get("container_name", "container", "name").alias("container_name"),
        F.coalesce(get("pod_name", "pod"), kube("pod_name")).alias("pod_name"),
        F.coalesce(get("namespace"), kube("namespace_name")).alias("namespace"), get("stream", "source").alias("stream"),
        single_spaced(F.coalesce(get("log", "message", "msg", "MESSAGE", "content", "line"), F.col("_text"))).alias("message_summary"),
        F.lit(0.85).alias("parser_confidence"), F.when(F.col("_m").isNull(), "invalid container log JSON record").alias("_error"),
    )


def _container_text(df: DataFrame) -> DataFrame:
    first = F.regexp_extract("_text", r"^(\S+)", 1)
    return df.select(
        *df.columns, F.when(first.rlike("T|-"), first).alias("timestamp"), single_spaced(F.col("_text")).alias("message_summary"),
        F.lit(0.65).alias("parser_confidence"), F.lit(None).cast("string").alias("_error"),
    )


def parse_container_log(lines: DataFrame, runtime: str) -> Parsed:
    """Container stdout: JSON envelopes and plain text."""
    cases = [(F.col("_text").startswith("{"), _container_json), (F.lit(True), _container_text)]
    merged = parse_cases(_trimmed(lines), "_text", cases, CONTAINER_LOG).withColumn("runtime", F.lit(runtime))
    return _done(merged, CONTAINER_LOG, "CTR-LOG-", "container_log")


def in_collection_window(events: DataFrame, since: Column | None, until: Column | None, tz_offset: str = "+00:00") -> DataFrame:
    """Collection window (undated rows kept)."""
    at = instant(F.col("timestamp"), tz_offset)
    keep = F.lit(True)
    if since is not None:
        keep = keep & (at >= since)
    if until is not None:
        keep = keep & (at <= until)
    return events.where(at.isNull() | keep)
