"""Host configuration files of a fleet: shell history, sudoers, SSH, cron, systemd, accounts, rc files.

Inputs are line tables ``(source_file, line_number, text)`` with optional ``host``, ``user``,
``home_dir`` and ``mtime`` columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelight.functions.text import extract
from tracelight.functions.times import epoch_iso
from tracelight.functions.values import contains_any, holds, text
from tracelight.operators.ordered import BLOCK_LINES, carry_forward
from tracelight.operators.splits import carry_in_splits, in_splits

_EXTRA = ("host", "user", "home_dir", "mtime")


def _keep(df: DataFrame, *also: str) -> list[str]:
    return [c for c in (*_EXTRA, *also) if c in df.columns]


def _name(path: str = "source_file") -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def parse_shell_history(lines: DataFrame) -> DataFrame:
    """Commands with the time they ran.

    zsh lines carry their own time. A bash ``#epoch`` line dates the next command; a command ending
    in a backslash keeps the time for the following line. A dated stretch is therefore open from the
    ``#epoch`` line up to and including the first command without a trailing backslash.
    """
    staged = lines.withColumn("_t", F.regexp_replace("text", r"\r+$", "")).where(F.col("_t") != "")
    t = F.col("_t")
    zsh = extract(t, r"^:\s*(\d+)\s*(?::[^;]*)?;")
    mark = extract(t, r"^#\s*(\d+)\s*$")
    staged = staged.withColumn("_zsh", zsh.cast("long")).withColumn("_mark", F.when(F.col("_zsh").isNull(), mark.cast("long")))
    is_command = F.col("_zsh").isNull() & F.col("_mark").isNull()
    # the state after a line: an open epoch, or closed (-1)
    state = (
        F.when(F.col("_mark").isNotNull(), F.col("_mark")).when(F.col("_zsh").isNotNull(), F.lit(-1).cast("long"))
        .when(is_command & ~t.endswith("\\"), F.lit(-1).cast("long"))
    )
    after = staged.withColumn("_state", state)
    # the state before a line is the state after the nearest earlier line that sets one
    if in_splits(lines):
        opened = carry_in_splits(after, {"_before": F.col("_state")}, before=True)
    else:
        opened = _previous_state(carry_forward(after, "source_file", "line_number", {"_self": F.col("_state")}))
    epoch = F.when(F.col("_zsh").isNotNull(), F.col("_zsh")).when(is_command & (F.col("_before") >= 0), F.col("_before"))
    command = F.trim(F.when(F.col("_zsh").isNotNull(), F.regexp_replace(t, r"^:[^;]*;", "")).otherwise(t))
    rows = opened.where(F.col("_mark").isNull()).select(
        *_keep(lines), F.col("source_file").alias("history_file"), F.col("line_number").alias("line_no"),
        F.coalesce(epoch_iso(epoch), F.lit("")).alias("timestamp"), command.alias("command"),
    )
    return rows.where(F.col("command") != "")


def _previous_state(df: DataFrame) -> DataFrame:
    """Adds ``_before``: ``_self`` of the previous row of the file."""
    blocked = df.withColumn("_block", F.floor(F.col("line_number") / BLOCK_LINES))
    inside = W.partitionBy("source_file", "_block").orderBy("line_number")
    ends = blocked.groupBy("source_file", "_block").agg(F.max_by("_self", "line_number").alias("_end"))
    before = W.partitionBy("source_file").orderBy("_block")
    entry = ends.select("source_file", "_block", F.lag("_end").over(before).alias("_entry"))
    local = blocked.withColumn("_lag", F.lag("_self").over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    return local.join(entry, ["source_file", "_block"], "left").withColumn(
        "_before", F.when(F.col("_first"), F.col("_entry")).otherwise(F.col("_lag"))
    )


def parse_sudoers(lines: DataFrame) -> DataFrame:
    """Grants with their risk flags; defaults and aliases keep the whole line."""
    t = F.trim(F.regexp_replace(F.trim("text"), r"\\$", ""))
    staged = lines.withColumn("_t", t).where((F.col("_t") != "") & ~F.col("_t").rlike("^[#@]"))
    line = F.col("_t")
    plain = line.startswith("Defaults") | line.contains("_Alias")
    user = F.regexp_extract(line, r"^(\S+)", 1)
    rest = F.regexp_replace(line, r"^\S+\s*", "")
    host = F.regexp_extract(rest, r"^([^=(\s]*)", 1)
    tail = F.regexp_replace(F.regexp_replace(rest, r"^[^=(\s]*\s*", ""), r"^=\s*", "")
    runas = F.regexp_extract(tail, r"^\(([^)]*)\)", 1)
    commands = F.regexp_replace(tail, r"^\([^)]*\)\s*", "")
    lowered = F.lower(commands)
    full = (host == "ALL") & (runas.startswith("ALL") | (runas == "")) & (F.trim(commands) == "ALL")
    flags = F.array_join(F.array_compact(F.array(
        F.when(lowered.contains("nopasswd"), F.lit("nopasswd")), F.when(lowered.contains("noexec:off"), F.lit("noexec_off")),
        F.when(full, F.lit("full_grant")), F.when(lowered.contains("setenv"), F.lit("setenv")),
    )), "|")
    pick = lambda value, default="": F.when(plain, F.lit(default)).otherwise(value)
    keep = [c for c in _keep(lines) if c not in ("host", "user")]
    return staged.select(
        *keep, *([F.col("host").alias("machine")] if "host" in lines.columns else []), "source_file", F.col("line_number").alias("line_no"),
        pick(user).alias("user"), pick(host).alias("host"), pick(runas).alias("runas"),
        F.when(plain, line).otherwise(commands).alias("commands"),
        F.when(plain, "defaults_or_alias").otherwise(flags).alias("flags"),
    )


def parse_ssh_keys(lines: DataFrame) -> DataFrame:
    """Rows of a user's SSH folder: authorized keys, known hosts, client config, rc and environment."""
    name = _name()
    kind = (
        F.when(name.startswith("authorized_keys"), "authorized_keys").when(name == "known_hosts", "known_hosts")
        .when(name == "config", "ssh_config").when(name == "rc", "ssh_rc").when(name == "environment", "ssh_environment")
    )
    staged = lines.withColumn("kind", kind).withColumn("_t", F.trim("text")).where(F.col("kind").isNotNull() & (F.col("_t") != ""))
    words = F.split(F.col("_t"), r"\s+")
    first, last = F.get(words, F.lit(0)), F.element_at(words, -1)
    is_key = first.contains("=") | first.rlike("^(ssh-|ecdsa-|sk-)")
    detail = (
        F.when(F.col("kind") == "authorized_keys", F.when(is_key, F.concat(first, F.lit(" ... "), last)).otherwise(
            F.concat(F.lit("options_prefix: "), first)))
        .when(F.col("kind") == "known_hosts", first).when(F.col("kind") == "ssh_environment", "environment_entry")
        .otherwise(F.col("_t"))
    )
    return staged.select(*_keep(lines), F.col("source_file").alias("file"), "kind", F.col("line_number").alias("line_no"), detail.alias("detail"))


def _directives(lines: DataFrame) -> DataFrame:
    staged = lines.withColumn("_t", F.trim("text")).where((F.col("_t") != "") & ~F.col("_t").startswith("#") & F.col("_t").rlike(r"\s"))
    return staged.withColumn("key", F.lower(F.regexp_extract("_t", r"^(\S+)", 1))).withColumn("value", F.trim(F.regexp_replace("_t", r"^\S+", "")))


def parse_sshd_config(lines: DataFrame) -> DataFrame:
    """Server directives that widen access."""
    key, value = F.col("key"), F.col("value")
    yes = F.lower(value) == "yes"
    flag = (
        F.when((key == "permitrootlogin") & yes, "root_login_allowed").when((key == "passwordauthentication") & yes, "password_auth_allowed")
        .when((key == "permitemptypasswords") & yes, "empty_password_allowed")
        .when((key == "authorizedkeysfile") & ~value.contains(".ssh/authorized_keys"), "non_default_authorized_keys_file")
        .when(key == "authorizedkeyscommand", "authorized_keys_command_configured").when(key == "forcecommand", "force_command_configured")
        .when(key == "authorizedprincipalsfile", "authorized_principals_configured")
        .when(key.isin("trustedusercakeys", "trustedusercacafile"), "trusted_user_ca_configured")
    )
    return _directives(lines).withColumn("flag", flag).where(F.col("flag").isNotNull()).select(
        *_keep(lines), "key", "value", "flag", "source_file", F.col("line_number").alias("line_no"))


def parse_ssh_client_config(lines: DataFrame) -> DataFrame:
    """Client directives that run commands or pull in other files."""
    risky = F.col("key").isin("proxycommand", "proxyjump", "localcommand", "permitlocalcommand", "include")
    return _directives(lines).where(risky).select(
        *_keep(lines), "key", "value", F.lit("ssh_client_execution_or_include").alias("flag"), "source_file", F.col("line_number").alias("line_no"))


def parse_cron(lines: DataFrame, source: str) -> DataFrame:
    """Crontab entries; system tables (``system_crontab``, ``cron_d``) name the user in the sixth field."""
    t = F.trim("text")
    staged = lines.withColumn("_t", t).where((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    staged = staged.where(~(F.col("_t").contains("=") & ~F.col("_t").rlike(r"\s"))).withColumn("_f", F.split("_t", r"\s+")).where(F.size("_f") >= 6)
    system = source in ("system_crontab", "cron_d")
    user = F.get("_f", F.lit(5)) if system else _name()
    command = F.array_join(F.slice("_f", 7 if system else 6, F.greatest(F.size("_f") - (6 if system else 5), F.lit(0))), " ")
    return staged.select(
        *[c for c in _keep(lines) if c != "user"], F.concat(_name(), F.lit(":"), F.col("line_number").cast("string")).alias("name"),
        F.col("source_file").alias("path"), F.lit("configured").alias("state"), command.alias("command"), user.alias("user"), F.lit(source).alias("source"),
    ).where(F.col("command") != "")


def parse_systemd(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Services and timers from unit files: the first value of each key counts."""
    unit = F.when(_name().rlike(r"\.(service|timer)$"), _name())
    t = F.trim("text")
    staged = lines.withColumn("_unit", unit).withColumn("_t", t).where(F.col("_unit").isNotNull() & (F.col("_t") != "") & ~F.col("_t").startswith("#"))
    has_pair = F.col("_t").contains("=")
    staged = staged.withColumn("_k", F.when(has_pair, F.trim(F.split_part("_t", F.lit("="), F.lit(1))))).withColumn(
        "_v", F.when(has_pair, F.trim(F.regexp_replace("_t", r"^[^=]*=", ""))))
    first = lambda key: F.min_by("_v", F.when(F.col("_k") == key, F.col("line_number"))).alias(f"v_{key}")
    keys = ["ExecStart", "ExecStartPre", "ExecStartPost", "User", "Description", "WantedBy"]
    keep = [c for c in _keep(lines) if c != "user"]
    units = staged.groupBy(*keep, "source_file", "_unit").agg(*[first(k) for k in keys], F.min_by("_t", "line_number").alias("_lead"))
    command = F.concat_ws("; ", "v_ExecStart", "v_ExecStartPre", "v_ExecStartPost")
    command = F.when(command == "", text(F.col("_lead"))).otherwise(command)
    user = F.coalesce("v_User", F.lit("root_or_system"))
    timers = units.where(F.col("_unit").endswith(".timer")).select(
        *keep, F.col("_unit").alias("name"), F.col("source_file").alias("path"), F.lit("configured").alias("state"), command.alias("command"),
        user.alias("user"), F.lit("systemd_timer").alias("source"))
    services = units.where(F.col("_unit").endswith(".service")).select(
        *keep, F.col("_unit").alias("name"), text(F.col("v_Description")).alias("display_name"), F.lit("configured").alias("state"),
        F.coalesce(F.concat(F.lit("enabled_target:"), "v_WantedBy"), F.lit("unknown")).alias("start_mode"), command.alias("path"),
        user.alias("user"), F.col("source_file").alias("source"))
    return services, timers


def _fields(lines: DataFrame, least: int) -> DataFrame:
    staged = lines.where((F.trim("text") != "") & ~F.ltrim("text").startswith("#")).withColumn("_f", F.split("text", ":"))
    return staged.where(F.size("_f") >= least)


def _f(i: int) -> Column:
    return F.get("_f", F.lit(i))


PRIVILEGED_GROUPS = ["sudo", "wheel", "admin", "root", "docker"]
_NO_LOGIN = ["/usr/sbin/nologin", "/sbin/nologin", "/bin/false", "/usr/bin/false"]


def parse_accounts(passwd: DataFrame, group: DataFrame, shadow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users with their lock state, and privileged users; per ``host`` when the lines carry one."""
    host = ["host"] if "host" in passwd.columns else []
    last = lambda df, *cols: df.groupBy(*host, _f(0).alias("name")).agg(*[F.max_by(c, "line_number").alias(n) for n, c in cols])
    users = last(_fields(passwd, 5), ("uid", _f(2)), ("gecos", _f(4)))
    locks = last(_fields(shadow, 2), ("locked", _f(1).rlike(r"^[!*]")))
    joined = users.join(locks, [*host, "name"], "left")
    table = joined.select(
        *host, "name", F.coalesce((~F.col("locked")).cast("string"), F.lit("unknown")).alias("enabled"), F.col("uid").alias("uid_or_sid"),
        F.col("gecos").alias("description"), F.lit("/etc/passwd").alias("source"))
    groups = last(_fields(group, 4), ("members", _f(3))).where(F.col("name").isin(*PRIVILEGED_GROUPS)).withColumnRenamed("name", "group")
    members = groups.withColumn("name", F.explode(F.transform(F.split("members", ","), F.trim))).where(F.col("name") != "")
    by_group = members.join(users.select(*host, "name", "uid"), [*host, "name"], "left").select(
        *host, "name", "group", text(F.col("uid")).alias("uid_or_sid"), F.lit("/etc/group").alias("source"))
    by_uid = users.where(F.col("uid") == "0").select(
        *host, "name", F.lit("uid0").alias("group"), F.col("uid").alias("uid_or_sid"), F.lit("/etc/passwd").alias("source"))
    return table, by_uid.unionByName(by_group).dropDuplicates([*host, "group", "name"])


def account_issues(passwd: DataFrame, shadow: DataFrame) -> DataFrame:
    """Empty or weak passwords, extra uid 0, hidden or service accounts with a login shell, shared uids (one row per account)."""
    host = ["host"] if "host" in passwd.columns else []
    issue = lambda df, user, name, source: df.select(*host, user.alias("user"), name.alias("issue"), F.lit(source).alias("source"))
    secrets = shadow.withColumn("_f", F.split("text", ":")).where(F.size("_f") >= 2)
    weak = F.when(_f(1) == "", "empty_password").when(_f(1).startswith("$1$"), "weak_hash_md5")
    rows = passwd.withColumn("_f", F.split("text", ":")).where(F.size("_f") >= 7).select(
        *host, "line_number", _f(0).alias("name"), _f(2).alias("uid"), _f(6).alias("shell"))
    number = F.when(F.col("uid").rlike(r"^\+?\d{1,10}$"), F.col("uid").cast("long"))
    stranger = F.col("name") != "root"
    extra_root = rows.where(stranger & holds(number == 0))
    login = stranger & (F.col("name").startswith(".") | (holds(number < 1000) & ~F.col("shell").isin(*_NO_LOGIN)))
    # one row per account of a shared uid, so that a uid used everywhere is not gathered
    shared = rows.groupBy(*host, "uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*host, "uid")
    twins = rows.join(shared, [*host, "uid"])
    return (
        issue(secrets.where(weak.isNotNull()), _f(0), weak, "/etc/shadow")
        .unionByName(issue(extra_root, F.col("name"), F.lit("additional_uid0_account"), "/etc/passwd"))
        .unionByName(issue(rows.where(login), F.col("name"), F.lit("service_or_hidden_account_with_login_shell"), "/etc/passwd"))
        .unionByName(issue(twins, F.col("name"), F.concat(F.lit("duplicate_uid:"), "uid"), "/etc/passwd"))
    )


_RC_WORDS = ["curl", "wget", "base64", "nc -e", "/dev/tcp/", "python -c", "perl -e", "/tmp/", "/dev/shm"]


def rc_hook(line: Column) -> Column:
    """Kind of hook a shell start-up line sets, NULL when harmless."""
    suspicious = contains_any(line, _RC_WORDS)
    return (
        F.when(line.startswith("alias ") & suspicious, "suspicious_alias")
        .when((line.contains("function ") | line.contains("() {")) & suspicious, "suspicious_function")
        .when(line.startswith("PROMPT_COMMAND=") & suspicious, "prompt_command_hook").when(line.startswith("trap "), "trap_hook")
        .when(line.startswith("export ") & F.lower(line).rlike("ld preload|ld_preload"), "ld_preload_export")
    )


def parse_rc_files(lines: DataFrame) -> DataFrame:
    staged = lines.withColumn("_t", F.trim("text")).where((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    return staged.withColumn("kind", rc_hook(F.col("_t"))).where(F.col("kind").isNotNull()).select(
        *_keep(lines), F.col("source_file").alias("file"), F.col("line_number").alias("line_no"), "kind", F.col("_t").alias("detail"))
