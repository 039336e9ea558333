"""Built-in rule catalogue.

Fixed values: ids, categories, severities, scores, patterns and word lists below decide which
records match and how they score, so they are stated as they have to be.
"""

from __future__ import annotations

from tracelight.rules.model import Adjustment, Condition, Rule


def rx(field: str, pattern: str) -> Condition:
    return Condition(field=field, regex=pattern)


def eq(field: str, value: str) -> Condition:
    return Condition(field=field, equals=value)


def has(field: str, *needles: str) -> Condition:
    if len(needles) == 1:
        return Condition(field=field, contains=needles[0])
    return Condition(field=field, contains_any=needles)


def isin(field: str, *values: str) -> Condition:
    return Condition(field=field, values=values)


def atleast(field: str, bound: float) -> Condition:
    return Condition(field=field, gte=bound)


def status(*codes: int) -> Condition:
    return Condition(status_in=codes)


def every(*parts: Condition) -> Condition:
    return Condition(all=parts)


def either(*parts: Condition) -> Condition:
    return Condition(any=parts)


def plus(value: int, when: Condition, reason: str) -> Adjustment:
    return Adjustment(when, value, reason)


_ADVICE = {
    "http_access": "Review neighbouring requests, application errors and server-side changes around this time.",
    "db_log": "Check the database account's rights and compare with Web requests of the same minutes.",
    "waf_log": "Use as context: check access and application logs for a bypass of the filter.",
    "app_log": "Match the error with requests on the same path and with database or file evidence.",
}
_HOST_ADVICE = "Confirm origin, owner and change time on the host before escalating."


def _rule(rule_id: str, source: str, category: str, severity: str, base: int, name: str, match: Condition,
          *add: Adjustment) -> Rule:
    return Rule(id=rule_id, name=name, category=category, match=match, source=source, severity=severity, base=base,
                add=add, recommendation=_ADVICE.get(source, _HOST_ADVICE))


_WEB_RUNTIMES = r"(?i)(w3wp|tomcat|php-fpm|nginx|httpd|apache|node|dotnet|java|weblogic|jboss|wildfly)"
_LIVE_STATES = ("established", "syn_sent")
_WAF_ATTACK_NAMES = r"(?i)(sqli|sql injection|rce|command|path traversal|xss|webshell|deserialization)"
_ENDPOINT = r"(?i)(\d+\.\d+\.\d+\.\d+|:[0-9]{2,5})"

WEB_RULES = [
    _rule("WEB-SQLI-001", "http_access", "sqli", "medium", 55, "SQL injection structure in a request",
          rx("request", r"(?i)(union(?:\s|\+|%20|%09|%0a|%0d|/\*.*\*/)+select|information_schema|sleep(?:\s|%20)*\(|benchmark(?:\s|%20)*\(|(?:or|and)(?:\s|\+|%20)+(?:1|true)(?:\s|\+|%20)*(=|like))"),
          plus(10, status(200, 201, 202, 500), "status shows the request reached the application"),
          plus(10, atleast("same_ip_same_path_count_5m", 3), "same source probed the path repeatedly within 5 minutes")),
    _rule("WEB-RCE-001", "http_access", "rce", "high", 65, "Command execution tokens in a request",
          rx("request", r"(?i)((;|%3b|&&|%26%26|\|\||\||%7c|%0a).{0,120}\b(whoami|id|uname|cmd(?:\.exe)?|powershell|curl|wget|certutil|bash|sh)\b|(?:cmd|command|exec|shell)=[^&]{0,160}\b(whoami|id|uname|cmd(?:\.exe)?|powershell|curl|wget|certutil|bash|sh)\b)"),
          plus(10, status(200, 201, 202, 500), "status fits an attempted execution"),
          plus(10, atleast("same_ip_same_path_count_5m", 2), "repeated execution probes")),
    _rule("WEB-LFI-001", "http_access", "lfi", "medium", 55, "Path traversal or local file read in a request",
          rx("request", r"(?i)(\.\./|\.\.\\|%2e%2e%2f|%2e%2e%5c|\.\.%2f|\.\.%5c|\.%2e/|%252e%252e%252f|%252e%252e%255c|/etc/passwd|/proc/self/environ|boot\.ini|win\.ini|web\.config|\.env)"),
          plus(10, status(200, 206, 500), "status may mean a file was disclosed")),
    _rule("WEB-SSRF-001", "http_access", "ssrf", "medium", 55, "Internal or external URL in a parameter",
          rx("uri_query", r"(?i)(https?://|https?%3a%2f%2f|file://|gopher://|dict://|169\.254\.169\.254|metadata\.google\.internal|localhost|127\.0\.0\.1)"),
          plus(10, status(200, 201, 202, 500), "status shows the parameter was processed")),
    _rule("WEB-XSS-LOW-001", "http_access", "xss", "low", 35, "Cross-site scripting marker",
          rx("request", r"(?i)(<script|%3cscript|javascript:|onerror=|onload=|alert\(|document\.cookie)"),
          plus(5, status(200, 201, 202), "application answered with success")),
    _rule("WEB-UPLOAD-001", "http_access", "upload_webshell", "medium", 50, "Upload of a server-side script",
          every(eq("method", "POST"),
                either(rx("uri_path", r"(?i)(upload|file|avatar|attachment|media|plugin|theme)"),
                       rx("request", r"(?i)(\.php[0-9]?|\.phtml|\.phar|\.jsp|\.jspx|\.asp|\.aspx|\.ashx|\.war|\.jar)(?:$|[?&\s])"))),
          plus(10, status(200, 201, 202, 302), "upload endpoint answered with success")),
    _rule("WEB-SCANNER-001", "http_access", "scanner", "low", 35, "Scanner fingerprint or broad probing",
          either(has("user_agent", "sqlmap", "nikto", "acunetix", "nessus", "nuclei", "gobuster", "dirbuster", "zgrab"),
                 has("uri_path", "/.git/config", "/.env", "/phpinfo.php", "/wp-login.php", "/manager/html", "/server-status"),
                 every(status(404), atleast("same_ip_404_count_5m", 10))),
          plus(10, atleast("same_ip_404_count_5m", 10), "many 404 answers to one source within 5 minutes")),
    _rule("WEB-BRUTE-001", "http_access", "brute_force", "low", 35, "Failed login or admin authentication",
          every(eq("method", "POST"), rx("uri_path", r"(?i)(login|signin|auth|admin)"), status(401, 403, 429)),
          plus(25, atleast("same_ip_login_fail_count_5m", 5), "repeated failed logins of one source within 5 minutes")),
    _rule("WEB-INFOLEAK-001", "http_access", "info_leak", "medium", 50, "Probe for sensitive files or backups",
          rx("uri_path", r"(?i)(/(?:\.env|web\.config|config\.php|database\.yml|application\.yml|backup|dump|\.git|\.svn)|\.(?:bak|old|backup|sql|zip|tar|gz)$)"),
          plus(15, status(200, 206, 500), "status may mean the file was served")),
    _rule("WEB-FRAMEWORK-001", "http_access", "framework_probe", "medium", 60, "Framework exploitation probe",
          rx("request", r"(?i)(\$\{jndi:(?:ldap|rmi|dns)|/actuator(?:/env|/heapdump|/jolokia)?|/wls-wsat/|/console/login|struts2?|__viewstate|javax\.faces\.ViewState|/manager/html)"),
          plus(10, status(200, 500), "status shows the framework endpoint was reached")),
]

DB_RULES = [
    _rule("DB-AUTH-FAIL-001", "db_log", "db_auth_failure", "medium", 45, "Database login failure", eq("statement_type", "auth_failure"),
          plus(10, rx("client_ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), "log names the client address")),
    _rule("DB-FILE-ACCESS-001", "db_log", "db_file_access", "high", 70, "Database reads or writes server files",
          isin("statement_type", "file_read", "file_write"),
          plus(10, eq("statement_type", "file_write"), "statement writes a file")),
    _rule("DB-DELAY-001", "db_log", "db_delay", "medium", 55, "Database delay function", eq("statement_type", "delay"),
          plus(10, atleast("duration_ms", 5000), "logged duration fits a timing probe")),
    _rule("DB-PRIV-CHANGE-001", "db_log", "db_privilege_change", "high", 70, "Database account or privilege change",
          eq("statement_type", "privilege_change")),
    _rule("DB-CODE-EXEC-001", "db_log", "db_code_execution", "high", 75, "Database command execution primitive",
          eq("statement_type", "code_execution")),
    _rule("DB-ENUM-001", "db_log", "db_enumeration", "low", 40, "Database metadata enumeration", eq("statement_type", "enumeration")),
    _rule("DB-LINKED-SERVER-001", "db_log", "db_linked_server", "medium", 55, "Linked server access",
          eq("statement_type", "linked_server")),
]

WAF_RULES = [
    _rule("WAF-BLOCK-001", "waf_log", "waf_block", "low", 35, "Request blocked by WAF or CDN",
          either(isin("action", "block", "challenge"), rx("waf_rule_name", _WAF_ATTACK_NAMES)),
          plus(10, eq("action", "block"), "filter blocked the request"),
          plus(10, atleast("waf_score", 80), "filter score is high")),
    _rule("WAF-SUSPICIOUS-ALLOW-001", "waf_log", "waf_suspicious_allow", "low", 40, "Suspicious request passed by the WAF",
          every(isin("action", "allow", "log", "pass"),
                either(rx("waf_rule_name", _WAF_ATTACK_NAMES),
                       rx("path", r"(?i)(\.\./|%2e%2e|/\.env|/wp-login\.php|/actuator|/manager/html)")))),
]

_HAS_PATH = rx("http_path", r"^/")
APP_RULES = [
    _rule("APP-EXCEPTION-001", "app_log", "app_exception", "medium", 45, "Application error or exception",
          either(isin("level", "error", "fatal", "critical"), rx("exception_type", r"(?i)(Exception|Error|Throwable)$")),
          plus(10, _HAS_PATH, "error names an HTTP path")),
    _rule("APP-SQL-ERROR-001", "app_log", "app_sql_error", "medium", 55, "Application database error",
          either(rx("exception_type", r"(?i)(SQL|JDBC|PDO|Npgsql|SqlClient|Database).*(Exception|Error)?"),
                 rx("message_summary", r"(?i)(SQLSTATE|syntax error|database error|duplicate key|ORA-\d+|mysql|postgres|sql server)")),
          plus(10, _HAS_PATH, "SQL error names an HTTP path")),
    _rule("APP-SSRF-ERROR-001", "app_log", "app_ssrf_error", "medium", 50, "Outbound request error",
          rx("message_summary", r"(?i)(connection timed out|connection refused|unknown host|dns|metadata\.google\.internal|169\.254\.169\.254|java\.net\.|http client|requests\.exceptions)")),
    _rule("APP-DESERIALIZATION-001", "app_log", "app_deserialization", "medium", 60, "Deserialization or parser error",
          either(rx("exception_type", r"(?i)(InvalidClassException|SerializationException|JsonMappingException|ViewStateException|ObjectInputStream)"),
                 rx("message_summary", r"(?i)(deserialize|deserialization|ObjectInputStream|ysoserial|viewstate|fastjson|jackson)"))),
]

HOST_RULES = [
    _rule("HOST-PROC-001", "process", "anomalous_process", "medium", 45, "Interpreter or download tool in the process list",
          every(rx("command", r"(?i)((?:^|[\\/\s])(powershell(?:\.exe)?|cmd\.exe|curl(?:\.exe)?|wget(?:\.exe)?|certutil(?:\.exe)?|bitsadmin(?:\.exe)?|ncat(?:\.exe)?|nc(?:\.exe)?)(?:\s|$)|/bin/sh|/bin/bash|python\s+-c|perl\s+-e)"),
                either(rx("record", _WEB_RUNTIMES),
                       rx("command", r"(?i)(-enc\b|encodedcommand|frombase64string|curl(?:\.exe)?|wget(?:\.exe)?|certutil(?:\.exe)?|bitsadmin(?:\.exe)?|ncat(?:\.exe)?|nc(?:\.exe)?|python\s+-c|perl\s+-e)"))),
          plus(20, rx("record", _WEB_RUNTIMES), "command also names a Web runtime")),
    _rule("HOST-NET-001", "network", "anomalous_network", "medium", 55, "Web process connects to a public address",
          every(has("remote_class", "public", "public_or_other"),
                has("process_name", "w3wp", "java", "tomcat", "php-fpm", "node", "dotnet", "nginx", "httpd", "apache"),
                has("state", *_LIVE_STATES)),
          plus(15, isin("remote_port", "4444", "5555", "6666", "7777", "8081", "9001"), "port is unusual for Web backends")),
    _rule("HOST-PERSIST-001", "persistence", "anomalous_persistence", "medium", 60, "Suspicious autostart command",
          either(rx("command", r"(?i)((?:^|[\\/\s])(powershell(?:\.exe)?|cmd\.exe|curl(?:\.exe)?|wget(?:\.exe)?|certutil(?:\.exe)?|bitsadmin(?:\.exe)?|ncat(?:\.exe)?|nc(?:\.exe)?)(?:\s|$)|/bin/sh|/bin/bash|base64|frombase64string)"),
                 rx("path", r"(?i)(\\temp\\|/tmp/|/dev/shm)")),
          plus(10, isin("persistence_type", "scheduled_task", "startup_item"), "command starts automatically")),
    _rule("HOST-LINUX-HISTORY-001", "shell_history", "host_history", "medium", 62, "Suspicious shell history command",
          either(rx("command", r"(?i)(curl|wget)[^;|]*(;|\|)\s*(ba)?sh|curl[^;|]*\|\s*(ba)?sh"),
                 rx("command", r"(?i)/dev/tcp/|bash\s+-i\s+>&|nc\s+[^ ]*\s+-e\s|socat[^ ]*exec"),
                 rx("command", r"(?i)base64\s+(-d|-D|--decode)"),
                 rx("command", r"(?i)(chmod|chown)[^;]*(\+x|777)[^;]*(/tmp|/dev/shm|/var/tmp)"),
                 rx("command", r"(?i)history\s+-c|unset\s+HISTFILE|set\s+\+o\s+history|shred[^ ]*\s+[^ ]*history"),
                 rx("command", r"(?i)(>>?\s*)?[^ ]*(authorized_keys|sudoers|ld\.so\.preload|crontab)"),
                 rx("command", r"(?i)(python|perl|php)\s+-[cr]\s")),
          plus(15, rx("command", r"(?i)(/dev/tcp/|bash\s+-i\s+>&|nc\s+[^ ]*\s+-e\s)"), "reverse shell form"),
          plus(10, rx("command", r"(?i)(history\s+-c|unset\s+HISTFILE|shred)"), "history was wiped")),
    _rule("HOST-LINUX-PERSIST-MISC-001", "persistence", "anomalous_persistence", "high", 70, "High-signal Linux persistence artifact",
          either(has("kind", "ld_so_preload"), has("kind", "pam_unusual_module"), has("kind", "python_pth"),
                 rx("detail", r"(?i)(/dev/tcp/|bash\s+-i|base64\s+-d|nc\s+-e|curl[^|]*\|)"), has("kind", "tcp_wrapper")),
          plus(10, has("flag", "high_signal"), "classic backdoor location")),
    _rule("HOST-LINUX-SUDO-001", "sudoers", "privilege_abuse", "high", 66, "Risky sudo grant",
          either(has("flags", "nopasswd"), has("flags", "full_grant")),
          plus(12, has("flags", "full_grant"), "grant covers everything")),
    _rule("HOST-LINUX-SSH-001", "ssh_keys", "ssh_persistence", "high", 60, "Suspicious SSH key options",
          either(rx("detail", r"(?i)^(from=|command=|no-pty|permitopen)"), rx("detail", r"(?i)^options_prefix"))),
    _rule("HOST-LINUX-SSHD-001", "sshd_config", "ssh_persistence", "medium", 58, "Risky SSH server directive",
          either(has("flag", "non_default_authorized_keys_file"), has("flag", "authorized_keys_command_configured"),
                 has("flag", "force_command_configured"), has("flag", "empty_password_allowed"),
                 has("flag", "trusted_user_ca_configured"))),
    _rule("HOST-LINUX-DELETED-001", "deleted_open", "anomalous_process", "high", 72, "Process runs a deleted executable",
          either(rx("record", r".+")),
          plus(10, rx("record", r"(?i)(/tmp/|/dev/shm/|/var/tmp/)"), "binary was staged in a temporary folder")),
    _rule("HOST-LINUX-SUID-001", "suid_file", "privilege_abuse", "medium", 64, "SUID or SGID file in a staging place",
          every(rx("record", r"(?i)/tmp/|/dev/shm/|/var/tmp/|/home/|/var/www/"))),
    _rule("HOST-LINUX-LOGIN-001", "login_history", "anomalous_login", "low", 20, "Interactive login record",
          either(eq("record_type", "user_process"), eq("record_type", "last_login"))),
    _rule("HOST-WIN-REGPERSIST-001", "registry_persistence", "anomalous_persistence", "high", 68, "Suspicious registry autostart",
          either(rx("value", r"(?i)(\\\\temp\\\\|\\\\users\\\\public\\\\|\\\\programdata\\\\|\\\\appdata\\\\|powershell(?:\.exe)?\s+-|cmd\.exe\s+/c|rundll32|regsvr32|mshta|wscript|cscript)"),
                 has("category", "winlogon", "appinit", "appcert", "ifeo", "lsa", "print_monitor", "netsh_helper", "winsock_nsp",
                     "network_provider", "accessibility_hijack", "cmd_autorun"),
                 rx("value", r"(?i)^\s*$")),
          plus(10, has("category", "ifeo"), "debugger hijack point"),
          plus(12, has("category", "lsa"), "package loads into every logon")),
    _rule("HOST-WIN-WMI-001", "wmi_subscription", "anomalous_persistence", "high", 76, "WMI event subscription",
          either(has("class", "__CommandLineEventConsumer"), has("class", "__FilterToConsumerBinding"))),
    _rule("HOST-WIN-WMI-002", "wmi_subscription", "anomalous_persistence", "medium", 55, "WMI event filter with a trigger",
          every(eq("class", "__EventFilter"), rx("data", r"(?i)(Interval|ScriptText|SELECT\s+\*\s+FROM\s+__Instance)"))),
    _rule("HOST-PROC-TUNNEL-001", "process", "tunnel", "high", 72, "Tunnel or proxy tool process",
          either(rx("command", r"(?i)(frpc|frps|/nps |/nps$|chisel|gost|iox|earthworm|\bew\b|termite|sunny\-?client|ngrok|regeorg|tunna|dns2tcp|iodine|pproxy|ssf|ssocks|rssocks|lcx(?:\.exe)?)"),
                 rx("name", r"(?i)^(frpc|frps|nps|chisel|gost|iox|ew|termite|ngrok|iodine|dns2tcp)(?:\.exe)?$"),
                 rx("command", r"(?i)ssh\s+[^;]*\s-[DLR]\s|^ssh\s+.*-o\s+ProxyCommand"),
                 rx("command", r"(?i)(netsh\s+interface\s+portproxy|socat\s+[^;]*TCP4?-LISTEN)")),
          plus(8, rx("command", _ENDPOINT), "command names a remote endpoint")),
    _rule("HOST-RANSOM-PREP-001", "process", "ransomware", "critical", 90, "Ransomware preparation command",
          either(rx("command", r"(?i)vssadmin(?:\.exe)?\s+delete\s+shadows"),
                 rx("command", r"(?i)wbadmin(?:\.exe)?\s+delete\s+(catalog|systemstatebackup)"),
                 rx("command", r"(?i)bcdedit(?:\.exe)?\s+/set\s+[^ ]*\s*recoveryenabled\s+no"),
                 rx("command", r"(?i)wbemfreeze|shadow\s+copy\s+delete|wmic\s+shadowcopy\s+delete"))),
    _rule("HOST-HISTORY-RANSOM-001", "shell_history", "ransomware", "critical", 88, "Ransomware preparation in shell history",
          either(rx("command", r"(?i)vssadmin.*delete\s+shadows|wbadmin.*delete\s+(catalog|systemstatebackup)|bcdedit.*recoveryenabled\s+no"),
                 rx("command", r"(?i)(chmod|find|mv).*(\*\.(php|jpg|txt|docx?)|/var/www|/home)\s.*\.(locked|encrypted|crypt)"))),
    _rule("HOST-RMT-TOOL-001", "process", "remote_access_tool", "high", 68, "Remote-control software on a server",
          either(rx("name", r"(?i)^(todesk|rundll32.*todesk|sunloginclient|rustdesk|anydesk|teamviewer(?:_service)?|rserver3|radmin|gotorpc|netsupport|tv_w32|goha)(?:\.exe)?$"),
                 rx("command", r"(?i)(ToDesk|RustDesk|SunloginClient|AnyDesk|TeamViewer|rserver3|Radmin|GoToHTTP|NetSupport)[\\/ ]"),
                 rx("executable_path", r"(?i)(ToDesk|RustDesk|SunLogin|AnyDesk|TeamViewer|Radmin|GoToHTTP|NetSupport)")),
          plus(10, rx("command", r"(?i)(--pass|password|unattended)"), "unattended access flag")),
    _rule("HOST-RMT-REG-001", "registry_persistence", "remote_access_tool", "high", 64, "Remote-control autostart in the registry",
          either(rx("value", r"(?i)(ToDesk|SunLogin|RustDesk|AnyDesk|TeamViewer|rserver3|Radmin|GoToHTTP|NetSupport)"),
                 rx("path", r"(?i)(ToDesk|SunLogin|RustDesk|AnyDesk|TeamViewer|rserver3|Radmin)"))),
    _rule("HOST-NET-MINING-001", "network", "cryptomining", "high", 70, "Connection to a mining pool port",
          every(isin("remote_port", "3333", "4444", "5555", "7777", "8888", "8889", "9999", "14433", "14444", "14441", "14442",
                     "8899", "45700"),
                has("state", *_LIVE_STATES)),
          plus(12, rx("record", r"(?i)(stratum|xmr|monero|pool\.)"), "record mentions mining")),
    _rule("HOST-FW-NAT-001", "firewall", "lateral_movement", "medium", 58, "NAT or port-forward rule",
          either(rx("line", r"(?i)(-t nat|REDIRECT|DNAT|MASQUERADE|portproxy|listenaddress=)")),
          plus(10, rx("line", r"(?i)(4444|5555|8080|8888|1080|8443)"), "forwarded port is common for tooling")),
    _rule("HOST-HISTORY-TUNNEL-001", "shell_history", "tunnel", "high", 70, "Tunnel tool in shell history",
          either(rx("command", r"(?i)(frpc|frps|chisel|gost|iox|earthworm|termite|ngrok|regeorg|tunna|dns2tcp|iodine|pproxy|ssocks|rssocks|lcx|sunny\-?client)"),
                 rx("command", r"(?i)ssh\s+[^;]*\s-[DLR]\s+\S+|socat\s+[^;]*TCP4?-LISTEN|netsh\s+interface\s+portproxy")),
          plus(10, rx("command", _ENDPOINT), "command names a remote address or port")),
    _rule("HOST-HISTORY-SCAN-001", "shell_history", "scanner", "medium", 62, "Network scanner in shell history",
          either(rx("command", r"(?i)\bfscan\b|\bkscan\b|\bgoby\b|\bladon\b|\bmsfconsole\b|\bnetspy\b|\btscan\b"),
                 rx("command", r"(?i)\b(nmap|masscan|zmap|rustscan)\b[^;|]*(\s-[pPsS][0-9,\-/:]+|\s+(\d{1,3}\.){3}\d{1,3})")),
          plus(8, rx("command", r"(?i)(\d{1,3}\.){3}\d{1,3}(/\d{1,2})?"), "scan names an address or range")),
    _rule("HOST-HISTORY-DOWNLOAD-001", "shell_history", "host_history", "medium", 55, "Download from a bare address",
          either(rx("command", r"(?i)(curl|wget|axel|aria2c)[^;|]*https?://(\d{1,3}\.){3}\d{1,3}")),
          plus(12, rx("command", r"(?i)(/tmp/|/dev/shm/|\|\s*(ba)?sh|>\s*/dev/null)"), "download is staged or piped into a shell")),
    _rule("HOST-PROC-MEMFD-001", "process", "anomalous_process", "high", 75, "Process runs from memory only",
          either(rx("name", r"(?i)memfd:"), rx("command", r"(?i)memfd:"))),
    _rule("HOST-NET-BACKDOOR-001", "network", "anomalous_network", "medium", 65, "Connection to a known backdoor port",
          every(isin("remote_port", "1524", "1984", "2006", "6666", "6667", "6668", "6669", "7000", "13000", "14856", "25000",
                     "29812", "31337", "32982", "33369", "47107", "47018", "60922", "62883"),
                has("state", *_LIVE_STATES))),
    _rule("HOST-NET-EXFIL-001", "shell_history", "info_leak", "medium", 60, "Upload to a public file-sharing service",
          either(rx("command", r"(?i)(curl|wget)[^;|]*(pastebin\.com|transfer\.sh|mega\.nz|anonfiles\.com|wetransfer\.com|0x0\.st|file\.io|catbox\.moe|gofile\.io)"),
                 rx("command", r"(?i)(curl|wget)[^;|]*(\s-T\s|\s--upload-file\s|\s-F\s)"))),
    _rule("HOST-HISTORY-LATERAL-001", "shell_history", "lateral_movement", "medium", 58, "SSH options used for lateral movement",
          either(rx("command", r"(?i)StrictHostKeyChecking\s*=\s*no|UserKnownHostsFile\s*=\s*/dev/null"),
                 rx("command", r"(?i)\bsshpass\b"))),
    _rule("HOST-HISTORY-ANTIFORENSIC-001", "shell_history", "host_history", "high", 70, "Anti-forensic command",
          either(rx("command", r"(?i)chattr[^;|]*\+i|history\s+-c|unset\s+HISTFILE|set\s+\+o\s+history"),
                 rx("command", r"(?i)rm\s+-rf\s+/var/log|truncate\s+-s\s+0|shred\s+/var|logrotate\s+-f"))),
    _rule("HOST-KERN-COREPIPE-001", "kernel_params", "anomalous_persistence", "high", 78, "Core pattern pipes into a program",
          every(rx("param", r"(?i)^core_pattern$"), rx("value", r"^\|"))),
    _rule("HOST-FS-DOUBLEEXT-001", "fs_anomaly", "anomalous_process", "high", 70, "File masked by a double extension",
          either(rx("kind", r"^double_extension$"))),
    _rule("HOST-FS-WORLDWRITABLE-001", "fs_anomaly", "host_history", "medium", 50, "World-writable folder outside temp areas",
          either(rx("kind", r"^world_writable_dir$"))),
    _rule("HOST-FS-LARGEFILE-001", "fs_anomaly", "info_leak", "medium", 55, "Large file changed recently",
          either(rx("kind", r"^large_recent_file$"))),
    _rule("HOST-BIN-TAMPER-001", "bin_change", "privilege_abuse", "high", 65, "Security-critical binary changed",
          either(rx("path", r"(?i)^/(usr/)?s?bin/(sshd?|sudo|su|passwd|login|shadow|ps|ss|netstat|lsof|bash|dash|zsh|curl|wget|python3?|perl|socat|nc)([.-]|$)"))),
]

BUILTIN = [*WEB_RULES, *DB_RULES, *WAF_RULES, *APP_RULES, *HOST_RULES]
