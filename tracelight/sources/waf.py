"""WAF and CDN logs: JSON lines, bracket fields, key=value lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions.text import extract, sha256_hex
from tracelight.functions.times import naive_iso
from tracelight.functions.values import let
from tracelight.schema import WAF_EVENT
from tracelight.sources.jsonfields import pick, to_f64, to_u16, with_fields
from tracelight.sources.lines import Parsed, finish, parse_cases

REDACTED = ("vendor", "action", "rule_id", "rule_name", "client_ip", "proxy_ip", "host", "method", "path")
_PAIR = r"""([^\s=]*)=(?:"([^"]*)"?|'([^']*)'?|(\S*))"""


def stamp(value: Column, tz_offset: str) -> Column:
    return naive_iso(F.btrim(F.trim(value), F.lit("\"'")), tz_offset)


def leading_stamp(line: Column, tz_offset: str) -> Column:
    """``[stamp] …``, ``<RFC 3339> …`` or ``<date> <time> …`` at the start of a line."""
    bracket = extract(line, r"^\[([^\]]*)\]")
    words = F.split(F.trim(line), r"\s+")
    first, second = F.get(words, F.lit(0)), F.rtrim(F.get(words, F.lit(1)), F.lit(","))
    text = F.when(line.rlike(r"^\[[^\]]*\]"), bracket).when(first.contains("T"), F.rtrim(first, F.lit(","))).otherwise(
        F.concat(first, F.lit(" "), second)
    )
    return stamp(text, tz_offset)


def normalise_action(action: Column) -> Column:
    lowered = F.lower(action)
    return (
        F.when(lowered.rlike("block|deny|drop"), "block").when(lowered.rlike("challenge|captcha"), "challenge")
        .when(lowered.rlike("allow|pass"), "allow").otherwise(lowered)
    )


def vendor_from_path(path: Column) -> Column:
    lowered = F.lower(path)
    return (
        F.when(lowered.contains("modsec"), "modsecurity").when(lowered.contains("cloudflare"), "cloudflare")
        .when(lowered.contains("akamai"), "akamai").when(lowered.rlike("aws|alb"), "aws")
        .when(lowered.contains("waf"), "waf")
    )


def key_values(line: Column) -> Column:
    """``key=value`` pairs (quotes allowed) as a map; of repeated keys the last wins."""
    pairs = F.arrays_zip(
        *[F.regexp_extract_all(line, F.lit(_PAIR), F.lit(g)).alias(n) for g, n in ((1, "k"), (2, "d"), (3, "s"), (4, "b"))]
    )

    def entry(p: Column) -> Column:
        key = F.regexp_replace(F.lower(F.btrim(p["k"], F.lit("\"'"))), r"[-.]", "_")
        return F.struct(key.alias("key"), F.concat(p["d"], p["s"], p["b"]).alias("value"))

    usable = F.filter(F.transform(pairs, entry), lambda e: (e["key"] != "") & (e["value"] != ""))

    def to_map(entries: Column) -> Column:
        keys = F.transform(entries, lambda e: e["key"])
        values = F.transform(F.reverse(entries), lambda e: e["value"])
        reversed_keys = F.reverse(keys)
        names = F.array_distinct(keys)
        return F.map_from_arrays(
            names, F.transform(names, lambda k: F.get(values, (F.array_position(reversed_keys, k) - 1).cast("int")))
        )

    return let(usable, to_map)


def _json_columns(df: DataFrame, tz_offset: str) -> DataFrame:
    staged = with_fields(df, F.col("_text"), fold_case=True)
    m = F.col("_m")
    return staged.select(
        *df.columns,
        let(pick(m, "@timestamp", "timestamp", "time", "datetime"), lambda s: F.coalesce(stamp(s, tz_offset), s)).alias("timestamp"),
        F.coalesce(pick(m, "vendor", "source", "service", "provider"), vendor_from_path(F.col("source_file"))).alias("vendor"),
        normalise_action(pick(m, "action", "waf_action", "disposition", "event_action")).alias("action"),
        pick(m, "rule_id", "ruleid", "rule", "signature_id").alias("rule_id"),
        pick(m, "rule_name", "rulename", "message", "signature", "description").alias("rule_name"),
        pick(m, "client_ip", "source_ip", "src_ip", "remote_ip", "clientip", "cf-connecting-ip", "true-client-ip").alias("client_ip"),
        pick(m, "proxy_ip", "edge_ip", "remote_addr", "server_ip").alias("proxy_ip"),
        pick(m, "host", "hostname", "http_host").alias("host"), pick(m, "method", "http_method").alias("method"),
        pick(m, "path", "uri_path", "uri", "request_uri").alias("path"),
        to_u16(pick(m, "status", "sc_status", "edgeresponsestatus")).alias("status"),
        to_f64(pick(m, "score", "risk_score", "anomaly_score")).alias("score"), F.lit("waf_json").alias("parser_name"),
        F.when(F.size(m) >= 5, 0.88).otherwise(0.74).alias("parse_confidence"),
        F.when(m.isNull(), "WAF JSON log is not an object").alias("_error"),
    )


def _bracket_columns(df: DataFrame, tz_offset: str) -> DataFrame:
    line, lowered = F.col("_text"), F.lower("_text")
    cell = lambda key: extract(line, rf'\[{key} "(.*?)"\]')
    return df.select(
        *df.columns, leading_stamp(line, tz_offset).alias("timestamp"), F.lit("modsecurity").alias("vendor"),
        F.when(lowered.rlike("access denied|blocked"), "block").when(lowered.contains("warning"), "log").alias("action"),
        cell("id").alias("rule_id"), cell("msg").alias("rule_name"), cell("client").alias("client_ip"),
        cell("hostname").alias("host"), cell("uri").alias("path"), to_u16(cell("status")).alias("status"),
        F.lit("modsecurity").alias("parser_name"), F.lit(0.82).alias("parse_confidence"), F.lit(None).cast("string").alias("_error"),
    )


def _pair_columns(df: DataFrame, tz_offset: str) -> DataFrame:
    staged = df.withColumn("_m", key_values(F.col("_text")))
    m = F.col("_m")
    first = lambda *keys: F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in keys])
    return staged.select(
        *df.columns, F.coalesce(stamp(first("timestamp", "time"), tz_offset), leading_stamp(F.col("_text"), tz_offset)).alias("timestamp"),
        F.coalesce(first("vendor", "source"), vendor_from_path(F.col("source_file"))).alias("vendor"),
        normalise_action(first("action")).alias("action"), first("rule_id", "rule").alias("rule_id"),
        first("rule_name", "message").alias("rule_name"), first("client_ip", "source_ip", "src_ip").alias("client_ip"),
        first("proxy_ip", "remote_addr").alias("proxy_ip"), first("host", "hostname").alias("host"),
        first("method").alias("method"), first("path", "uri", "request_uri").alias("path"), to_u16(first("status")).alias("status"),
        to_f64(first("score")).alias("score"), F.lit("waf_kv").alias("parser_name"), F.lit(0.76).alias("parse_confidence"),
        F.when(F.size(m) == 0, "line does not look like a supported WAF log event").alias("_error"),
    )


def parse_waf(lines: DataFrame, tz_offset: str = "+00:00", redact_secrets: bool = False) -> Parsed:
    """WAF/CDN lines; each line is JSON, bracket style or key=value."""
    staged = lines.withColumn("_text", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")))
    line = F.col("_text")
    cases = [
        (line.startswith("{"), lambda df: _json_columns(df, tz_offset)),
        (F.lower(line).contains("modsecurity"), lambda df: _bracket_columns(df, tz_offset)),
        (F.lit(True), lambda df: _pair_columns(df, tz_offset)),
    ]
    merged = parse_cases(staged, "_text", cases, WAF_EVENT).withColumn("raw_hash", sha256_hex(line))
    return finish(merged, WAF_EVENT, parser=F.lit("waf_log"), redacted=REDACTED, redact_secrets=redact_secrets)
