"""Web runtime configuration: servlet/Tomcat XML, IIS and ASP.NET XML, Spring mappings.

Inputs are whole files ``(source_file, text)`` with optional ``mtime`` and ``is_recent``; results are
component rows with risk flags and a stable id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions.text import extract, sha256_hex
from tracelight.functions.values import contains_any, let, sorted_join, text
from tracelight.sources.host_events import decode_xml

# Words in a component or class name that raise a flag, and mappings that cover everything.
SUSPICIOUS_NAMES = ["memshell", "memoryshell", "webshell", "cmd", "shell", "exec", "payload", "inject", "agent", "loader",
                    "godzilla", "behinder", "rebeyond"]
BROAD_MAPPINGS = ["/", "/*", "*", "/**"]
HIGH_FLAGS = "broad_mapping|management_endpoint_exposure|suspicious_name|suspicious_class|handler_script_processor|privileged_app_pool_identity|baseline_new"
MEDIUM_FLAGS = "recent_change|webapps_artifact|work_temp_artifact|static_archive_component|native_image_path|unknown_signature|web_config_change"
PRIVILEGED_IDENTITIES = ["localsystem", "administrator"]


def is_suspicious_name(value: Column) -> Column:
    return contains_any(value, SUSPICIOUS_NAMES)


def is_broad_mapping(value: Column) -> Column:
    return F.trim(text(value)).isin(*BROAD_MAPPINGS)


def confidence_for_flags(flags: Column) -> Column:
    return F.when(flags.rlike(HIGH_FLAGS), "high").when(flags.rlike(MEDIUM_FLAGS), "medium").otherwise("low")


def component_id(*parts: Column) -> Column:
    return F.concat(F.lit("RT-"), F.substring(sha256_hex(F.concat_ws("|", *[text(p) for p in parts])), 1, 16))


def blocks(xml: Column, tag: str) -> Column:
    """Bodies of all elements of a name, start tag included."""
    return F.regexp_extract_all(xml, F.lit(rf"(?is)(<{tag}(?:\s[^>]*)?>.*?</{tag}>)"), F.lit(1))


def starts(xml: Column, tag: str) -> Column:
    """All start tags of a name."""
    return F.regexp_extract_all(xml, F.lit(rf"(?is)(<{tag}\b[^>]*>)"), F.lit(1))


def element_text(xml: Column, tag: str) -> Column:
    return let(decode_xml(extract(xml, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>")), lambda v: F.when(v != "", v))


def attribute(tag: Column, name: str) -> Column:
    return decode_xml(extract(tag, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']"))


def _files(files: DataFrame) -> DataFrame:
    have = set(files.columns)
    return files.select(
        "source_file", F.regexp_replace("text", r"(?s)<!--.*?-->", "").alias("xml"), sha256_hex(F.col("text")).alias("sha256"),
        (F.col("mtime") if "mtime" in have else F.lit("unknown")).alias("mtime"), (F.col("is_recent") if "is_recent" in have else F.lit(False)).alias("is_recent"))


def _last_part(name: Column, default: str) -> Column:
    return let(F.element_at(F.split(text(name), r"\."), -1), lambda v: F.when(v != "", v).otherwise(F.lit(default)))


def parse_tomcat_xml(files: DataFrame) -> DataFrame:
    """Filters, servlets, listeners, valves and realms; mappings find their class by name within the file."""
    base = _files(files)
    keep = ["source_file", "sha256", "mtime", "is_recent"]
    item = lambda tag: base.select(*keep, F.explode(blocks(F.col("xml"), tag)).alias("b"))

    def declared(tag: str) -> DataFrame:
        body = element_text(F.col("b"), f"{tag}-class")
        if tag == "servlet":
            body = F.coalesce(body, element_text(F.col("b"), "jsp-file"))
        return item(tag).select(*keep, F.lit(tag).alias("component_type"), text(element_text(F.col("b"), f"{tag}-name")).alias("name"),
                                text(body).alias("class_name"), F.lit("").alias("url_pattern"))

    def mapped(tag: str) -> DataFrame:
        rows = item(f"{tag}-mapping").select(*keep, text(element_text(F.col("b"), f"{tag}-name")).alias("name"), F.explode(blocks(F.col("b"), "url-pattern")).alias("p"))
        known = declared(tag).select("source_file", "name", "class_name").groupBy("source_file", "name").agg(F.max("class_name").alias("class_name"))
        return rows.join(known, ["source_file", "name"], "left").select(
            *keep, F.lit(f"{tag}_mapping").alias("component_type"), "name", text(F.col("class_name")).alias("class_name"),
            text(element_text(F.col("p"), "url-pattern")).alias("url_pattern"))

    listener = item("listener").select(*keep, F.lit("listener").alias("component_type"), text(element_text(F.col("b"), "listener-class")).alias("class_name")).select(
        *keep, "component_type", _last_part(F.col("class_name"), "listener").alias("name"), "class_name", F.lit("").alias("url_pattern"))

    def tagged(tag: str) -> DataFrame:
        rows = base.select(*keep, F.explode(starts(F.col("xml"), tag)).alias("t")).withColumn("class_name", text(attribute(F.col("t"), "className")))
        return rows.select(*keep, F.lit(tag.lower()).alias("component_type"), F.coalesce(attribute(F.col("t"), r"(?<![A-Za-z])name"), _last_part(F.col("class_name"), tag.lower())).alias("name"),
                           "class_name", F.lit("").alias("url_pattern"))

    rows = reduce(DataFrame.unionByName, [declared("filter"), mapped("filter"), listener, declared("servlet"), mapped("servlet"), tagged("Valve"), tagged("Realm")])
    flags = sorted_join([
        F.when(F.col("is_recent"), F.lit("recent_change")), F.when(is_broad_mapping(F.col("url_pattern")), F.lit("broad_mapping")),
        F.when(is_suspicious_name(F.col("name")), F.lit("suspicious_name")), F.when(is_suspicious_name(F.col("class_name")), F.lit("suspicious_class"))])
    return _finish(rows, "tomcat", flags, F.col("url_pattern"))


def _finish(rows: DataFrame, runtime: str, flags: Column, route: Column, also: tuple[str, ...] = ()) -> DataFrame:
    flagged = rows.withColumn("risk_flags", flags).withColumn("runtime_type", F.lit(runtime)).withColumn("route_or_pattern", route)
    ident = component_id(F.lit(runtime), F.col("component_type"), F.col("name"), F.col("class_name"), F.col("route_or_pattern"), F.col("source_file"), F.col("sha256"))
    return flagged.withColumn("confidence", confidence_for_flags(F.col("risk_flags"))).withColumn("component_id", ident).select(
        "component_id", "runtime_type", "component_type", "name", "class_name", "route_or_pattern", "source_file", "mtime", "sha256",
        "is_recent", F.lit(False).alias("is_baseline_new"), "risk_flags", "confidence", F.lit(0).cast("bigint").alias("line_number"), *also)


def parse_iis_config(files: DataFrame) -> DataFrame:
    """Modules, handlers, FastCGI applications and privileged application pools of IIS/ASP.NET configuration."""
    base = _files(files).withColumn("is_site", F.lower("source_file").endswith("web.config"))
    keep = ["source_file", "sha256", "mtime", "is_recent", "is_site"]
    a = lambda name: attribute(F.col("t"), rf"(?<![A-Za-z]){name}")
    inside = lambda section, tag: base.select(*keep, F.explode(blocks(F.col("xml"), section)).alias("b")).select(*keep, F.explode(starts(F.col("b"), tag)).alias("t"))

    def shape(rows: DataFrame, kind: Column | str, name: Column, image: Column, class_name: Column, route: Column, *extra: Column) -> DataFrame:
        return rows.select(*keep, (F.lit(kind) if isinstance(kind, str) else kind).alias("component_type"), text(name).alias("name"),
                           text(image).alias("image"), text(class_name).alias("class_name"), text(route).alias("route"), F.array_compact(F.array(*extra)).alias("extra"))

    site_flag = lambda g, s: F.when(F.col("is_site"), F.lit(s)).otherwise(F.lit(g))
    empty = F.lit("")
    native = lambda image: F.when(F.lower(text(image)).rlike(r"\.dll$"), F.lit("native_image_path"))
    modules = shape(inside("globalModules", "add"), "global_module", F.coalesce(a("name"), F.lit("global_module")), a("image"), a("preCondition"), empty,
                    F.lit("global_module"), native(a("image")))
    plain = shape(inside("modules", "add"), "module", F.coalesce(a("name"), F.lit("module")), F.coalesce(a("type"), a("image")), a("preCondition"), empty,
                  site_flag("global_module", "site_module"))
    handlers = shape(inside("handlers", "add"), "handler", F.coalesce(a("name"), F.lit("handler")), F.coalesce(a("scriptProcessor"), a("type")), a("resourceType"), a("path"),
                     site_flag("global_handler", "site_handler"), F.when(text(a("scriptProcessor")) != "", F.lit("handler_script_processor")),
                     F.when(is_broad_mapping(a("path")), F.lit("broad_mapping")))
    fastcgi = shape(inside("fastCgi", "application"), "fastcgi", F.concat_ws(" ", a("fullPath"), F.when(text(a("arguments")) != "", a("arguments"))), a("fullPath"), empty, empty,
                    F.lit("fastcgi"), F.lit("native_image_path"))
    pools = base.select(*keep, F.explode(blocks(F.col("xml"), "applicationPools")).alias("b")).select(
        *keep, F.explode(F.regexp_extract_all(F.col("b"), F.lit(r"(?is)(<add\b[^>]*/>|<add\b[^>]*>.*?</add>)"), F.lit(1))).alias("t"))
    pools = pools.withColumn("identity", text(attribute(F.col("t"), "identityType"))).withColumn("user", text(attribute(F.col("t"), "userName")))
    privileged = pools.where(contains_any(F.concat_ws(":", "identity", "user"), PRIVILEGED_IDENTITIES))
    pool_rows = shape(privileged, "app_pool_identity", a("name"), F.concat_ws(":", F.when(F.col("identity") != "", F.col("identity")), F.when(F.col("user") != "", F.col("user"))),
                      empty, empty, F.lit("privileged_app_pool_identity"))
    rows = reduce(DataFrame.unionByName, [modules, plain, handlers, fastcgi, pool_rows])
    own = F.array_compact(F.array(
        F.when(F.col("is_recent"), F.lit("recent_change")), F.when(F.col("is_site"), F.lit("web_config_change")),
        F.when(is_suspicious_name(F.col("name")), F.lit("suspicious_name")), F.when(is_suspicious_name(F.col("image")), F.lit("suspicious_class"))))
    flags = F.array_join(F.array_sort(F.array_distinct(F.concat("extra", own))), ";")
    return _finish(rows.withColumn("class_name", F.when(F.col("class_name") == "", F.col("image")).otherwise(F.col("class_name"))), "iis", flags, F.col("route"))


_LOG_MAPPING = (r"(?i)(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)?\s*(?:\{|\[)?\s*(/[A-Za-z0-9_./*{}-]+)\s*(?:\}|\])?.{0,160}?"
                r"([A-Za-z_$][A-Za-z0-9_$.]+(?:Controller|Handler|Interceptor|Filter))")
_LITERAL_MAPPING = r"(?i)(RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping).{0,80}?(/[A-Za-z0-9_./*{}-]+)"


def _mapping_rows(rows: DataFrame, source: str, *extra: str) -> DataFrame:
    flags = sorted_join([
        *[F.lit(e) for e in extra], F.when(is_broad_mapping(F.col("route")), F.lit("broad_mapping")),
        F.when(is_suspicious_name(F.col("route")) | is_suspicious_name(F.col("class_name")), F.lit("suspicious_name")),
        F.when(F.col("route").rlike("/actuator|/env|/heapdump"), F.lit("management_endpoint_exposure"))])
    shaped = rows.withColumn("component_type", F.lit("controller")).withColumn("name", F.col("route")).withColumn("sha256", F.lit("")).withColumn(
        "mtime", F.lit("unknown")).withColumn("is_recent", F.lit(False))
    return _finish(shaped, "spring", flags, F.col("route"), ("http_method",)).withColumn("source", F.lit(source))


def spring_mappings_from_logs(lines: DataFrame) -> DataFrame:
    """Route to controller hints in application log lines."""
    groups = [F.regexp_extract_all("text", F.lit(_LOG_MAPPING), F.lit(g)) for g in (1, 2, 3)]
    zipped = F.arrays_zip(groups[0].alias("http_method"), groups[1].alias("route"), groups[2].alias("class_name"))
    rows = lines.select("source_file", F.explode(zipped).alias("m")).select("source_file", F.upper("m.http_method").alias("http_method"), "m.route", "m.class_name")
    return _mapping_rows(rows, "application_log", "log_mapping_hint")


def spring_mappings_from_code(files: DataFrame) -> DataFrame:
    """Mapping annotations with a literal route."""
    body = F.replace(F.col("text"), F.lit("\u0000"), F.lit(" "))
    zipped = F.arrays_zip(*[F.regexp_extract_all(body, F.lit(_LITERAL_MAPPING), F.lit(g)).alias(n) for g, n in ((1, "annotation"), (2, "route"))])
    kind = F.lower("m.annotation")
    method = F.when(kind == "requestmapping", "").otherwise(F.upper(F.regexp_replace(kind, "mapping$", "")))
    rows = files.select("source_file", F.explode(zipped).alias("m")).select("source_file", method.alias("http_method"), "m.route", F.lit("").alias("class_name"))
    return _mapping_rows(rows, "annotation")


def spring_config_flags(value: Column) -> Column:
    """Flags of a Spring configuration text."""
    lowered = F.lower(value)
    exposed = lowered.contains("management.endpoints.web.exposure.include=*") | lowered.contains("management:\n") | lowered.contains("heapdump") | lowered.contains("env:")
    unusual = lowered.contains("spring.main.allow-circular-references=true") | lowered.contains("spring.mvc.hiddenmethod.filter.enabled=true")
    return sorted_join([F.when(exposed, F.lit("management_endpoint_exposure")), F.when(unusual, F.lit("unusual_runtime_config"))])
