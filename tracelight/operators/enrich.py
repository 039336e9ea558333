"""Client inference behind proxies, indicator matching and network lookup.

Matching is by equality: an address is looked up under the hex prefixes the networks use, a host under
its suffixes, a path under its prefixes and a user agent under short substrings. Distinct values are
matched first and then joined back, so repeated traffic costs one match. Where only the first network
counts, networks are made disjoint first, and an address is one row of an ordered lookup.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions import assess
from tracelight.functions.frames import settled
from tracelight.functions.net import V4_PREFIX, Network, cidr_range, in_networks, ip_key, is_v4_key, key_text
from tracelight.functions.text import domain_host, sha256_hex
from tracelight.functions.values import let, text
from tracelight.operators.findings import base_finding
from tracelight.operators.splits import carry_in_splits
from tracelight.operators.ordered import numbered_ids
from tracelight.operators.records import effective_ip
from tracelight.schema import FINDING, conform
from tracelight.session import cut_lineage

_UA_GRAM = 4


def parse_networks(values: Iterable[str]) -> tuple[list[Network], list[str]]:
    """Readable networks and the entries that are not."""
    good, bad = [], []
    for value in values:
        try:
            good.append(Network.parse(value))
        except ValueError as error:
            bad.append(f"{value}: {error}")
    return good, bad


def client_from_header(header: Column, trusted: list[Network]) -> Column:
    """Key of the first address in a forwarding header that is not a trusted proxy."""

    def first_untrusted(tokens: Column) -> Column:
        keys = F.array_compact(F.transform(tokens, ip_key))
        return F.get(F.filter(keys, lambda k: ~in_networks(k, trusted)), F.lit(0))

    attributes = F.filter(F.split(header, "[,;]"), lambda a: a.rlike(r"(?i)^\s*for\s*="))
    forwarded = F.transform(attributes, lambda a: F.btrim(F.trim(F.regexp_replace(a, r"^[^=]*=", "")), F.lit('"')))
    return F.coalesce(first_untrusted(forwarded), first_untrusted(F.split(header, ",")))


def infer_clients(events: DataFrame, trusted_proxies: Iterable[str]) -> DataFrame:
    """Fills ``inferred_client_ip``, ``proxy_ip`` and ``client_ip_source`` where a trusted proxy forwarded a request."""
    trusted, _ = parse_networks(trusted_proxies)
    if not trusted:
        return events
    keyed = events.withColumn("_peer", ip_key(F.col("remote_ip")))
    from_proxy = F.coalesce(in_networks(F.col("_peer"), trusted), F.lit(False)) & F.col("xff_ip").isNotNull()
    keyed = keyed.withColumn("_client", F.when(from_proxy, client_from_header(F.col("xff_ip"), trusted)))
    inferred = F.coalesce(F.col("_client") != F.col("_peer"), F.lit(False))
    keyed = keyed.withColumn("_inferred", inferred)
    pick = lambda value, name: F.when(F.col("_inferred"), value).otherwise(F.col(name)).alias(name)
    replaced = {
        "inferred_client_ip": pick(key_text(F.col("_client")), "inferred_client_ip"), "proxy_ip": pick(F.col("remote_ip"), "proxy_ip"),
        "client_ip_source": pick(F.lit("trusted_proxy_header"), "client_ip_source"),
    }
    return keyed.select(*[replaced.get(c, F.col(c)) for c in events.columns])


def with_ranges(networks: DataFrame, column: str = "network") -> DataFrame:
    """Adds ``low, high, v4`` and the shared hex prefix ``_key`` of a network table; unreadable rows are dropped."""
    ranged = settled(networks.withColumn("_r", cidr_range(F.col(column)))).where(F.col("_r").isNotNull()).select("*", "_r.*").drop("_r")
    # digits shared by both ends: every address of the network starts with them
    shared = F.aggregate(
        F.sequence(F.lit(1), F.lit(32)), F.lit(0),
        lambda n, i: F.when((n == i - 1) & (F.substring("low", F.lit(1), i) == F.substring("high", F.lit(1), i)), i).otherwise(n),
    )
    return settled(ranged.withColumn("_digits", shared)).withColumn("_key", F.substring("low", F.lit(1), F.col("_digits")))


def _networks_of(keys: DataFrame, ranged: DataFrame) -> DataFrame:
    """``keys(_ip_key)`` met with the networks containing them."""
    digits = sorted(row[0] for row in ranged.select("_digits").distinct().collect())  # at most 33 values
    if not digits:
        digits = [32]
    probes = keys.select("_ip_key").withColumn("_digits", F.explode(F.array(*[F.lit(d) for d in digits]))).withColumn(
        "_key", F.substring("_ip_key", F.lit(1), F.col("_digits"))
    )
    inside = F.col("_ip_key").between(F.col("low"), F.col("high")) & (F.col("v4") | ~is_v4_key(F.col("_ip_key")))
    return probes.join(ranged, ["_digits", "_key"]).where(inside).drop("_digits", "_key", "low", "high", "v4")


def key_after(key: Column) -> Column:
    """The next address key; NULL behind the last one."""
    body = F.rtrim(key, F.lit("f"))
    last = F.conv(F.right(body, F.lit(1)), 16, 10).cast("int") + 1
    raised = F.concat(F.left(body, F.length(body) - 1), F.lower(F.hex(last.cast("long"))))
    return F.when(body != "", F.rpad(raised, 32, "0"))


def flattened(networks: DataFrame, order: str = "file_order") -> DataFrame:
    """Overlapping networks as disjoint stretches: ``low, owner``, a stretch reaching up to the next ``low``.

    A sweep over the borders of all networks: what holds at a border holds up to the next one. ``owner`` has the network
    and its columns, of those that cover a stretch the first in ``order``; NULL where none does. Only borders are looked up
    under the prefixes, not addresses.
    """
    ranged = with_ranges(networks)
    # networks of the wider family do not hold mapped IPv4 addresses, so that block has borders of its own
    rest = 32 - len(V4_PREFIX)
    fixed = F.array(F.lit(V4_PREFIX + "0" * rest), key_after(F.lit(V4_PREFIX + "f" * rest)))
    borders = ranged.select(F.explode(F.array_compact(F.concat(F.array(F.col("low"), key_after(F.col("high"))), fixed))).alias("_ip_key")).distinct()
    payload = [c for c in networks.columns if c not in ("network", order)]
    met = _networks_of(borders, ranged).groupBy("_ip_key").agg(F.min_by(F.struct("network", *payload), F.col(order)).alias("owner"))
    return borders.join(met, "_ip_key", "left").withColumnRenamed("_ip_key", "low")


def first_network(addresses: DataFrame, column: str, networks: DataFrame, order: str = "file_order") -> DataFrame:
    """Distinct addresses with the columns of the first network, in file order, that contains them.

    Addresses and stretches are sorted together, and each address takes what the last border before it carries: one row
    for an address, however many networks there are.
    """
    keys = settled(addresses.select(column).distinct().withColumn("_ip_key", ip_key(F.col(column)))).where(F.col("_ip_key").isNotNull())
    stretches = flattened(networks, order)
    kind = stretches.schema["owner"].dataType
    marks = stretches.select(F.col("low").alias("_ip_key"), F.lit(0).alias("_side"), F.struct("owner").alias("_mark"))
    asked = keys.select("_ip_key").distinct().select("_ip_key", F.lit(1).alias("_side"), F.lit(None).cast(marks.schema["_mark"].dataType).alias("_mark"))
    order_by = ["_ip_key", "_side"]
    laid = cut_lineage(marks.unionByName(asked).repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("line_number", F.monotonically_increasing_id()))
    split = F.shiftright("line_number", 33)
    found = carry_in_splits(laid.withColumn("source_file", F.lit("")).withColumn("_split", split).withColumnRenamed("_mark", "_own"), {"_mark": F.col("_own")})
    best = found.where("_side = 1").select("_ip_key", F.col("_mark.owner").cast(kind).alias("_n")).where(F.col("_n").isNotNull()).select("_ip_key", "_n.*")
    return keys.join(best, "_ip_key").drop("_ip_key")


def host_suffixes(host: Column) -> Column:
    """A host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def path_prefixes(path: Column) -> Column:
    """A path and all its prefixes that end before or at a slash."""
    parts = F.split(path, "/")
    upto = lambda i: F.array_join(F.slice(parts, 1, i), "/")
    cuts = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    before, at = F.transform(cuts, upto), F.transform(cuts, lambda i: F.concat(upto(i), F.lit("/")))
    return F.array_distinct(F.filter(F.concat(F.array(path), before, at), lambda p: p != ""))


def _grams(value: Column, size: int) -> Column:
    last = F.length(value) - (size - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(value, i, F.lit(size))))).otherwise(
        F.array().cast("array<string>")
    )


def short_pieces(value: Column) -> Column:
    """Distinct substrings of one to four characters."""
    return F.array_distinct(F.concat(*[_grams(value, size) for size in range(1, _UA_GRAM + 1)]))


def match_values(candidates: DataFrame, indicators: DataFrame) -> DataFrame:
    """``candidates(field, value)`` met with ``indicators(seq, indicator_type, value)``: ``field, value, seq``."""
    distinct = candidates.select("field", "value").where(F.col("value").isNotNull()).distinct()
    kind = lambda name: indicators.where(F.col("indicator_type") == name)
    of = lambda *fields: distinct.where(F.col("field").isin(*fields))
    addresses = settled(of("remote_ip", "db_client_ip").withColumn("_ip_key", ip_key(F.col("value")))).where(F.col("_ip_key").isNotNull())

    by_ip = addresses.join(settled(kind("ip").select("seq", ip_key(F.col("value")).alias("_ip_key"))), "_ip_key")
    ranged = with_ranges(kind("cidr").select("seq", F.col("value").alias("network")))
    by_cidr = addresses.join(_networks_of(addresses.select("_ip_key").distinct(), ranged), "_ip_key")
    domain = lambda c: F.lower(F.rtrim(F.trim(c), F.lit(".")))
    by_domain = of("host").withColumn("_k", F.explode(host_suffixes(domain_host(F.col("value"))))).join(
        kind("domain").select("seq", domain(F.col("value")).alias("_k")), "_k")
    by_path = of("uri_path").withColumn("_k", F.explode(path_prefixes(F.lower("value")))).join(
        kind("url_path").select("seq", F.lower("value").alias("_k")), "_k")
    by_hash = of("file_sha256").withColumn("_k", F.lower("value")).join(kind("hash").select("seq", F.lower("value").alias("_k")), "_k")
    agents = kind("user_agent").select("seq", F.lower("value").alias("_needle")).where(F.col("_needle") != "").withColumn(
        "_g", F.least(F.length("_needle"), F.lit(_UA_GRAM))
    ).withColumn("_k", F.expr("substring(_needle, 1, _g)"))
    haystack = of("user_agent").withColumn("_low", F.lower("value"))
    by_agent = haystack.withColumn("_k", F.explode(short_pieces(F.col("_low")))).join(agents, "_k").where(F.col("_low").contains(F.col("_needle")))
    found = [by_ip, by_cidr, by_domain, by_path, by_hash, by_agent]
    return reduce(DataFrame.unionByName, [f.select("field", "value", "seq") for f in found]).distinct()


def score_delta(confidence: Column) -> Column:
    lowered = F.lower(F.trim(confidence))
    return F.when(lowered.isin("high", "strong"), 15).when(lowered.isin("low", "weak"), 5).otherwise(10)


def ioc_candidates(http: DataFrame | None = None, db: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Every (field, value) of the evidence that can match, with the evidence it came from."""
    null = lambda kind: F.lit(None).cast(kind)
    parts: list[DataFrame] = []
    if http is not None:
        ip = effective_ip(F.col("remote_ip"), F.col("inferred_client_ip"))
        cells = [("remote_ip", ip), ("host", F.col("host")), ("uri_path", F.col("uri_path")), ("user_agent", F.col("user_agent"))]
        pairs = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value"), F.lit(i).alias("field_rank")) for i, (n, v) in enumerate(cells)])
        parts.append(http.select(
            F.lit(0).alias("rank"), "timestamp", F.col("source_file").alias("evidence_source"), F.col("line_number").alias("evidence_line"),
            ip.alias("remote_ip"), "uri_path", F.explode(pairs).alias("c")).select("*", "c.*").drop("c"))
    if db is not None:
        parts.append(db.select(
            F.lit(1).alias("rank"), "timestamp", F.col("source_file").alias("evidence_source"), F.col("line_number").alias("evidence_line"),
            F.col("client_ip").alias("remote_ip"), null("string").alias("uri_path"), F.lit("db_client_ip").alias("field"),
            F.col("client_ip").alias("value"), F.lit(0).alias("field_rank")))
    if files is not None:
        parts.append(files.select(
            F.lit(2).alias("rank"), F.col("modified_at").alias("timestamp"), F.col("path").alias("evidence_source"), null("bigint").alias("evidence_line"),
            null("string").alias("remote_ip"), null("string").alias("uri_path"), F.lit("file_sha256").alias("field"),
            F.col("sha256").alias("value"), F.lit(0).alias("field_rank")))
    return reduce(DataFrame.unionByName, parts).where(text(F.col("value")) != "")


def ioc_matches(candidates: DataFrame, indicators: DataFrame) -> DataFrame:
    """One row per (evidence field, indicator) with the indicator's description and score delta."""
    met = match_values(candidates, indicators)
    described = met.join(indicators.withColumnRenamed("value", "indicator_value"), "seq")
    joined = candidates.join(described, ["field", "value"])
    return joined.select(
        "rank", "field_rank", "seq", text(F.col("timestamp")).alias("timestamp"), "indicator_type", "indicator_value",
        F.col("field").alias("matched_field"), F.col("value").alias("matched_value"), "source", "confidence", "tags", "description",
        "evidence_source", "evidence_line", "remote_ip", "uri_path", score_delta(F.col("confidence")).alias("score_delta"),
    )


def ioc_findings(matches: DataFrame) -> DataFrame:
    """Findings of indicator hits: 20 points plus the confidence delta, at most 40."""
    c = F.col
    numbered = numbered_ids(matches, ["rank", "evidence_source", "evidence_line", "field_rank", "seq"], "IOC", "match_id")
    score = F.least(F.lit(20) + c("score_delta"), F.lit(40))
    summary = F.concat(
        F.lit("Indicator "), c("indicator_value"), F.lit(" matched "), c("matched_field"),
        F.lit(". A hit only adds weight to other evidence."),
    )
    findings = numbered.select(*base_finding(
        score, "ioc_match", "IOC-MATCH-LOCAL", "Hit of an indicator list", "ioc", "Q4",
        "Q4 environment context from a local IOC file; auxiliary evidence only", "base_rule_score", summary,
        "Check the indicator's origin and confidence and the neighbouring evidence.", finding_id=c("match_id"),
        timestamp=F.when(c("timestamp") != "", c("timestamp")), source_file=c("evidence_source"), line_number=c("evidence_line"),
        remote_ip=c("remote_ip"), uri_path=c("uri_path"),
        score_breakdown=assess.breakdown(base_rule_score=20, enrichment_score=c("score_delta")),
        raw_hash=sha256_hex(F.concat_ws("|", "indicator_type", "indicator_value", "matched_field", "matched_value")),
    ))
    return conform(findings, FINDING)


def canonical_address(value: Column) -> Column:
    return let(ip_key(value), lambda k: F.when(k.isNotNull(), key_text(k)))
