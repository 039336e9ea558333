"""URL rules by Bloom filter cascades.

Method. A list of keys is encoded exactly with respect to the complete key universe of the corpus, that is every key
that any URL can ask for. Level 1 is a Bloom filter of the listed keys; level 2 one of the other keys that pass level 1;
level 3 one of the listed keys that pass level 2; and so on until a level lets nothing wrong pass. A key is listed if it
passes an odd number of levels before the first that rejects it, or all of them when their number is odd. Asking is an
expression over literal arrays of longs: no join, and no Python.

A URL asks for the suffixes of its host at label borders, joined with prefixes of its path, of the lengths that occur in
the lists. There is one cascade each for blocking rules, allowing rules and blocked hosts. The filters grow with the
lists (a bounded setting of the job) and with the logarithm of the universe, not with the number of URLs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import carried, written

# Rules of the query: (host and path prefix, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Hosts that are blocked, with all subdomains, where no rule fits.
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in ("casino-win", "cheap-pills", "free-bets") for top in ("com", "net", "org"))
MAX_FILTER_BITS = 1 << 26
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]  # 64 bits each
    bits: int
    hashes: int
    salt: int

    def _place(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.salt * 64 + i)), F.lit(self.bits))

    def passes(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        test = None
        for i in range(self.hashes):
            place = self._place(key, i)
            bit = F.getbit(F.get(words, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1
            test = bit if test is None else test & bit
        return test


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        listed: Column | None = None
        for level in reversed(self.levels):
            listed = level.passes(key) if listed is None else level.passes(key) & ~listed
        return F.lit(False) if listed is None else listed


def _level(keys: DataFrame, n: int, rate: float, salt: int, max_bits: int) -> Level:
    hashes = max(1, round(math.log2(1 / rate)))
    bits = 64 * max(1, math.ceil(n * math.log2(1 / rate) / math.log(2) / 64))
    if bits > max_bits:
        raise ValueError(f"a filter of {bits} bits for {n} listed keys is above max_filter_bits={max_bits}")
    empty = Level((), bits, hashes, salt)
    places = keys.select(F.explode(F.array(*[empty._place(F.col("key"), i) for i in range(hashes)])).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("v"))
    held = [0] * (bits // 64)
    for row in words.collect():  # at most bits / 64 rows, a size checked above
        held[row["w"]] = row["v"]
    return Level(tuple(held), bits, hashes, salt)


def build_cascade(universe: DataFrame, listed: str, max_filter_bits: int = MAX_FILTER_BITS, max_levels: int = 64) -> Cascade:
    """Cascade of the keys for which the boolean column ``listed`` holds. ``universe(key, ...)`` has each key once."""
    levels: list[Level] = []
    alive = universe.select("key", F.col(listed).alias("listed"))
    n_in, n_out = alive.agg(F.coalesce(F.sum(F.col("listed").cast("long")), F.lit(0)), F.coalesce(F.sum((~F.col("listed")).cast("long")), F.lit(0))).first()
    side = True
    while n_in:
        rate = 0.5 if levels or not n_out else min(0.5, math.sqrt(0.5) * n_in / n_out)
        level = _level(alive.where(F.col("listed") == side), n_in, rate, len(levels), max_filter_bits)
        levels.append(level)
        if len(levels) > max_levels:
            raise RuntimeError("the cascade does not end")
        # the encoded side passes as a whole; of the other side only false positives go on
        alive = alive.where((F.col("listed") == side) | level.passes(F.col("key")))
        n_in, side = alive.where(F.col("listed") != side).count(), not side
    return Cascade(tuple(levels))


def host_and_path(url: str) -> tuple[Column, Column]:
    """Lower-cased (A-Z) host and path of a URL; both empty for null or without ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(text, "://([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1)


def _asked(labels: list[int], lengths: list[int]) -> Column:
    """All keys that a URL asks for: ``host`` suffixes of these label counts with ``path`` prefixes of these lengths."""
    parts = F.split("host", "\\.")
    keys = []
    for n in labels:
        suffix = F.array_join(F.slice(parts, -n, n), ".")
        for length in lengths:
            keys.append(F.when((F.size(parts) >= n) & (F.length("path") >= length), F.concat(suffix, F.substring("path", 1, length))))
    return F.array_compact(F.array(*keys))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, blocked_hosts: tuple[str, ...] = BLOCKED_HOSTS,
               max_filter_bits: int = MAX_FILTER_BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: ``page_id``, carried columns, ``host, path, rule, verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest fitting rule decides
    (of equally long ones the smaller). Where none fits, ``rule`` is null, and the URL is blocked if its host or a parent
    of it is listed. Null URLs and those without ``://`` have an empty host and path and are allowed. Equal URLs get
    equal rows. A carried column named like a result is dropped. No rules and no hosts allow everything.
    """
    for rule, verdict in rules:
        if "/" not in rule or verdict not in ("block", "allow"):
            raise ValueError(f"rule {rule!r}: host/path and block or allow are expected")
    extra = carried(pages, carry, ("page_id", "host", "path", "rule", "verdict"))
    host, path = host_and_path(url)
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(extra)], host.alias("host"), path.alias("path"))
    lists = {"block": [r for r, v in rules if v == "block"], "allow": [r for r, v in rules if v == "allow"], "hosts": list(blocked_hosts)}
    every = sorted({k for keys in lists.values() for k in keys})
    out = [F.col(f"_c{i}").alias(c) for i, c in enumerate(extra)]
    if not every:
        return df.select("page_id", *out, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    labels = sorted({k.split("/")[0].count(".") + 1 for k in every})
    lengths = sorted({len(k) - len(k.split("/")[0]) for k in every})
    asked = _asked(labels, lengths)
    listed = F.explode(F.split(F.lit("\n".join(every)), "\n"))
    keys = df.select("host", "path").distinct().select(F.explode(asked).alias("key")).unionByName(df.sparkSession.range(1).select(listed.alias("key"))).distinct()
    universe = written(keys.select("key", *[F.col("key").isin(lists[k]).alias(k) for k in lists]))
    found = {k: build_cascade(universe, k, max_filter_bits) for k in lists}
    longest = lambda kind: F.array_min(F.transform(F.filter("_keys", lambda k: found[kind].contains(k)), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    df = df.withColumn("_keys", asked).withColumn("_block", longest("block")).withColumn("_allow", longest("allow")) \
        .withColumn("_host", F.exists("_keys", lambda k: found["hosts"].contains(k)))
    blocks = F.col("_block").isNotNull() & (F.col("_allow").isNull() | (F.col("_block") < F.col("_allow")))
    rule = F.when(blocks, F.col("_block.k")).otherwise(F.col("_allow.k"))
    verdict = F.when(blocks, "block").when(F.col("_allow").isNotNull(), "allow").when(F.col("_host"), "block").otherwise("allow")
    return df.select("page_id", *out, "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def url_sql(rules=RULES, blocked_hosts=BLOCKED_HOSTS) -> str:
    """The same verdicts in SQL, with joins to value lists."""
    rule_rows = ", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}', '{v}')" for r, v in rules)
    host_rows = ", ".join(f"('{h}')" for h in blocked_hosts)
    return f"""
WITH u AS (SELECT page_id, row_number() OVER () AS n, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rhost, rpath, rule, verdict) AS (VALUES {rule_rows}), b(bhost) AS (VALUES {host_rows}),
fits AS (SELECT n, rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC, rule) AS k
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
bad AS (SELECT DISTINCT n FROM u JOIN b ON host = bhost OR ends_with(host, '.' || bhost))
SELECT page_id, host, path, f.rule AS rule, CASE WHEN f.verdict IS NOT NULL THEN f.verdict WHEN bad.n IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (n) LEFT JOIN bad USING (n)"""
