"""Secret scans by linking the parts of a credential.

Method. A base scan marks what is a secret by its form alone: assignments, access identifiers, long hex runs. A second scan
marks weak candidates, which are too common to report by themselves: identifiers (user names, account and key ids),
secrets (short assignments, mixed tokens) and endpoints (service URLs, IPv4 addresses). A weak candidate is reported only
where its complementary parts occur within ``reach`` code points of it in the same scope, a scope being a paragraph: an
identifier needs a secret, a secret needs an identifier, an endpoint needs both. Base spans count as parts too. The parts
of all texts meet in interval joins on (text, scope, stretch of ``reach`` code points).

Everything is DataFrame functions. Matches of a pattern are found in one pass each, as lengths of the matches and of what
lies between them; running sums over these rows give the places, so the work is linear in the number of matches. Texts do
not move: what is shuffled are a few numbers for each match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.llm.common import carried, written

REACH = 300
BLANKS = "\\x20\\x09-\\x0D"
_LINK = "[\"']?\\x20*[:=]\\x20*[\"']?"
_SECRET_NAMES = "(password|passwd|secret|token|api_?key)"

# Base kinds in their order: (kind, pattern, group whose length counts, least length). Leftmost matches that do not overlap.
BASE = (
    ("assign", f"(?i:{_SECRET_NAMES}){_LINK}([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),  # runs below 16 would be dropped; a run is one match either way
)
# Weak kinds, after the base kinds: several patterns each. Group MIXED counts a match only if it has a digit and letters of both cases.
MIXED = -1
WEAK = (
    ("id", f"(?i:(user(?:name)?|login|account|client_?id|access_?key_?id)){_LINK}([A-Za-z0-9_.@-]+)", 2, 3),
    ("id", "[A-Za-z0-9_.+-]{1,64}@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+){1,8}", 0, 6),
    ("secret", f"(?i:(password|passwd|passphrase|pass|pwd|secret|token|auth|credential|api_?key|private_?key)){_LINK}([^{BLANKS}\"']+)", 2, 6),
    ("secret", "[A-Za-z0-9+/]{24,}={0,2}", MIXED, 24),
    ("endpoint", f"(?:https?|ftps?|ssh|jdbc|postgres|mysql|mongodb|redis|amqp)://[^{BLANKS}\"'<>]+", 0, 10),
    ("endpoint", "[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?::[0-9]+)?", 0, 7),
)
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
# The part that a span of each kind can be.
PART = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "secret": "secret", "endpoint": "endpoint"}
SCOPE_BREAK = f"\\n[\\x20\\t\\r]*\\n[{BLANKS}]*"


def _lengths(text: Column, pattern: str, group: int) -> Column:
    """Array of ``(gap, length, counted)``: characters since the previous match, of the match, and of its group."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if group == MIXED:
        fits = lambda x: F.rlike(x, F.lit("[0-9]")) & F.rlike(x, F.lit("[A-Z]")) & F.rlike(x, F.lit("[a-z]"))
        both = F.transform(hits, lambda x: F.struct(F.length(x).alias("h"), F.when(fits(x), F.length(x)).otherwise(0).alias("c")))
    elif group:
        hits = F.transform(hits, lambda x: F.length(x))
        counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x))
        both = F.zip_with(hits, counted, lambda h, c: F.struct(h.alias("h"), c.alias("c")))
    else:
        both = F.transform(hits, lambda x: F.struct(F.length(x).alias("h"), F.length(x).alias("c")))
    rows = F.zip_with(gaps, both, lambda g, b: F.struct(g.alias("gap"), b["h"].alias("length"), b["c"].alias("counted")))
    # the piece behind the last match has no match of its own
    return F.filter(rows, lambda r: r["length"].isNotNull())


# What a text must hold to be searched for a pattern at all; a cheap test before two or three passes.
_GUARDS = {
    "AKIA[A-Z0-9]+": lambda t: F.contains(t, F.lit("AKIA")),
    WEAK[1][1]: lambda t: F.contains(t, F.lit("@")),
    WEAK[4][1]: lambda t: F.contains(t, F.lit("://")),
}


def _found(text: Column, no: int, pattern: str, group: int) -> Column:
    guard = _GUARDS.get(pattern, lambda t: F.rlike(t, F.lit(pattern)))(text)
    return F.when(guard, F.struct(F.lit(no).alias("no"), _lengths(text, pattern, group).alias("m")))


def _places(found: DataFrame) -> DataFrame:
    """``row, no, start, end, counted`` of matches given as lengths in order: running sums, streamed along each text and pattern."""
    each = found.select("row", F.explode("found").alias("f")).select("row", "f.no", F.posexplode("f.m").alias("pos", "m"))
    along = Window.partitionBy("row", "no").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum((F.col("m.gap") + F.col("m.length")).cast("long")).over(along))
    return each.select("row", "no", (F.col("end") - F.col("m.length")).alias("start"), "end", F.col("m.counted").alias("counted"))


def _binned(parts: DataFrame, low: Column, high: Column, reach: int) -> DataFrame:
    """One row for each stretch of ``reach`` that an interval touches."""
    return parts.withColumn("bin", F.explode(F.sequence(F.floor(low / reach), F.floor(high / reach))))


def _near(weak: DataFrame, parts: DataFrame, kind: str, reach: int) -> DataFrame:
    """The weak candidates with a part of ``kind`` in their scope at most ``reach`` code points before or behind them.

    A semi-join: no pairs are listed, and a text with many parts lies over many stretches.
    """
    asked = _binned(weak.select("row", "scope", "start", "end"), F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach, reach).alias("w")
    there = _binned(parts.where(F.col("part") == kind).select("row", "scope", "start", "end"), F.col("start"), F.col("end"), reach).alias("p")
    same = (F.col("w.row") == F.col("p.row")) & (F.col("w.scope") == F.col("p.scope")) & (F.col("w.bin") == F.col("p.bin"))
    close = (F.col("p.start") <= F.col("w.end") + reach) & (F.col("p.end") >= F.col("w.start") - reach)
    hit = asked.join(there, same & close, "left_semi").select("row", "start", "end").distinct()
    return weak.join(hit, ["row", "start", "end"], "left_semi")


def _free(weak: DataFrame, base: DataFrame, reach: int) -> DataFrame:
    """The weak candidates that overlap no base span."""
    asked = _binned(weak, F.col("start"), F.col("end") - 1, reach).alias("w")
    there = _binned(base.select("row", "start", "end"), F.col("start"), F.col("end") - 1, reach).alias("b")
    over = (F.col("w.row") == F.col("b.row")) & (F.col("w.bin") == F.col("b.bin")) & (F.col("b.start") < F.col("w.end")) & (F.col("b.end") > F.col("w.start"))
    taken = asked.join(there, over, "left_semi").select("row", "no", "start").distinct()
    return weak.join(taken, ["row", "no", "start"], "left_anti")


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", reach: int = REACH, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id``, carried columns, ``n_assign, n_access, n_hex, base_sha256, spans``.

    Spans are ``kind:start:end`` in code points from 0, end exclusive, by start, then kind in the order of KINDS, joined by
    commas; ``base_sha256`` is that of the base spans. A null or empty text has none: an empty string and its digest. Rows
    are judged each by itself, so null and equal ids and equal texts do no harm. Of weak candidates of one kind with equal
    start and end one is reported; those that overlap a base span are not. A carried column named like a result is dropped.
    """
    extra = carried(docs, carry, ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"))
    c, patterns = F.col, [*BASE, *WEAK]
    df = docs.select(c(id_col).cast("long").alias("doc_id"), F.coalesce(c(text), F.lit("")).alias("t"), *[c(x).alias(f"_c{i}") for i, x in enumerate(extra)])
    found = F.array_compact(F.array(*[_found(c("t"), no, p, group) for no, (_, p, group, _) in enumerate(patterns)]))
    df = df.withColumn("found", found)
    # paragraph borders are of use only where a weak candidate is
    weak_there = F.exists("found", lambda f: f["no"] >= len(BASE))
    df = df.withColumn("breaks", F.when(weak_there, _found(c("t"), len(patterns), SCOPE_BREAK, 0)))
    scanned = written(df.select("doc_id", *[f"_c{i}" for i in range(len(extra))], "found", "breaks", F.monotonically_increasing_id().alias("row")))

    of = lambda make: F.element_at(F.array(*[F.lit(make(p)) for p in patterns]), c("no") + 1)
    places = _places(scanned.where(F.size("found") > 0).select("row", "found"))
    spans = written(places.withColumn("kind", of(lambda p: p[0])).where(c("counted") >= of(lambda p: p[3])).select("row", "no", "start", "end", "kind"))
    base, weak = spans.where(c("no") < len(BASE)), spans.where(c("no") >= len(BASE))

    borders = _places(scanned.where(c("breaks").isNotNull()).select("row", F.array("breaks").alias("found"))).select("row", c("start"), F.lit(1).alias("border"))
    candidates = _free(weak, base, reach).select("row", "start", "end", "kind").distinct()
    # only texts with a weak candidate go on; a scope is the number of borders before a part
    parts = candidates.unionByName(base.select("row", "start", "end", "kind").join(candidates.select("row").distinct(), "row", "left_semi"))
    before = Window.partitionBy("row").orderBy("start", c("border").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = parts.withColumn("border", F.lit(0)).unionByName(borders.select("row", "start", c("start").alias("end"), F.lit(None).cast("string").alias("kind"), "border"))
    laid = laid.withColumn("scope", F.sum("border").over(before)).where(c("border") == 0)
    kind_part = F.create_map(*[F.lit(x) for pair in PART.items() for x in pair])
    laid = written(laid.select("row", "scope", "start", "end", "kind", kind_part[c("kind")].alias("part")))
    open_ = laid.where(c("kind").isin("id", "secret", "endpoint"))
    linked = _near(open_.where("part = 'id'"), laid, "secret", reach).unionByName(_near(open_.where("part = 'secret'"), laid, "id", reach)).unionByName(
        _near(_near(open_.where("part = 'endpoint'"), laid, "id", reach), laid, "secret", reach))

    place = F.array_position(F.array(*map(F.lit, KINDS)), c("kind"))
    all_spans = base.select("row", "start", "end", "kind").unionByName(linked.select("row", "start", "end", "kind"))
    # a text's spans are no more than its characters; texts without any have no row here
    lists = all_spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", place.cast("int").alias("k"), "end"))).alias("s"))
    out = scanned.select("row", "doc_id", *[f"_c{i}" for i in range(len(extra))]).join(lists, "row", "left")
    s = F.coalesce(c("s"), F.expr("cast(array() as array<struct<start:bigint,k:int,end:bigint>>)"))
    out = out.withColumn("s", s).withColumn("b", F.filter("s", lambda x: x["k"] <= len(BASE)))
    spelled = lambda name: F.array_join(F.transform(name, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("b", lambda x: x["k"] == k)).cast("long")
    return out.select("doc_id", *[c(f"_c{i}").alias(x) for i, x in enumerate(extra)], count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"),
                      F.sha2(spelled("b"), 256).alias("base_sha256"), spelled("s").alias("spans"))


def secrets_sql(reach: int = REACH) -> str:
    """The query in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    patterns = [*BASE, *WEAK, ("scope", SCOPE_BREAK, 0, 0)]

    def matches(no: int, pattern: str, group: int, least: int) -> str:
        p = quoted(pattern)
        counted = "length(hit)" if group <= 0 else "length(val)"
        if group == MIXED:
            counted = "CASE WHEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') THEN length(hit) ELSE 0 END"
        return f"""SELECT r, {no} AS no, e - length(hit) AS s, e FROM (
            SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e FROM (
                SELECT r, unnest(string_split_regex(t, {p})) AS gap, unnest(regexp_extract_all(t, {p}, 0)) AS hit, unnest(regexp_extract_all(t, {p}, {max(group, 0)})) AS val,
                       unnest(range(len(regexp_extract_all(t, {p}, 0)) + 1)) AS pos FROM d) WHERE hit IS NOT NULL)
            WHERE {counted} >= {least}"""

    kind = "CASE no " + " ".join(f"WHEN {no} THEN {KINDS.index(k) + 1}" for no, (k, *_) in enumerate(patterns[:-1])) + " END"
    near = lambda part: f"""EXISTS (SELECT 1 FROM laid p WHERE p.r = w.r AND p.scope = w.scope AND p.k IN {part} AND p.s <= w.e + {reach} AND p.e >= w.s - {reach})"""
    ids, hidden = (tuple(KINDS.index(k) + 1 for k, v in PART.items() if v == part) for part in ("id", "secret"))
    text = "CASE k " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS, 1)) + " END || ':' || s::BIGINT || ':' || e::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(matches(no, p, g, n) for no, (_, p, g, n) in enumerate(patterns))}),
found AS (SELECT r, {kind} AS k, s, e FROM m WHERE no < {len(patterns) - 1}),
base AS (SELECT * FROM found WHERE k <= {len(BASE)}),
weak AS (SELECT DISTINCT * FROM found w WHERE k > {len(BASE)} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.s < w.e AND b.e > w.s)),
laid AS (SELECT x.*, (SELECT count(*) FROM m WHERE m.no = {len(patterns) - 1} AND m.r = x.r AND m.s <= x.s) AS scope FROM (SELECT * FROM base UNION ALL SELECT * FROM weak) x),
linked AS (SELECT r, k, s, e FROM laid w WHERE k > {len(BASE)} AND CASE k WHEN 4 THEN {near(hidden)} WHEN 5 THEN {near(ids)} ELSE {near(ids)} AND {near(hidden)} END),
spelled AS (SELECT r, k, s, {text} AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM linked)),
listed AS (SELECT r, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex,
    coalesce(string_agg(x, ',' ORDER BY s, k) FILTER (k <= {len(BASE)}), '') AS b, string_agg(x, ',' ORDER BY s, k) AS spans FROM spelled GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (r)"""
