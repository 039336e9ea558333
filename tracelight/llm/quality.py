"""Quality rules: base counts, and the divergence of a document's histograms from language references.

Method. Two histograms are taken of each document: of its word characters over six classes, and of its words over a
list of common words (and the rest). The references are the same histograms over all documents of a language that pass
the base rules, for the languages of COMMON_WORDS. A document diverges if the Jensen-Shannon distance (base 2, so 0 to
1) of a histogram to the nearest reference exceeds a bound. A histogram shorter than its guard is not judged, and since
a small sample strays from its source, the bound widens for short texts: its square is the limit's square plus a noise
term by the number of words. Everything is DataFrame functions: one pass for the histograms, written narrow; the
references are four rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import WORD_BREAKS, carried, written

# Common function words of four languages. Fixed values.
COMMON_WORDS = {
    "en": "the of and to in is that it with for".split(),
    "de": "der die und das ist von mit den ein zu".split(),
    "fr": "le la les de et des est en un que".split(),
    "es": "el los y las por con una del no es".split(),
}
# Signs that count as symbols. Fixed value.
SYMBOLS = "[#*$%&|<>]"

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 200, 50
# (limit, noise) of the bounds sqrt(limit^2 + noise / words)
CHAR_BOUND, WORD_BOUND = (0.2, 2.5), (0.2, 3.4)

CLASSES = ["upper", "lower", "digit", "symbol", "non_ascii", "mark"]


def _only(text: Column, signs: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{signs}]+", "")).cast("long")


def _repeat_places(hashes: Column) -> Column:
    """Places of the three-word windows found twice or more. ``hashes`` has each window's hash and place, sorted by hash."""
    again = F.filter(hashes, lambda x, k: (x["h"] == F.get(hashes, k + 1)["h"]) | (x["h"] == F.get(hashes, k - 1)["h"]))
    return F.sort_array(F.transform(again, lambda x: x["i"]))


def measured(docs: DataFrame, id_col: str, text: str, lang: str, carry: list[str]) -> DataFrame:
    """Base counts and the two histograms of every document."""
    c = F.col
    common = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    spelled = common + [w.capitalize() for w in common]
    df = docs.select(c(id_col).cast("long").alias("doc_id"), F.coalesce(c(text), F.lit("")).alias("t"), c(lang).cast("string").alias("lang"),
                     *[c(x).alias(f"_c{i}") for i, x in enumerate(carry)])
    df = df.withColumn("w", F.array_remove(F.split("t", WORD_BREAKS), ""))
    df = df.withColumn("n", F.size("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # one pass over the whole text leaves few characters for the others
    df = df.withColumn("lines", lines).withColumn("rest", F.regexp_replace("t", "[a-z\\x20\\x09-\\x0D]+", ""))
    windows = F.when(c("n") >= 3, F.transform(F.sequence(F.lit(0), c("n") - 3), lambda i: F.struct(
        F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))))
    df = df.withColumn("win", F.sort_array(F.coalesce(windows, F.expr("cast(array() as array<struct<h:bigint,i:int>>)"))))
    df = df.withColumn("again", _repeat_places(c("win")))
    covered = F.aggregate(F.transform("again", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("again", k + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    hits = F.transform(F.filter("w", lambda x: x.isin(spelled)), F.lower)
    df = df.withColumn("hits", hits)
    carried_columns = [f"_c{i}" for i in range(len(carry))]
    df = df.select(
        "doc_id", "lang", *carried_columns, c("n").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _only(c("rest"), SYMBOLS[1:-1]).alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        _only(c("rest"), "A-Z").alias("upper"), _only(c("rest"), "0-9").alias("digit"), F.length("rest").cast("long").alias("others"),
        F.length(F.regexp_replace("rest", "[\\x00-\\x7F]+", "")).cast("long").alias("non_ascii"),
        F.transform(F.array(*map(F.lit, common)), lambda x: F.size(F.filter("hits", lambda h: h == x)).cast("long")).alias("common"), F.size("hits").alias("n_common"),
    )
    mark = c("others") - c("upper") - c("digit") - c("n_symbols") - c("non_ascii")
    count = {"lower": c("word_chars") - c("others"), "symbol": c("n_symbols"), "mark": mark}
    df = df.withColumn("chars", F.array(*[count.get(k, c(k)) for k in CLASSES]))
    df = df.withColumn("common", F.concat("common", F.array((c("n_words") - c("n_common")).cast("long"))))
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEATED_PERCENT * c("n_words"))
    return df.select("doc_id", "lang", *carried_columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "chars", "common")


def references(measures: DataFrame) -> DataFrame:
    """``lang, ref_chars, ref_common``: summed histograms of the documents that pass the base rules, one row per language."""
    sums = lambda name, n: [F.sum(F.get(name, F.lit(i))).alias(f"{name}{i}") for i in range(n)]
    n_common = len({w for ws in COMMON_WORDS.values() for w in ws}) + 1
    good = measures.where(~F.col("base_failed") & F.col("lang").isin(list(COMMON_WORDS)))
    out = good.groupBy("lang").agg(*sums("chars", len(CLASSES)), *sums("common", n_common))
    return out.select("lang", F.array(*[f"chars{i}" for i in range(len(CLASSES))]).alias("ref_chars"), F.array(*[f"common{i}" for i in range(n_common)]).alias("ref_common"))


def total(counts: Column) -> Column:
    """Sum of a count array; null instead of zero."""
    return F.nullif(F.aggregate(counts, F.lit(0).cast("double"), lambda a, v: a + v), F.lit(0.0))


def js_distance(p: Column, p_total: Column, q: Column, q_total: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of one length, given their sums; null if a sum is null.

    The sums are arguments because inside a lambda they would be added up anew for every element.
    """
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a / p_total, (a / p_total + b / q_total) / 2) + part(b / q_total, (a / p_total + b / q_total) / 2))
    far = F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) / 2, F.lit(0.0)))
    return F.when(p_total.isNotNull() & q_total.isNotNull(), far)


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id``, carried columns, the base counts, ``base_failed, char_distance, word_distance, kept``.

    A null text counts as empty and fails the base rules (too few words). A null language, one that is not in
    COMMON_WORDS, or one without a document that passes the base rules has no reference: such documents are judged by
    the base rules alone. Repeated rows are
    judged each by itself. A carried column named like a result is dropped. Windows are compared by 64-bit hashes.
    """
    results = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")
    extra = carried(docs, carry, results)
    measures = written(measured(docs, id_col, text, lang, extra))
    refs = references(measures).collect()  # one row per language of COMMON_WORDS at most
    c = F.col

    def distance(own: str, ref: str, guard: Column) -> Column:
        far = [js_distance(c(own), c(f"{own}_total"), F.lit(r[ref]), F.lit(float(sum(r[ref])) or None)) for r in refs]
        nearest = F.lit(None).cast("double") if not far else far[0] if len(far) == 1 else F.least(*far)
        return F.when(c("lang").isin([r["lang"] for r in refs]) & guard, nearest)

    above = lambda name, bound: F.coalesce(c(name) > F.sqrt(F.lit(bound[0] ** 2) + F.lit(bound[1]) / F.greatest(c("n_words"), F.lit(1))), F.lit(False))
    both = measures.withColumn("chars_total", total(c("chars"))).withColumn("common_total", total(c("common")))
    both = both.withColumn("char_distance", distance("chars", "ref_chars", c("word_chars") >= MIN_CHARS_JUDGED)) \
        .withColumn("word_distance", distance("common", "ref_common", c("n_words") >= MIN_WORDS_JUDGED))
    diverges = above("char_distance", CHAR_BOUND) | above("word_distance", WORD_BOUND)
    return both.select("doc_id", *[c(f"_c{i}").alias(x) for i, x in enumerate(extra)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "char_distance", "word_distance", (~c("base_failed") & ~diverges).alias("kept"))
