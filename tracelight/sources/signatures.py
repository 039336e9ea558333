"""Signature files of plain literals, and a search for all their literals at once in content of any size.

Content comes in chunks that overlap by the longest literal, so a literal across a border is found, and each offset in
exactly one chunk. A task builds an Aho-Corasick automaton over all literals (one more over those that ignore case) and
passes each chunk through it once, however many rules there are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelight.operators.findings import base_finding

CHUNK = 4 << 20
_HELD = 1 << 16  # offsets that a task holds before they leave


@dataclass(frozen=True)
class LiteralRule:
    """A signature of plain literals; any of them is a match."""

    namespace: str
    name: str
    tags: tuple[str, ...]
    literals: tuple[tuple[str, bool], ...]  # (literal, ignore case)


# What may hold braces, slashes or key words without meaning them: text, comments, regular expressions, hex strings.
_OPAQUE = re.compile(r'(?P<text>"(?:[^"\\\n]|\\.)*")|//[^\n]*|/\*.*?(?:\*/|\Z)|(?<==)\s*/(?:[^/\\\n]|\\.)+/|(?<==)\s*\{[^{}"]*\}', re.S)
_RULE = re.compile(r"\brule\s+(\w+)\s*(?::([^{}]*))?\{([^{}]*)\}")
_PARTS = re.compile(r"\bstrings\s*:(.*?)(?=\bcondition\s*:|\Z)", re.S)
_TEXT = re.compile(r'\$\w*\s*=\s*("_*")([^\n$"]*)')


def parse_literal_rules(content: str, namespace: str) -> list[LiteralRule]:
    """The rules of a signature file, each with the text literals of its ``strings`` part.

    Conditions, hex strings and regular expressions are not interpreted; a rule without a literal is none. Structure is
    read from a copy in which text, comments and patterns are blanked, so nothing inside them is taken for structure.
    """
    blank = _OPAQUE.sub(lambda m: '"' + "_" * (len(m[0]) - 2) + '"' if m["text"] else re.sub(r"[^\n]", " ", m[0]), content)
    found: list[LiteralRule] = []
    for rule in _RULE.finditer(blank):
        part = _PARTS.search(rule[3])
        literals = []
        for match in _TEXT.finditer(part[1]) if part else ():
            at = rule.start(3) + part.start(1) + match.start(1)
            value = re.sub(r"(?s)\\(.)", r"\1", content[at + 1 : at + len(match[1]) - 1])
            if value:
                literals.append((value, "nocase" in match[2].lower().split()))
        if literals:
            found.append(LiteralRule(namespace, rule[1], tuple((rule[2] or "").split()), tuple(literals)))
    return found


def _ascii_lower(data: bytes) -> bytes:
    return data.lower()  # bytes.lower folds A-Z alone


@lru_cache(maxsize=8)
def _automata(literals: tuple[tuple[int, bytes, bool], ...]):
    """One automaton for exact literals, one for folded ones; each word holds the rules and the length."""
    import ahocorasick

    out = []
    for fold in (False, True):
        words: dict[bytes, set[int]] = {}
        for rule, value, folded in literals:
            if folded == fold:
                words.setdefault(_ascii_lower(value) if fold else value, set()).add(rule)
        if words:
            machine = ahocorasick.Automaton()
            for value, rules in words.items():
                machine.add_word(value.decode("latin-1"), (len(value), tuple(sorted(rules))))
            machine.make_automaton()
            out.append((fold, machine))
    return out


def chunked(files: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``path, offset, content`` chunks of files that a frame holds whole (``path, content``)."""
    last = F.floor(F.greatest(F.octet_length("content") - 1, F.lit(0)) / chunk).cast("int")
    pieces = files.where(F.octet_length("content") > 0).select("path", "content", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: i.cast("long") * chunk)).alias("offset"))
    return pieces.select("path", "offset", F.expr(f"substring(content, cast(offset as int) + 1, {chunk + overlap})").alias("content"))


def overlap_of(rules: Iterable[LiteralRule]) -> int:
    """How far chunks must overlap for these rules."""
    return max((len(v.encode()) - 1 for r in rules for v, _ in r.literals), default=0)


def chunk_hits(chunks: DataFrame, rules: Iterable[LiteralRule], chunk: int) -> DataFrame:
    """``path, rule_no, base, offsets``: the distinct offsets at which a literal of the rule starts, ascending, per chunk that has any."""
    literals = tuple((no, value.encode(), fold) for no, rule in enumerate(rules) for value, fold in rule.literals)

    def batch_of(rows: list[tuple[str, int, int, np.ndarray]]) -> pa.RecordBatch:
        paths, owners, bases, at = zip(*rows)
        ends = np.cumsum([0, *map(len, at)], dtype=np.int32)
        columns = [pa.array(paths, pa.string()), pa.array(owners, pa.int32()), pa.array(bases, pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(at))]
        return pa.RecordBatch.from_arrays(columns, names=["path", "rule_no", "base", "offsets"])

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(literals)
        for batch in parts:
            rows, held = [], 0
            for path, base, content in zip(*batch.columns):
                path, base, data = path.as_py(), base.as_py(), content.as_py()
                found: dict[int, array] = {}
                for fold, machine in automata:
                    for stop, (length, owners) in machine.iter((_ascii_lower(data) if fold else data).decode("latin-1")):
                        if stop + 1 - length < chunk:
                            for rule in owners:
                                found.setdefault(rule, array("q")).append(base + stop + 1 - length)
                rows += [(path, rule, base, np.unique(np.frombuffer(at, np.int64))) for rule, at in found.items()]
                held += sum(map(len, found.values())) + 32 * len(found)  # a row costs that beside its offsets
                if held >= _HELD:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return chunks.select("path", "offset", "content").mapInArrow(scan, "path string, rule_no int, base long, offsets array<long>")


def _named(df: DataFrame, rules: list[LiteralRule]) -> DataFrame:
    """Adds namespace, name and tags of ``rule_no``; the rule set is configuration."""
    table = df.sparkSession.createDataFrame([(no, r.namespace, r.name, ";".join(r.tags)) for no, r in enumerate(rules)],
                                            "rule_no int, rule_namespace string, rule_name string, rule_tags string")
    return df.join(F.broadcast(table), "rule_no").drop("rule_no")


def _hits(files: DataFrame, rules: list[LiteralRule], chunk: int) -> DataFrame:
    pieces = files if "offset" in files.columns else chunked(files, chunk, overlap_of(rules))
    return chunk_hits(pieces, rules, chunk)


def signature_matches(files: DataFrame, rules: Iterable[LiteralRule], shown: int = 8, chunk: int = CHUNK) -> DataFrame:
    """One row per (file, rule) with the number of offsets and the first ``shown``; ``signature_offsets`` has them all.

    ``files`` is ``path, content``, or ``path, offset, content`` in chunks of ``chunk`` bytes that overlap by ``overlap_of(rules)``.
    """
    rules = list(rules)
    # a file may be many chunks: only the first of them are listed, the others are counted
    order = W.partitionBy("path", "rule_no").orderBy("base")
    ranked = _hits(files, rules, chunk).select("path", "rule_no", "base", F.size("offsets").alias("_n"), F.slice("offsets", 1, shown).alias("_head")).withColumn("_rank", F.row_number().over(order))
    summed = ranked.groupBy("path", "rule_no").agg(
        F.sum("_n").alias("match_count"), F.array_sort(F.collect_list(F.when(F.col("_rank") <= shown, F.struct("base", "_head")))).alias("_heads"))
    first = F.slice(F.flatten(F.transform("_heads", lambda h: h["_head"])), 1, shown)
    text = F.array_join(F.transform(first, lambda o: F.concat(F.lit("0x"), F.lower(F.hex(o)))), ";")
    return _named(summed.select("path", "rule_no", "match_count", text.alias("matched_offsets_summary")), rules).select(
        "path", "rule_namespace", "rule_name", "rule_tags", "match_count", "matched_offsets_summary")


def signature_offsets(files: DataFrame, rules: Iterable[LiteralRule], chunk: int = CHUNK) -> DataFrame:
    """One row per (file, rule, offset) of all matches, each offset once."""
    rules = list(rules)
    return _named(_hits(files, rules, chunk).select("path", "rule_no", F.explode("offsets").alias("offset")), rules).select("path", "rule_namespace", "rule_name", "offset")


def signature_findings(matches: DataFrame, hashes: DataFrame) -> DataFrame:
    """Findings of signature hits; ``hashes(path, sha256, modified_at)`` identifies the files."""
    c = F.col
    joined = matches.join(hashes, "path", "left")
    summary = F.concat(F.lit("Literals of "), c("rule_name"), F.lit(" occur "), c("match_count").cast("string"), F.lit(" time(s) in "), c("path"),
                       F.lit(". Supports other evidence only."))
    return joined.select(*base_finding(
        55, "yara_match", F.concat(F.lit("YARA-"), F.upper(F.regexp_replace("rule_name", r"[^A-Za-z0-9]", "-"))), c("rule_name"), "file", "Q1",
        "Q1 direct file evidence from a local signature match and file hash", "base_rule_score", summary,
        "Review Web, file and host context of the file before escalation.", source_file=c("path"), raw_hash=c("sha256"), timestamp=c("modified_at"),
    ))
