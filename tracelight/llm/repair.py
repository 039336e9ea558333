"""Conversation structure repair: faults per row, and the cheapest edits that give a conversation a legal order of roles.

Method: square-root checkpointed dynamic programming. A conversation's rows are symbols, the legal orders of role initials
``(s?(ua)+)?`` an automaton of four states. The cost to finish from each state before each row is computed backward; only
the vectors at every root-of-n-th row are kept, and walking forward the vectors of one stretch at a time are computed
again, to emit at each place the ASCII-least edit that lies on a cheapest path. A letter leads to one state only, so the
least letter at each place gives the least word.

On Spark: rows are ordered by one range sort over (conversation, turn), so a conversation of any size lies over several
partitions, and equal rows are spread too. Each task folds the rows of a conversation that it holds into blocks of bounded
rows and bytes. A conversation of one block is finished there. For the others a block gives its 4 x 4 matrix of least
costs; one narrow pass from the last block to the first turns these into the vectors at the block borders, the outer
checkpoints, and one pass from the first block to the last walks the blocks. Both passes stream: a task holds one block at
a time, plus the audit string that it returns. The last pass is sequential for each conversation by definition of its
SHA-256.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
DAMAGE_EVERY = 20
BLOCK_ROWS, BLOCK_CHARS = 1024, 4_000_000

# States: nothing yet, after the system row, after a user row, after an assistant row. All but the third want a user row next.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT, WANTED = (USER, USER, ASSISTANT, USER), "uuau"
NAMES = {USER: "user", ASSISTANT: "assistant"}
_BLANKS = " \t\n\x0b\x0c\r"
_FAR = 1 << 60

Vector = tuple[int, int, int, int]
# A symbol: role initial (one of s, u, a, or - for any other), whether the row must go, whether it is truncated.
Symbol = tuple[str, bool, bool]


def with_inserts(v: Iterable[int]) -> Vector:
    """Least costs where rows may be inserted first. A user and an assistant row together lead back, so one each is enough."""
    start, system, user, assistant = v
    user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return min(start, INSERT + user), min(system, INSERT + user), user, assistant


END = with_inserts((0, _FAR, _FAR, 0))


def costs_before(symbol: Symbol, after: Vector) -> Vector:
    """Cost to finish from each state before a row, given the costs behind it."""
    initial, must_go, truncated = symbol
    out = [DELETE + c for c in after]
    if not must_go:
        extra = TRUNCATED if truncated else 0
        for q in range(4):
            out[q] = min(out[q], extra + after[NEXT[q]] + (KEEP if initial == WANTED[q] else REROLE))
        if initial == "s":
            out[START] = min(out[START], extra + after[SYSTEM])
    return with_inserts(out)


def block_matrix(symbols: list[Symbol]) -> list[int]:
    """Least cost from each state before the block (rows) to each state behind it (columns), flat."""
    columns = []
    for q in range(4):
        v: Vector = tuple(0 if p == q else _FAR for p in range(4))
        for s in reversed(symbols):
            v = costs_before(s, v)
        columns.append([min(c, _FAR) for c in v])
    return [columns[q][p] for p in range(4) for q in range(4)]


def through(matrix: list[int], after: Vector) -> Vector:
    """Costs before a block from those behind it. A block's matrix covers the inserts before its rows, ``after`` those behind."""
    return tuple(min(min(matrix[4 * p + q] + after[q] for q in range(4)), _FAR) for p in range(4))


def edits(symbols: list[Symbol], end: Vector, state: int, last: bool) -> tuple[str, list[tuple[int, int]], int]:
    """The block's edits from ``state``, given the costs behind the block: letters, kept places ``(row or -1, state led to)``, state reached.

    Costs are stored at every root-of-n-th row only and computed again stretch by stretch.
    """
    n = len(symbols)
    stride = max(1, math.isqrt(n))
    stored, v = {}, end
    for i in range(n - 1, -1, -1):
        if (i + 1) % stride == 0 or i == n - 1:
            stored[i + 1] = v
        v = costs_before(symbols[i], v)
    letters, kept = [], []

    def insert() -> None:
        nonlocal state
        state = NEXT[state]
        letters.append("I")
        kept.append((-1, state))

    before = v
    for begin in range(0, n, stride):
        stop = min(n, begin + stride)
        ahead = [stored[stop]]
        for i in range(stop - 1, begin - 1, -1):
            ahead.append(costs_before(symbols[i], ahead[-1]))
        ahead.reverse()
        for i in range(begin, stop):
            before, after = ahead[i - begin], ahead[i - begin + 1]
            initial, must_go, truncated = symbols[i]
            extra = TRUNCATED if truncated else 0
            while before[state] != DELETE + after[state] and before[state] == INSERT + before[NEXT[state]]:
                insert()
            if before[state] == DELETE + after[state]:
                letters.append("D")
                continue
            if state == START and initial == "s" and before[state] == extra + after[SYSTEM]:
                letters.append("K")
                state = SYSTEM
            else:
                letters.append("K" if initial == WANTED[state] else "R")
                state = NEXT[state]
            kept.append((i, state))
    while last and end[state]:
        insert()
    return "".join(letters), kept, state


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, gone``: the rows after the damage that the checksum of ``conv_id:turn`` names.

    A null role or text is one space, and so is a null id or turn inside the checksum. A dropped row stays as a row with
    ``gone``, so that its conversation is known.
    """
    c = F.col
    df = conversations.select(c(conv_id).cast("long").alias("conv_id"), c(turn).cast("long").alias("turn"), F.coalesce(c(role).cast("string"), F.lit(" ")).alias("role"),
                              F.coalesce(c(text).cast("string"), F.lit(" ")).alias("text"))
    spelled = lambda name: F.coalesce(c(name).cast("string"), F.lit(" "))
    df = df.withColumn("_k", F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn"))) % DAMAGE_EVERY)
    df = df.withColumn("text", F.when(c("_k") == 1, "").when(c("_k") == 2, F.translate("text", ".!?", "")).otherwise(c("text"))) \
        .withColumn("role", F.when(c("_k") == 4, "user").otherwise(c("role")))
    df = df.withColumn("_copy", F.explode(F.when(c("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return df.select("conv_id", "turn", "role", "text", (c("_k") == 0).alias("gone"))


_BLOCK = ("conv_id long, at long, whole boolean, rows long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
          "first_turn long, last_turn long, turns long, matrix array<long>, initials string, must_go array<boolean>, cut array<boolean>, roles array<string>, texts array<string>")
_BLOCK_NAMES = [part.split()[0] for part in _BLOCK.split(", ")]


def _block(conv: int | None, at: int, whole: bool, rows: list[tuple]) -> dict:
    """One block from rows ``(turn, role, text, gone, repeated)`` in order."""
    rows = [r for r in rows if not r[3]]
    symbols: list[Symbol] = []
    blank = duplicate = truncated = 0
    for _, role, text, _, repeated in rows:
        bare = text.rstrip(_BLANKS)
        empty, cut = not bare, bool(bare) and not repeated and bare[-1] not in ".!?"
        blank, duplicate, truncated = blank + empty, duplicate + (not empty and repeated), truncated + cut
        symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "-", empty or repeated, cut))
    initials = "".join(s[0] for s in symbols)
    turns = [r[0] for r in rows if r[0] is not None]
    return {
        "conv_id": conv, "at": at, "whole": whole, "rows": len(rows), "blank": blank, "duplicate": duplicate, "truncated": truncated,
        "illegal": sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1)), "first_initial": initials[:1], "last_initial": initials[-1:],
        "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": sum(a != b for a, b in zip(turns, [None, *turns])),
        "matrix": None if whole else block_matrix(symbols), "initials": initials, "must_go": [s[1] for s in symbols], "cut": [s[2] for s in symbols],
        "roles": [r[1] for r in rows], "texts": [r[2] for r in rows],
    }


def _blocks(ordered: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of rows in order; ``whole`` if a block is all that the table holds of its conversation for certain.

    The first and the last conversation of a partition may go on elsewhere, so their blocks are never whole.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, conv, at, first_run, pieces = [], 0, None, None, True, 0
        out: list[dict] = []
        waiting = 0

        def close(ends: bool) -> None:
            nonlocal held, size, pieces, waiting
            if held:
                out.append(_block(conv, at, ends and not first_run and not pieces, held))
                waiting += size
                held, size, pieces = [], 0, pieces + 1

        for batch in parts:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for c, place, *row in zip(*columns):
                if at is None or c != conv:
                    if at is not None:
                        close(True)
                        first_run, pieces = False, 0
                    conv, at = c, place
                elif held and (len(held) >= block_rows or size + len(row[2]) > BLOCK_CHARS):
                    close(False)
                if not held:
                    at = place
                held.append(tuple(row))
                size += len(row[2])
                if len(out) >= 512 or waiting > BLOCK_CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema=_arrow_block())
                    out.clear()
                    waiting = 0
        close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_arrow_block())

    return ordered.select("conv_id", "at", "turn", "role", "text", "gone", "repeated").mapInArrow(run, _BLOCK)


def _arrow_block() -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in _BLOCK.split(", "))])


def _border_costs(blocks: DataFrame) -> DataFrame:
    """``conv_id, at, end, last`` of blocks that are not whole: the costs behind each, from the last block of a conversation to its first."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, v, seen = None, END, False
        for batch in parts:
            ends, lasts = [], []
            for c, matrix in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                last = not seen or c != conv
                if last:
                    conv, v, seen = c, END, True
                ends.append(list(v))
                lasts.append(last)
                v = through(matrix, v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends, pa.list_(pa.int64())), pa.array(lasts, pa.bool_())], names=["conv_id", "at", "end", "last"])

    narrow = blocks.where(~F.col("whole")).select("conv_id", "at", "matrix")
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", F.col("at").desc())
    return ordered.mapInArrow(run, "conv_id long, at long, end array<long>, last boolean")


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Walk:
    """What is known of one conversation while its blocks pass in order."""

    def __init__(self, conv: int | None):
        self.conv, self.counts = conv, dict.fromkeys(_COUNTS, 0)
        self.state, self.cost, self.letters, self.digest, self.lines = START, None, [], hashlib.sha256(), 0
        self.initial, self.low, self.turn, self.turns = "", None, None, 0

    def add(self, b: dict) -> None:
        for name in _COUNTS:
            self.counts[name] += b[name]
        if self.initial and b["first_initial"]:
            self.counts["illegal"] += self.initial + b["first_initial"] not in ("su", "ua", "au")
        self.initial = b["last_initial"] or self.initial
        if b["turns"]:
            self.turns += b["turns"] - (self.turn == b["first_turn"])
            self.low, self.turn = b["first_turn"] if self.low is None else self.low, b["last_turn"]
        symbols = list(zip(b["initials"], b["must_go"], b["cut"]))
        end = END if b["end"] is None else tuple(b["end"])
        if self.cost is None:
            v = end
            for s in reversed(symbols):
                v = costs_before(s, v)
            self.cost = v[START]
        letters, kept, self.state = edits(symbols, end, self.state, b["last"] is not False)
        self.letters.append(letters)
        for i, led in kept:
            initial = "" if i < 0 else b["initials"][i]
            same = i >= 0 and (led == SYSTEM or initial == ("u" if led == USER else "a"))
            line = f"{b['roles'][i] if same else NAMES[led]}:{b['texts'][i] if i >= 0 else ''}"
            self.digest.update((("\n" if self.lines else "") + line).encode("utf-8", "surrogatepass"))
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        gaps = (gaps + (1 << 63)) % (1 << 64) - (1 << 63)
        return (self.conv, gaps, *(self.counts[name] for name in _COUNTS), self.cost or 0, "".join(self.letters), self.digest.hexdigest())


def _walked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results from blocks that come in order, one conversation after the other."""
    walk: _Walk | None = None
    schema = pa.schema([(part.split()[0], pa.string() if part.endswith("string") else pa.int64()) for part in _RESULT.split(", ")])
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    rows: list[tuple] = []
    for batch in parts:
        for i in range(batch.num_rows):
            b = batch.slice(i, 1).to_pylist()[0]
            if walk is None or walk.conv != b["conv_id"]:
                if walk is not None:
                    rows.append(walk.row())
                walk = _Walk(b["conv_id"])
            walk.add(b)
            if len(rows) >= 2000:
                yield made(rows)
                rows = []
    if walk is not None:
        rows.append(walk.row())
    if rows:
        yield made(rows)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text, gone)``: gaps, fault counts, cost, audit and digest of the repaired text.

    Rows are taken by turn (nulls first); rows of one turn by role, then by the first 64 characters of the text, then by a
    digest of role and text. A null ``conv_id`` is a conversation of its own. A conversation whose rows are all gone, or
    all deleted, has an empty audit or one of ``D`` only and the digest of the empty string. Repeats are told by SHA-256.
    An empty table gives no rows.
    """
    c = F.col
    marked = written(rows.select("conv_id", "turn", "role", "text", "gone", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("key"),
                                 F.monotonically_increasing_id().alias("n")))
    place = F.struct(c("turn").isNotNull().alias("known"), c("turn").alias("turn"), c("n").alias("n"))
    # the least place is summed before it moves, and only repeated texts are joined
    firsts = written(marked.where(~c("gone")).groupBy(F.coalesce("conv_id", F.lit(0)).alias("k"), c("conv_id").isNull().alias("none"), "key")
                     .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("k", "none", "key", "first"))
    keyed = marked.withColumn("k", F.coalesce("conv_id", F.lit(0))).withColumn("none", c("conv_id").isNull())
    flagged = keyed.join(firsts, ["k", "none", "key"], "left").withColumn("repeated", c("first").isNotNull() & (place > c("first")) & ~c("gone"))
    order = [c("conv_id").asc_nulls_first(), c("turn").asc_nulls_first(), c("role").asc(), c("lead").asc(), c("key").asc(), c("n").asc()]
    ordered = flagged.withColumn("lead", F.substring("text", 1, 64)).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    blocks = written(_blocks(ordered, block_rows))
    ends = written(_border_costs(blocks))
    names = [c(n) for n in _BLOCK_NAMES if n not in ("whole", "matrix")]
    several = blocks.where(~c("whole")).drop("whole", "matrix").join(ends.drop("conv_id"), "at").select(*names, "end", "last")
    streamed = several.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_walked, _RESULT)
    single = blocks.where("whole").select(*names, F.lit(None).cast("array<long>").alias("end"), F.lit(True).alias("last")).mapInArrow(_walked, _RESULT)
    return single.unionByName(streamed)


def damage_and_repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``repair`` of the damaged rows of a table: one row for every id that the table has. Other columns of the table play no part, whatever their names."""
    return repair(damaged(conversations, conv_id, turn, role, text))
