"""Removal of repeated passages by suffix automata over reference shards.

Contract of the result: a window is ``window`` consecutive words of one document; every word goes that is covered by a
window whose word sequence also starts earlier (smaller id, or same document and earlier start).

Method. A reference shard is what the corpus has around one anchor: the ``GRAM``-word sequence of smallest hash in a
window, which equal windows share. A piece is the words of a run of windows with one anchor. The pieces of a shard are
streamed in corpus order through the suffix automaton of the shard's earlier pieces; the matching statistics give, for
every end position, the longest suffix seen before, and the maximal spans of ``window`` words and more are marked; then
the piece extends the automaton. An automaton is built from its second distinct piece on.

The automata are not sent to every task: that costs corpus times shards. Instead pieces travel to their shard, which
holds a bounded number of distinct pieces, and only pieces whose anchor occurs more than once travel at all. Documents
are dealt into blocks of bounded bytes; equal pieces of a block travel once. An anchor with more than ``SHARD_PIECES``
pieces is a hot key: its pieces are cut into single windows, dealt over salts by their content.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracelight.llm.common import byte_words, carried, mixed, text_bytes

WINDOW = 20
GRAM = 5
SHARD_PIECES = 256
BLOCK_BYTES = 2_000_000
GROUP_WORDS = 400_000
_PLACE = np.uint64((1 << 26) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class PieceAutomaton:
    """Suffix automaton of the word sequences added so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            known = nexts[last].get(word)
            if known is not None:  # as after an earlier sequence with the same beginning
                if length[known] == length[last] + 1:
                    last = known
                    continue
                last = self._clone(last, word, known)
                continue
            state = len(nexts)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and word not in nexts[at]:
                nexts[at][word] = state
                at = link[at]
            if at >= 0:
                target = nexts[at][word]
                link[state] = target if length[target] == length[at] + 1 else self._clone(at, word, target)
            last = state

    def _clone(self, at: int, word, target: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[at] + 1)
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def matches(self, words: list) -> list[int]:
        """Matching statistics: for each end position the length of the longest suffix that occurs in what was added."""
        nexts, link, length = self.next, self.link, self.length
        state = n = 0
        out = []
        for word in words:
            while state and word not in nexts[state]:
                state = link[state]
                n = length[state]
            if (to := nexts[state].get(word)) is not None:
                state, n = to, n + 1
            out.append(n)
        return out


class Shard:
    """Pieces of one anchor in corpus order; says which windows of each occurred in earlier pieces."""

    def __init__(self, window: int):
        self.window, self.first, self.known, self.automaton = window, None, set(), None

    def repeated(self, piece: bytes, windows: int) -> int:
        """Bit ``i`` is set if the piece's window ``i`` was seen before."""
        if piece in self.known:
            return (1 << windows) - 1
        self.known.add(piece)
        if self.first is None:
            self.first = piece
            return 0
        if self.automaton is None:
            self.automaton = PieceAutomaton()
            self.automaton.add(self.first.split(b" "))
        words = piece.split(b" ")
        mask = 0
        for i, n in enumerate(self.automaton.matches(words)[self.window - 1 :]):
            if n >= self.window:
                mask |= 1 << i
        self.automaton.add(words)
        return mask


class Block:
    """Documents of one block in corpus order (id, then text), their words and their runs of windows."""

    def __init__(self, table: pa.Table, window: int):
        ids, texts = table.column("_id").to_pylist(), table.column("_text").to_pylist()
        self.none = [i is None for i in ids]
        keys = [table.column("_key")[i].as_py() for i in range(len(ids))]
        self.order = sorted(range(len(ids)), key=lambda i: (self.none[i], keys[i], texts[i] or ""))
        self.keys = [keys[i] for i in self.order]
        self.none = [self.none[i] for i in self.order]
        self.words = [byte_words(texts[i]) for i in self.order]
        self.window = window

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(document, first window, windows, anchor hash, content hash) of all runs, for groups of documents."""
        at = 0
        while at < len(self.words):
            end, total = at, 0
            while end < len(self.words) and (end == at or total + len(self.words[end]) <= GROUP_WORDS):
                total += len(self.words[end])
                end += 1
            yield from self._runs(at, end)
            at = end

    def _runs(self, at: int, end: int):
        sizes = np.array([len(w) for w in self.words[at:end]], np.int64)
        window, total = self.window, int(sizes.sum())
        if total < window:
            return
        flat = [w for ws in self.words[at:end] for w in ws]
        grams = window - GRAM + 1
        # a longer text than the places can number is worked off in overlapping parts
        for part in range(0, total - window + 1, 1 << 25):
            stop = min(total, part + (1 << 25) + window - 1)
            words = mixed(np.fromiter(map(zlib.crc32, flat[part:stop]), np.uint64, stop - part))
            n = len(words) - GRAM + 1
            hashes = np.zeros(n, np.uint64)
            for j in range(GRAM):
                hashes = hashes * _STEP + words[j : j + n]
            hashes = mixed(hashes)
            low = (hashes & ~_PLACE) | np.arange(n, dtype=np.uint64)
            width = 1
            while width < grams:
                step = min(width, grams - width)
                low = np.minimum(low[:-step], low[step:])
                width += step
            anchor = (low & _PLACE).astype(np.int64)
            begins = np.cumsum(sizes) - sizes - part
            document = np.repeat(np.arange(end - at), sizes)[part:stop]
            first = np.arange(len(anchor))
            valid = document[first] == document[first + window - 1]
            begin = valid & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~valid[:-1]])
            starts = np.flatnonzero(begin)
            if not len(starts):
                continue
            breaks = np.flatnonzero(begin | ~valid)
            after = np.append(breaks, len(anchor))[np.searchsorted(breaks, starts) + 1]
            count = after - starts
            power = np.multiply.accumulate(np.full(len(words), _STEP, np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power, dtype=np.uint64)])
            inverse = np.multiply.accumulate(np.full(len(words), np.uint64(pow(int(_STEP), -1, 1 << 64)), np.uint64))
            content = mixed((sums[starts + count + window - 1] - sums[starts]) * inverse[starts])
            yield document[starts] + at, starts - begins[document[starts]], count, hashes[anchor[starts]], content

    def piece(self, document: int, first: int, windows: int) -> bytes:
        return b" ".join(self.words[document][first : first + windows + self.window - 1])


_PIECE = pa.schema([("anchor", pa.int64()), ("salt", pa.int32()), ("none", pa.bool_()), ("key", pa.int64()), ("row", pa.int32()), ("first", pa.int32()),
                    ("windows", pa.int32()), ("piece", pa.binary()), ("mask", pa.int64()), ("block", pa.int64())])
_PIECE_SQL = "anchor long, salt int, none boolean, key long, row int, first int, windows int, piece binary, mask long, block long"


def _anchors(window: int):
    def run(table: pa.Table) -> pa.Table:
        """Anchors of a block: occurrences and distinct pieces."""
        block = Block(table, window)
        found = [(h, c) for _, _, _, h, c in block.runs()]
        number = table.column("_block")[0].as_py()
        if not found:
            return pa.table({"block": pa.array([], pa.int64()), "anchor": pa.array([], pa.int64()), "seen": pa.array([], pa.int64()), "pieces": pa.array([], pa.int64())})
        anchors, contents = (np.concatenate(x) for x in zip(*found))
        kinds, seen = np.unique(anchors, return_counts=True)
        _, one = np.unique(mixed(anchors) ^ contents, return_index=True)
        _, pieces = np.unique(anchors[one], return_counts=True)
        return pa.table({"block": np.full(len(kinds), number), "anchor": kinds.view(np.int64), "seen": seen.astype(np.int64), "pieces": pieces.astype(np.int64)})

    return run


def _pieces(window: int):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        """Pieces that travel, one of each content, and marks of windows that occurred earlier in the block itself."""
        out: dict[str, list] = {f.name: [] for f in _PIECE}
        if docs.num_rows:
            block = Block(docs, window)
            number = docs.column("_block")[0].as_py()
            anchors = shared.column("anchor").to_numpy()
            many = dict(zip(anchors.tolist(), shared.column("total").to_pylist()))
            wanted = np.sort(anchors.view(np.uint64)) if len(anchors) else np.zeros(0, np.uint64)
            known: set = set()

            def put(anchor, salt, d, first, windows, piece, mask):
                for name, value in zip(out, (anchor, salt, block.none[d], block.keys[d], d, first, windows, piece, mask, number)):
                    out[name].append(value)

            for document, first, windows, hashes, _ in block.runs():
                if not len(wanted):
                    break
                place = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                for i in np.flatnonzero(wanted[place] == hashes).tolist():
                    d, a, n, anchor = int(document[i]), int(first[i]), int(windows[i]), int(hashes[i : i + 1].view(np.int64)[0])
                    total = many[anchor]
                    if total <= SHARD_PIECES:
                        piece = block.piece(d, a, n)
                        if (anchor, piece) in known:
                            put(zlib.crc32(piece) - (1 << 31), 0, d, a, n, None, (1 << n) - 1)
                        else:
                            known.add((anchor, piece))
                            put(anchor, 0, d, a, n, piece, 0)
                        continue
                    salts = -(-total // 32)
                    for w in range(a, a + n):
                        piece = block.piece(d, w, 1)
                        if (anchor, piece) in known:
                            put(zlib.crc32(piece) * 31 + w + d, 0, d, w, 1, None, 1)
                        else:
                            known.add((anchor, piece))
                            put(anchor, zlib.crc32(piece) % salts + 1, d, w, 1, piece, 0)
        return pa.table(out, schema=_PIECE)

    return run


def _judged(window: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stream pieces in corpus order through their shards; pass marks on."""
        last, shard = None, None
        for batch in parts:
            columns = {f.name: batch.column(i) for i, f in enumerate(_PIECE)}
            masks = columns["mask"].to_pylist()
            for i, (anchor, salt, windows, piece) in enumerate(zip(*(columns[c].to_pylist() for c in ("anchor", "salt", "windows", "piece")))):
                if piece is None:
                    continue
                if (anchor, salt) != last:
                    last, shard = (anchor, salt), Shard(window)
                masks[i] = shard.repeated(piece, windows)
            marks = np.flatnonzero(np.array(masks, np.int64))
            if len(marks):
                take = pa.array(marks)
                yield pa.RecordBatch.from_arrays([columns["block"].take(take), columns["row"].take(take), columns["first"].take(take), pa.array(masks, pa.int64()).take(take)],
                                                 names=["block", "row", "first", "mask"])

    return run


def _cleaned(window: int, names: list[str], schema: pa.Schema):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        """Texts of a block without the words that marked windows cover."""
        if not docs.num_rows:
            return schema.empty_table()
        block = Block(docs, window)
        gone = [None] * len(block.words)
        for d, first, mask in zip(*(marks.column(c).to_pylist() for c in ("row", "first", "mask"))):
            cover = gone[d]
            if cover is None:
                cover = gone[d] = np.zeros(len(block.words[d]) + 1, np.int32)
            while mask:
                low = mask & -mask
                at = first + low.bit_length() - 1
                cover[at] += 1
                cover[at + window] -= 1
                mask ^= low
        out: dict[str, list] = {"_words": [], "_removed": [], "_kept": [], "_sha": [], "_spans": []}
        for words, cover in zip(block.words, gone):
            kept, spans = words, []
            if cover is not None:
                off = np.cumsum(cover[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], off, [0]]))).tolist()
                spans = [{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2])]
                kept = [w for w, o in zip(words, off.tolist()) if not o]
            joined = b" ".join(kept)
            for key, value in zip(out, (len(words), len(words) - len(kept), joined.decode("utf-8", "surrogatepass") if spans else None, hashlib.sha256(joined).hexdigest(), spans)):
                out[key].append(value)
        ordered = docs.take(pa.array(block.order))
        columns = [ordered.column(n) for n in names] + [pa.array(out[k], schema.field(k).type) for k in out]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id``, carried columns, ``kept_text, n_words, n_removed, kept_sha256, removed_spans``.

    ``kept_text`` is the original text where nothing goes, else the kept words joined by one space; ``kept_sha256`` is
    of the kept words joined by one space; ``removed_spans`` are ranges of word numbers. A null text has no words and
    stays null. Rows with equal ids are separate documents in the order of their texts; rows without an id come after all
    others, ordered by a hash of their texts. A carried column named like a result is dropped.
    """
    if window < GRAM or window - GRAM + 1 > 60:
        raise ValueError(f"a window has {GRAM} to {GRAM + 59} words")
    extra = carried(docs, carry, ("doc_id", "kept_text", "n_words", "n_removed", "kept_sha256", "removed_spans", text))
    blocks = max(1, -(-text_bytes(docs, text) // BLOCK_BYTES))
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(extra)])
    slim = slim.withColumn("_key", F.coalesce("_id", F.xxhash64("_text"))).withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(blocks)))
    by_block = slim.groupBy("_block")
    anchors = by_block.applyInArrow(_anchors(window), "block long, anchor long, seen long, pieces long")
    whole = W.partitionBy("anchor")
    # every block has an anchor once, so a hot anchor has no more rows than there are blocks
    shared = anchors.select("block", "anchor", F.sum("seen").over(whole).alias("seen"), F.sum("pieces").over(whole).alias("total")) \
        .where("seen > 1").select(F.col("block").alias("_block"), "anchor", "total")
    pieces = by_block.cogroup(shared.groupBy("_block")).applyInArrow(_pieces(window), _PIECE_SQL)
    marks = pieces.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "none", "key", "row", "first") \
        .mapInArrow(_judged(window), "block long, row int, first int, mask long").withColumnRenamed("block", "_block")
    names = ["_id", "_text"] + [f"_c{i}" for i in range(len(extra))]
    result = slim.select(*names).schema
    spans = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType()))
    for field, kind in (("_words", T.LongType()), ("_removed", T.LongType()), ("_kept", T.StringType()), ("_sha", T.StringType()), ("_spans", spans)):
        result = result.add(field, kind)
    cleaned = by_block.cogroup(marks.groupBy("_block")).applyInArrow(_cleaned(window, names, to_arrow_schema(result)), result)
    return cleaned.select(F.col("_id").alias("doc_id"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(extra)],
                          F.coalesce("_kept", "_text").alias("kept_text"), F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"),
                          F.col("_sha").alias("kept_sha256"), F.col("_spans").alias("removed_spans"))
