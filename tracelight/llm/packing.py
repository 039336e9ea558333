"""Hierarchical packing of documents into context windows of several lengths.

Method. Every document becomes its token ids and an end id. Full pieces of the longest window are cut off first; what
is left of a document is routed to the shortest tier (a window length) that holds it. Tiers are packed from the longest
to the shortest: each piece opens a window of its tier, and the gap is filled from shorter tiers, largest fitting piece
first; if no whole piece fits, a piece is cut to close the gap. So every window is full. What remains when a tier has
no shorter material goes into windows whose lengths are the powers of two of its binary form. Windows are then put
into step groups of equal token counts, longest windows first.

Packing is local to a task: no shuffle, and memory is bounded by ``buffer_tokens``. Windows are powers of two long, so
none is padded. Which documents share a window depends on the input splits; every id lies in exactly one piece.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracelight.llm.common import slices
from tracelight.llm.tokens import library_encoder, tokenizer_path

TIERS = (256, 512, 1024, 2048)
END_ID = 1
# ids are counted from the task's number times this
WINDOWS_PER_TASK = 1 << 36


class WindowPacker:
    """Packs pieces ``(document, start, length)`` into full windows; one buffer at a time."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_windows: int = 8):
        if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers):
            raise ValueError("tiers are ascending powers of two")
        self.tiers, self.step_tokens = tiers, step_windows * tiers[-1]

    def pack(self, lengths: list[int]) -> list[list[tuple[int, int, int]]]:
        """Windows for documents of these lengths; a window lists its pieces ``(document, start, length)`` in order."""
        longest = self.tiers[-1]
        windows: list[list[tuple[int, int, int]]] = []
        held: list[list[tuple[int, int, int]]] = [[] for _ in self.tiers]  # per tier, ascending (length, document, start)
        for doc, total in enumerate(lengths):
            full = total - total % longest
            windows += [[(doc, at, longest)] for at in range(0, full, longest)]
            if total > full:
                held[bisect.bisect_left(self.tiers, total - full)].append((total - full, doc, full))
        for tier in held:
            tier.sort()
        for k in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[k]
            while held[k]:
                length, doc, start = held[k].pop()
                window, gap = [(doc, start, length)], size - length
                while gap:
                    found = self._largest(held[: k + 1], gap)
                    if found is None:
                        found = self._cut(held[: k + 1], gap)
                    if found is None:
                        break
                    length, doc, start = found
                    window.append((doc, start, length))
                    gap -= length
                if gap:  # the last window: nothing is left for the gap
                    windows += self._binary(window)
                else:
                    windows.append(window)
        return windows

    @staticmethod
    def _largest(held: list[list], gap: int):
        """The largest whole piece of at most ``gap`` tokens, from the longest tier that has one."""
        for tier in reversed(held):
            at = bisect.bisect_right(tier, (gap, 1 << 62, 0))
            if at:
                return tier.pop(at - 1)
        return None

    @staticmethod
    def _cut(held: list[list], gap: int):
        """The head of the shortest piece there is; its tail stays in the same tier's order."""
        for tier in held:
            if tier:
                length, doc, start = tier.pop(0)
                bisect.insort(held[0] if length - gap <= TIERS[0] else tier, (length - gap, doc, start + gap))
                return gap, doc, start
        return None

    @staticmethod
    def _binary(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
        """The pieces of an incomplete window, cut into windows of power-of-two lengths, longest first."""
        out, left, rest = [], sum(n for *_, n in window), list(window)
        while left:
            size = 1 << (left.bit_length() - 1)
            part, room = [], size
            while room:
                doc, start, n = rest.pop(0)
                take = min(room, n)
                part.append((doc, start, take))
                if take < n:
                    rest.insert(0, (doc, start + take, n - take))
                room -= take
            out.append(part)
            left -= size
        return out

    def steps(self, windows: list[list[tuple[int, int, int]]]) -> tuple[list[int], list[int]]:
        """(order of the windows, step group of each in that order). Sizes are powers of two, so filling longest first leaves no step but the last short."""
        sizes = [sum(n for *_, n in w) for w in windows]
        order = sorted(range(len(windows)), key=lambda i: -sizes[i])
        groups, filled = [], 0
        for i in order:
            groups.append(filled // self.step_tokens)
            filled += sizes[i]
        return order, groups


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID,
                   tiers: tuple[int, ...] = TIERS, step_windows: int = 8, buffer_tokens: int = 1 << 20, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_group`` (and ``ids``).

    ``ids_crc32`` is over the piece's ids as little-endian unsigned 32-bit integers. A null or empty text is the end id
    alone; a null id is kept as it is; rows with equal ids are packed as separate documents; an empty table gives no
    rows. Columns other than the id and the text are not read. A document longer than the buffer is packed by itself.
    """
    path = tokenizer or tokenizer_path()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64()), ("step_group", pa.int64())]
                       + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = library_encoder(path), WindowPacker(tiers, step_windows)
        context = TaskContext.get()
        base = next_id = (context.partitionId() if context else 0) * WINDOWS_PER_TASK
        next_step = base
        names: list = []
        arrays: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id, next_step, held
            windows = packer.pack([len(a) for a in arrays])
            order, groups = packer.steps(windows)
            out: dict[str, list] = {f.name: [] for f in schema}
            for n, (w, g) in enumerate(zip(order, groups)):
                at = 0
                size = sum(x for *_, x in windows[w])
                for doc, start, length in windows[w]:
                    piece = arrays[doc][start : start + length]
                    row = (names[doc], start, length, zlib.crc32(piece.tobytes()), len(arrays[doc]), next_id + n, at, size, next_step + g)
                    for key, value in zip(out, row):
                        out[key].append(value)
                    if with_ids:
                        out["ids"].append(piece.tolist())
                    at += length
            next_id += len(order)
            next_step += groups[-1] + 1 if groups else 0
            names.clear()
            arrays.clear()
            held = 0
            return pa.RecordBatch.from_pydict(out, schema=schema)

        for batch in parts:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                flat, counts = encoder.encode(texts[a:b])
                flat, at = flat.astype("<u4"), 0
                for name, n in zip(ids[a:b], counts.tolist()):
                    names.append(name)
                    arrays.append(np.append(flat[at : at + n], np.array([end_id], "<u4")))
                    at += n
                    held += n + 1
                    if held >= buffer_tokens:
                        yield flush()
        if arrays:
            yield flush()

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"
    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text}` text").mapInArrow(run, fields + (", ids array<int>" if with_ids else ""))
