"""Byte-level BPE encoding and decoding by contiguous rank arrays.

Method. A word is held as an array of its parts and, beside it, an array of the ranks of adjacent pairs. The smallest
rank is searched for, the boundary there is deleted, and the two neighbouring ranks are looked up anew, until no pair
has a rank. Words of one length form the rows of one matrix, so each of these steps is one array operation for all of
them. Words too long for repeated scans take a heap of ranks over linked parts, with the same result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracelight.llm.common import ragged, slices
from tracelight.llm.tokens import PieceEncoder, _spelled, tokenizer_path

NO_RANK = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, as its public rule states: visible Latin-1 bytes stand for themselves, the others for the characters from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class RankTable:
    """Vocabulary and merge ranks of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {}
        for token, number in vocabulary.items():
            known = token not in self.added and all(c in alphabet for c in token)
            self.bytes_of[number] = bytes(alphabet[c] for c in token) if known else token.encode()
        for token, number in self.added.items():
            self.bytes_of[number] = token.encode()
        self.of_byte = np.array([vocabulary[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        keys, ranks = (left << 32) | right, np.arange(len(pairs), dtype=np.int64)
        order = np.lexsort((ranks, keys))  # a pair stated twice keeps its first rank
        self.keys, first = np.unique(keys[order], return_index=True)
        self.ranks = ranks[order][first]
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        most = max(self.bytes_of) + 1
        self.token_length = np.zeros(most, np.int64)
        for number, raw in self.bytes_of.items():
            self.token_length[number] = len(raw)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_text = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(most)), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where there is none."""
        if not len(self.keys):
            return np.full(np.broadcast(left, right).shape, NO_RANK)
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge_rows(self, parts: np.ndarray) -> list[np.ndarray]:
        """Ids of words of one length; ``parts`` has a row of byte ids per word."""
        n, width = parts.shape
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        row = np.arange(n)
        parts = parts.copy()
        if width == 1:
            return list(parts)
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        while len(row):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            done = best == NO_RANK
            if done.any():
                for i in np.flatnonzero(done):
                    out[row[i]] = parts[i, :width].copy()
                keep = ~done
                row, parts, ranks, at, best = row[keep], parts[keep], ranks[keep], at[keep], best[keep]
                if not len(row):
                    break
            lines = np.arange(len(row))
            parts[lines, at] = self.merged[best]
            # delete the boundary: all parts and ranks behind it move up by one
            width -= 1
            columns = np.arange(width)
            parts = np.take_along_axis(parts, columns + (columns > at[:, None]), axis=1)
            if width == 1:
                for i in lines:
                    out[row[i]] = parts[i].copy()
                break
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, np.minimum(columns + (columns > at[:, None] - 1), ranks.shape[1] - 1), axis=1)
            # refresh the ranks left and right of the merged part
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.rank(parts[before, at[before] - 1], parts[before, at[before]])
            after = np.flatnonzero(at < width - 1)
            ranks[after, at[after]] = self.rank(parts[after, at[after]], parts[after, at[after] + 1])
        return out

    def merge_long(self, parts: np.ndarray) -> np.ndarray:
        """Ids of one long word: pairs in a heap by rank, then place."""
        ids = parts.tolist()
        n = len(ids)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        table = dict(zip(self.keys.tolist(), self.ranks.tolist())) if not hasattr(self, "_table") else self._table
        self._table = table
        heap = [(table[k], i) for i in range(n - 1) if (k := (ids[i] << 32) | ids[i + 1]) in table]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = following[i]
            if ids[i] < 0 or j >= n or table.get((ids[i] << 32) | ids[j]) != rank:
                continue
            ids[i], ids[j] = int(self.merged[rank]), -1
            following[i] = following[j]
            if following[j] < n:
                previous[following[j]] = i
                if (k := table.get((ids[i] << 32) | ids[following[i]])) is not None:
                    heapq.heappush(heap, (k, i))
            if previous[i] >= 0 and (k := table.get((ids[previous[i]] << 32) | ids[i])) is not None:
                heapq.heappush(heap, (k, previous[i]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode_words(self, words: list[bytes], short: int = 64) -> list[np.ndarray]:
        """Ids of each word; words of up to ``short`` bytes go by rows of equal length."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if not size:
                continue
            for a in range(0, len(at), max(1, 400_000 // int(size))):
                some = at[a : a + max(1, 400_000 // int(size))]
                rows = self.of_byte[np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(len(some), size)]
                for i, ids in zip(some, self.merge_rows(rows) if size <= short else map(self.merge_long, rows)):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_text[ragged(self.token_start[ids], self.token_length[ids])].tobytes()


class RankEncoder(PieceEncoder):
    def __init__(self, path: str, **bounds):
        import public_tokenizers
        import regex

        self.table = RankTable(path)
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.special = re.compile("|".join(map(re.escape, self.table.added))) if self.table.added else None
        super().__init__(list(self.table.added), **bounds)

    def forget(self) -> None:
        super().forget()
        self.decimal: list[bytes | None] = []

    def _many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without special tokens; each distinct word is merged once."""
        cut = [[w.encode("utf-8", "surrogatepass") for w in self.words.findall(t)] for t in texts]
        distinct = list(dict.fromkeys(w for ws in cut for w in ws))
        ids = dict(zip(distinct, self.table.encode_words(distinct)))
        return [ids[ws[0]] if len(ws) == 1 else np.concatenate([ids[w] for w in ws]) if ws else np.zeros(0, np.int64) for ws in cut]

    def encode_pieces(self, keys: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        lists = self._many([_spelled(k) for k in keys])
        return [(np.arange(len(keys)), np.array([len(x) for x in lists], np.int64), np.concatenate(lists))]

    def encode_whole(self, texts: list[str]) -> list:
        """Special tokens are cut out first and are one id each; what lies between them is text."""
        if self.special is None:
            return self._many(texts)
        flat: list[str] = []
        plan: list[list[int]] = []  # number of a part of the text, or -1 - id
        for text in texts:
            at, steps = 0, []
            for m in self.special.finditer(text):
                steps += [len(flat), -1 - self.table.added[m[0]]]
                flat.append(text[at : m.start()])
                at = m.end()
            steps.append(len(flat))
            flat.append(text[at:])
            plan.append(steps)
        parts = self._many(flat)
        return [np.concatenate([parts[s] if s >= 0 else np.array([-1 - s], np.int64) for s in steps]) for steps in plan]

    def decimals(self, numbers: np.ndarray) -> list[bytes]:
        """For each piece its ids in decimal, joined by commas."""
        have = self.decimal
        if len(have) < self.pieces.next:
            have += [None] * (self.pieces.next - len(have))
        for n in np.unique(numbers).tolist():
            if have[n] is None:
                have[n] = ",".join(map(str, self.ids[self.start[n] : self.start[n] + self.length[n]].tolist())).encode()
        return list(map(have.__getitem__, numbers.tolist()))


@functools.lru_cache(maxsize=2)
def rank_encoder(path: str) -> RankEncoder:
    return RankEncoder(path)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, ``decoded``) of every row.

    The ids are those of the tokenizers library without special tokens added; a special token in a text is its id.
    ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256`` over the decoded text. Null is read as
    the empty text (no tokens). Rows with equal or null ids keep their own row; other columns are not read.
    """
    path = tokenizer or tokenizer_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
                       + ([("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if with_ids else []))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(path)
        for batch in parts:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts, 2_000_000):
                numbers, counts = encoder.numbers(texts[a:b])
                decimals = encoder.decimals(numbers)
                ids = encoder.ids[ragged(encoder.start[numbers], encoder.length[numbers])].astype(np.int64)
                raw = encoder.table.decode(ids)
                token_edges = np.concatenate([[0], np.cumsum(encoder.length[numbers], dtype=np.int64)])
                byte_edges = np.concatenate([[0], np.cumsum(encoder.table.token_length[ids])])
                ends = np.cumsum(counts)
                out: dict[str, list] = {f.name: [] for f in schema}
                for first, last in zip((ends - counts).tolist(), ends.tolist()):
                    t0, t1 = int(token_edges[first]), int(token_edges[last])
                    decoded = raw[int(byte_edges[t0]) : int(byte_edges[t1])].decode("utf-8", "replace")
                    out["n_tokens"].append(t1 - t0)
                    out["ids_sha256"].append(hashlib.sha256(b",".join(decimals[first:last])).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        out["ids"].append(ids[t0:t1].tolist())
                        out["decoded"].append(decoded)
                out["doc_id"] = names.slice(a, b - a).to_pylist()
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text}` text").mapInArrow(run, fields)
