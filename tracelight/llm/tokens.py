"""Texts to token ids, one encoding per distinct word.

Byte-level BPE first cuts a text into words and then merges inside each word. A text may therefore be cut at any
single space between two visible characters: the pieces ``word`` and `` word`` give the same ids alone as in their
text. A worker keeps the ids of the pieces it has met (within a bound) and encodes only new ones.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

from tracelight.llm.common import ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# White space besides the space itself. ASCII controls, then the rest of Unicode.
CONTROL_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
ALL_SPACES = CONTROL_SPACES + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

TOKENIZER_FILE = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    """Number of each piece; a new one gets the next number and is noted as fresh."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.next = 0

    def __missing__(self, key: str) -> int:
        number = self[key] = self.next
        self.next += 1
        self.fresh.append(key)
        return number


class PieceEncoder:
    """Ids of whole texts. Subclasses say how new pieces and uncuttable texts are encoded.

    ``max_pieces`` and ``max_chars`` bound what is kept; when they are reached the store starts afresh, which
    changes no result.
    """

    def __init__(self, added: list[str], max_pieces: int = 700_000, max_chars: int = 14_000_000):
        self.added = added
        self.max_pieces, self.max_chars = max_pieces, max_chars
        self.forget()

    def forget(self) -> None:
        self.pieces, self.chars = _Pieces(), 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _store(self, numbers: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        """Keep the ids of these pieces; ``flat`` has them one piece after the other."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.pieces.next > len(self.start):
            self.start, self.length = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.length, np.zeros_like(self.length)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[numbers] = self.used + np.cumsum(counts) - counts
        self.length[numbers] = counts
        self.used += len(flat)

    def _uncuttable(self, text: str) -> bool:
        """A space beside other white space, or at an end, belongs to a longer run; special tokens are found before words are."""
        if "  " in text or text[0] == " " or text[-1] == " " or any(a in text for a in self.added):
            return True
        return any(c in text and (c + " " in text or " " + c in text) for c in (CONTROL_SPACES if text.isascii() else ALL_SPACES))

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(piece numbers of all texts, pieces of each text); ids of the numbers are in the store until the next call."""
        if len(self.pieces) > self.max_pieces or self.chars > self.max_chars:
            self.forget()
        keys: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        whole: list[tuple[int, int]] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if self._uncuttable(text):
                whole.append((i, len(keys)))
                keys.append("")
                counts[i] = 1
                continue
            parts = text.split(" ")
            parts[0] = " " + parts[0]  # a key that starts with a space is a piece without one, at the start of its text
            keys += parts
            counts[i] = len(parts)
        first = self.pieces.next
        numbers = np.array(list(map(self.pieces.__getitem__, keys)), dtype=np.int64)
        fresh, self.pieces.fresh = self.pieces.fresh, []
        if fresh:
            self.chars += sum(map(len, fresh))
            for at, sizes, flat in self.encode_pieces(fresh):
                self._store(first + at, sizes, flat)
        if whole:
            lists = self.encode_whole([texts[i] for i, _ in whole])
            own = self.pieces.next + np.arange(len(whole))
            self.pieces.next += len(whole)
            self._store(own, np.array([len(x) for x in lists], np.int64), np.concatenate([np.asarray(x, np.uint32) for x in lists]))
            self.chars += sum(len(texts[i]) for i, _ in whole)
            numbers[[k for _, k in whole]] = own
        return numbers, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, tokens of each text)."""
        numbers, counts = self.numbers(texts)
        lengths = self.length[numbers]
        flat = self.ids[ragged(self.start[numbers], lengths)]
        edges = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        ends = np.cumsum(counts)
        return flat, edges[ends] - edges[ends - counts]

    def encode_pieces(self, keys: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of (places in ``keys``, tokens of each, ids of all)."""
        raise NotImplementedError

    def encode_whole(self, texts: list[str]) -> list:
        raise NotImplementedError


def _spelled(key: str) -> str:
    if not key:
        return ""
    return key[1:] if key[0] == " " else " " + key


class LibraryEncoder(PieceEncoder):
    """Pieces are encoded by the tokenizers library, many in one text, and told apart by the bytes of their ids."""

    CHUNK = 400

    def __init__(self, path: str, special_as_text: bool = False, **bounds):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.token_bytes[number] = len(token)  # one character of the vocabulary stands for one byte
        super().__init__([] if special_as_text else added, **bounds)

    def _ids(self, texts: list[str]) -> list:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_whole(self, texts: list[str]) -> list:
        return self._ids(texts)

    def encode_pieces(self, keys: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        alone = [i for i, k in enumerate(keys) if not k or k[0] == " "]
        lists = self._ids([_spelled(keys[i]) for i in alone])
        out = [(np.array(alone, np.int64), np.array([len(x) for x in lists], np.int64), np.array([x for ids in lists for x in ids], np.uint32))]
        skipped = set(alone)
        joined = [i for i in range(len(keys)) if i not in skipped]
        groups = [joined[a : a + self.CHUNK] for a in range(0, len(joined), self.CHUNK)]
        texts = [" " + " ".join([keys[i] for i in g]) for g in groups]
        for group, text, ids in zip(groups, texts, self._ids(texts)):
            ids = np.array(ids, np.uint32)
            # pieces hold no space of their own, so they end before each further space and at the end of the text
            ends = np.append(np.flatnonzero(np.frombuffer(text.encode(), np.uint8)[1:] == 0x20) + 1, len(text.encode()))
            at = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1
            out.append((np.array(group, np.int64), np.diff(at, prepend=0), ids))
        return out


@functools.lru_cache(maxsize=2)
def library_encoder(path: str, special_as_text: bool = False) -> LibraryEncoder:
    """The encoder of this worker; a worker serves many tasks and keeps what it has met."""
    return LibraryEncoder(path, special_as_text)
