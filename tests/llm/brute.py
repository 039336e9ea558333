"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import xxhash

# texts with what is awkward: nothing, blanks only, Unicode, repeats, no blanks, special tokens
ODD_TEXTS = [
    None, "", " ", "\n\n", "one", "a b", "a  b\tc\r\nd", "The the THE the. the the the", "日本語 テキスト　です 😀", "x" * 3000, "ab" * 500,
    "<|endoftext|> between <|endoftext|>!", " lead and trail ", "it's we'll don't ' ''s 12a", "é\u00a0\u00a0è \u2028 z", "\x1c a \x85b", "! ! !! !!!",
    "same words here " * 30, "same words here " * 30,
]


def words(text):
    return text.encode().split() if text else []


def base_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if x.encode().split()]
    again = set()
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            again.update(p + k for p in places for k in range(3))
    n, r = len(w), len(again)
    return (n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n)


def without_repeats(rows, window=20):
    """{place: (n_words, n_removed, kept sha256)} of ``rows``: (order key, text) in corpus order."""
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, most=3):
    """Smallest reachable id of each row by comparing all pairs."""
    n = len(ids)
    p = np.array(prints, np.uint64)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(p[i + 1 :] ^ p[i]) <= most).tolist():
            a, b = find(i), find(i + 1 + j)
            root[max(a, b)] = min(a, b)
    low = {}
    for i, x in enumerate(ids):
        r = find(i)
        if x is not None:
            low[r] = min(low.get(r, x), x)
    return [low.get(find(i)) for i in range(n)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def nearest(ids, vectors, every=20, k=20):
    """{query: [(vec_id, score)]} by scoring everything."""
    out = {}
    v = np.array(vectors, np.float64)
    for i, q in enumerate(ids):
        if q % every == 0:
            scores = (v * v[i]).sum(axis=1)
            order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-scores[j], ids[j]))[:k]
            out[q] = [(ids[j], float(scores[j])) for j in order]
    return out
