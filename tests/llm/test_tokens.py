"""Encoding, packing, token files and Huffman files against the tokenizers library."""

from __future__ import annotations

import hashlib
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def texts():
    random = np.random.default_rng(4)
    noise = ["".join(random.choice(list(" \n\tab'1é日 !.<|")) for _ in range(60)) for _ in range(120)]
    prose = [" ".join(f"{a}{b}" for a, b in zip(random.choice(["un", "the", "Ré", "x"], k), random.choice(["ing.", "able", "tion,", "ß"], k))) for k in (3, 40, 700, 4000)]
    return brute.ODD_TEXTS + noise + prose


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(1000 - i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, start long, n_tokens string").repartition(3)


@pytest.fixture(scope="module")
def ids(library, texts):
    return {1000 - i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_bpe(library, docs, texts, ids):
    from tracelight.llm.bpe import encode_decode

    rows = encode_decode(docs, with_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = ids[r.doc_id]
        decoded = library.decode(want, skip_special_tokens=False)
        assert (r.ids, r.n_tokens, r.decoded) == (want, len(want), decoded)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert encode_decode(docs.limit(0)).count() == 0


def test_store_starts_afresh(library, texts):
    from tracelight.llm.bpe import RankEncoder
    from tracelight.llm.tokens import LibraryEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    for encoder in (LibraryEncoder(path, max_pieces=20), RankEncoder(path, max_chars=50), LibraryEncoder(path, special_as_text=True)):
        library.encode_special_tokens = encoder.added == [] and isinstance(encoder, LibraryEncoder)
        for at in range(0, len(texts), 7):
            flat, counts = encoder.encode(texts[at : at + 7])
            want = [library.encode(t or "", add_special_tokens=False).ids for t in texts[at : at + 7]]
            assert counts.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    library.encode_special_tokens = False


def test_packing(spark, docs, ids):
    from tracelight.llm.packing import pack_documents

    rows = pack_documents(docs, buffer_tokens=3000, with_ids=True).collect()
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == brute.crc(r.ids) and r.length == len(r.ids) > 0
    for name, want in ids.items():
        at = 0
        for r in sorted(pieces[name], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want) + 1 and r.ids == (want + [1])[at : at + r.length]
            at += r.length
        assert at == len(want) + 1
    steps = {}
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == w[0].sequence_length <= 2048 and at & (at - 1) == 0
        steps[w[0].step_group] = steps.get(w[0].step_group, 0) + at
    assert max(steps.values()) <= 8 * 2048
    assert pack_documents(docs.limit(0)).count() == 0
    assert len(pack_documents(spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")).collect()) >= 3


def test_token_counts(spark, docs, library, texts):
    from tracelight.llm.token_scan import document_tokens

    library.encode_special_tokens = True
    want = sorted((1000 - i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    library.encode_special_tokens = False
    for block in (64, 1 << 20):
        assert sorted((r.doc_id, r.n_tokens) for r in document_tokens(docs, block_tokens=block).collect()) == want
    assert document_tokens(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tail", [[], [5, 6]])
def test_separator_scan(spark, tmp_path, tail):
    from tracelight.llm.token_scan import scan_separators

    random = np.random.default_rng(1)
    sizes = [0, 0, 1, 37, 0, 500, 3]
    data = [x for n in sizes for x in [*random.integers(1, 9, n).tolist(), 0]] + tail
    np.array(data, "<u4").tofile(tmp_path / "a.bin")
    (tmp_path / "empty.bin").touch()
    files = spark.createDataFrame([(str(tmp_path / "a.bin"), len(data)), (str(tmp_path / "empty.bin"), 0)], "file string, tokens long")
    want, at = [], 0
    for i, n in enumerate(sizes + ([len(tail)] if tail else [])):
        want.append((i, at, n))
        at += n + 1
    for block in (1, 7, 64, 4096):
        got = scan_separators(files, str(tmp_path), end_id=0, id_bytes=4, block_tokens=block).collect()
        assert sorted((r.document, r.start, r.n_tokens) for r in got) == want


def test_huffman_files(docs, ids):
    from tracelight.llm.common import shared_folder
    from tracelight.llm.huffman import read_coded, write_coded

    folder = shared_folder(docs.sparkSession)
    blocks, lengths = write_coded(docs, folder, files=3, block_ids=500)
    assert blocks.count() > 3
    at = 0
    for r in sorted(read_coded(blocks, lengths, folder, with_ids=True).collect(), key=lambda r: r.doc_id):
        want = ids[r.doc_id] + [0]
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(want), brute.crc(want), want)
        at += len(want)
    order = [i for b in sorted(blocks.collect(), key=lambda b: (b.part, b.block)) for i in b.doc_ids]
    assert order == sorted(order)
    blocks, lengths = write_coded(docs.limit(0), folder)
    assert read_coded(blocks, lengths, folder).count() == 0


def test_code_lengths_and_blocks():
    import heapq

    from tracelight.llm.huffman import HuffmanCodec, code_lengths

    random = np.random.default_rng(6)
    for n in (1, 2, 3, 50, 400):
        counts = np.zeros(600, np.int64)
        counts[random.choice(600, n, replace=False)] = (random.pareto(0.5, n) * 3 + 1).astype(np.int64)
        lengths = code_lengths(counts, 30)
        heap = [int(c) for c in counts if c]
        heapq.heapify(heap)
        cost = 0 if n > 1 else heap[0]
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        if lengths.max() < 30:
            assert int((counts * lengths).sum()) == cost
        short = code_lengths(counts, 10)
        assert short.max() <= 10 and sum(2.0 ** -int(x) for x in short if x) <= 1
        codec = HuffmanCodec(short)
        some = np.flatnonzero(counts)
        for size in (0, 1, 255, 256, 257, 5000):
            ids = random.choice(some, size)
            sizes = np.array([size]) if size else np.array([0])
            got, documents = codec.decode_block(codec.encode_block(ids, sizes))
            assert got.tolist() == ids.tolist() and documents.tolist() == sizes.tolist()


def test_ids_beyond_16_bits_are_refused(spark, tmp_path):
    from tracelight.llm import huffman, token_files

    assert token_files.narrow(np.array([0, 65535], np.int64)).tolist() == [0, 65535]
    for bad in (65536, -1):
        with pytest.raises(ValueError):
            token_files.narrow(np.array([0, bad], np.int64))
    with pytest.raises(ValueError):
        huffman.write_coded(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(tmp_path), end_id=65536)
