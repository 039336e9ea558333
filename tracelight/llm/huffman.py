"""Token ids in files of canonical, length-limited Huffman codes.

Method. Global counts of all ids give code lengths of at most MAX_BITS by package-merge, and lengths alone fix the
canonical codes. Documents are put in ascending id order; each task writes one file of independent blocks. A block holds
whole documents, a list of their lengths, one bit stream, and a checkpoint of the bit offset at every LANE ids. Decoding
is table-driven: the next MAX_BITS bits index a table of symbol and length. All checkpoints of a block are decoded side
by side, one table step for all of them at a time.

Block layout, all little-endian: b"THB1", ids (u32), documents (u32), bit bytes (u32), code lengths' CRC-32 (u32),
ids of each document (u32 each), bit offset of each checkpoint (u32 each), bits (first bit highest), 8 zero bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelight.llm.common import shared_folder, slices, written
from tracelight.llm.token_files import TaskFile, narrow, read_range
from tracelight.llm.tokens import library_encoder, tokenizer_path

MAX_BITS = 18
LANE = 256
BLOCK_IDS = 1 << 20
MAGIC = b"THB1"


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal prefix code lengths of at most ``most`` bits (package-merge); 0 for ids that do not occur."""
    symbols = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(symbols) <= 1:
        out[symbols] = 1
        return out
    if len(symbols) > 1 << most:
        raise ValueError(f"{len(symbols)} ids need codes of more than {most} bits")
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    weights = counts[order].astype(np.int64)
    # level by level: the coins and the packages of the level before, sorted; only which of them are coins is kept
    merged, coins = weights, [np.ones(len(weights), bool)]
    for _ in range(most - 1):
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        coins.append(at < len(weights))
    take = 2 * (len(weights) - 1)
    lengths = np.zeros(len(weights), np.int64)
    for level in reversed(coins):
        n = int(level[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class HuffmanCodec:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.int64), canonical_codes(lengths).astype(np.uint64)
        self.bits = max(1, int(lengths.max()) if len(lengths) else 1)
        self.check = zlib.crc32(lengths.astype(np.uint8).tobytes())
        self.symbol, self.used = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.int64)
        for i in np.flatnonzero(lengths).tolist():
            free = self.bits - int(lengths[i])
            at = int(self.codes[i]) << free
            self.symbol[at : at + (1 << free)] = i
            self.used[at : at + (1 << free)] = lengths[i]

    def encode_block(self, ids: np.ndarray, sizes: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        starts = ends - n
        total = int(ends[-1]) if len(ends) else 0
        if total >= 1 << 32:
            raise ValueError("a block's bits do not fit 32-bit offsets")
        word, inside = starts >> 5, starts & 31
        # a code lies in two 32-bit words at most; sums are unions, for no two codes share a bit
        wide = self.codes[ids] << (64 - n - inside).astype(np.uint64)
        words = np.zeros(total // 32 + 2, np.uint64)
        for part, at in ((wide >> np.uint64(32), word), (wide & np.uint64(0xFFFFFFFF), word + 1)):
            if len(ids):
                first = np.flatnonzero(np.diff(at, prepend=-1))
                words[at[first]] += np.add.reduceat(part, first)
        stream = words.astype(">u4").tobytes()[: -(-total // 8)]
        return MAGIC + struct.pack("<IIII", len(ids), len(sizes), len(stream), self.check) + sizes.astype("<u4").tobytes() + starts[::LANE].astype("<u4").tobytes() + stream + bytes(8)

    def decode_block(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each document) of one block."""
        if data[:4] != MAGIC:
            raise ValueError("not a block")
        n, documents, size, check = struct.unpack_from("<IIII", data, 4)
        if check != self.check:
            raise ValueError("the block was coded with other code lengths")
        sizes = np.frombuffer(data, "<u4", documents, 20).astype(np.int64)
        lanes = -(-n // LANE)
        at = np.frombuffer(data, "<u4", lanes, 20 + 4 * documents).astype(np.int64)
        raw = np.frombuffer(data, np.uint8, size + 8, 20 + 4 * (documents + lanes)).astype(np.uint32)
        # the 32 bits from each byte on, so that one look-up gets any code
        window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        out = np.zeros((lanes, LANE), np.uint32)
        mask, last = np.uint32((1 << self.bits) - 1), len(window) - 1
        short = n - (lanes - 1) * LANE if lanes else 0
        for step in range(LANE if lanes else 0):
            if step == short:
                at = at[:-1]  # the last lane may be shorter
                if not len(at):
                    break
            seen = (window[np.minimum(at >> 3, last)] >> (np.uint32(32 - self.bits) - (at & 7).astype(np.uint32))) & mask
            out[: len(at), step] = self.symbol[seen]
            at = at + self.used[seen]
        return out.reshape(-1)[:n], sizes


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in ``ids`` (binary, little-endian 16-bit), over all rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in parts:
            for at in range(0, batch.num_rows, 1000):
                total += np.bincount(np.frombuffer(b"".join(batch.column(0).slice(at, 1000).to_pylist()), "<u2"), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])

    out = np.zeros(size, np.int64)
    # one row per id of the vocabulary
    for row in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def write_coded(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0,
                files: int | None = None, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, np.ndarray]:
    """Encode documents into coded files in ascending id order.

    Returns the written table of blocks (``part, block, file, offset, bytes, n_ids, doc_ids``) and the code lengths of
    all ids. Null texts are empty, so that only the end id stands for them; null ids come first; rows with equal ids are
    ordered by their ids' bytes. The part numbers ascend with the document ids.
    """
    path, spark = tokenizer or tokenizer_path(), docs.sparkSession
    size = 1 << 16
    if not 0 <= end_id < size:
        raise ValueError("ids are 16-bit")

    def tokens(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        for batch in parts:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts, 2_000_000):
                flat, counts = encoder.encode(texts[a:b])
                flat = np.insert(narrow(flat), np.cumsum(counts), end_id).astype("<u2")
                edges = np.concatenate([[0], np.cumsum(counts + 1)]).tolist()
                yield pa.RecordBatch.from_arrays([names.slice(a, b - a), pa.array([flat[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:])], pa.binary())], names=["doc_id", "ids"])

    encoded = written(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text}` text").mapInArrow(tokens, "doc_id long, ids binary"))
    codec = HuffmanCodec(lengths := code_lengths(count_ids(encoded, size)))
    parts = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])

    def write(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, part, block = TaskFile(folder), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, total
            data = codec.encode_block(np.concatenate(held).astype(np.int64), np.array([len(h) for h in held], np.int64))
            row = {"part": [part], "block": [block], "file": [out.path], "offset": [out.size], "bytes": [len(data)], "n_ids": [total], "doc_ids": [list(names)]}
            out.write(data)
            block, total = block + 1, 0
            names.clear()
            held.clear()
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches_in:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(raw.as_buffer(), "<u2")
                if held and total + len(ids) > block_ids:
                    yield flush()
                names.append(name)
                held.append(ids.copy())
                total += len(ids)
        if held:
            yield flush()
        out.close()

    ordered = encoded.repartitionByRange(parts, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"), "ids")
    blocks = written(ordered.mapInArrow(write, "part long, block long, file string, offset long, bytes long, n_ids long, doc_ids array<bigint>"))
    return blocks, lengths


def read_coded(blocks: DataFrame, lengths: np.ndarray, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document in the files.

    ``start`` counts the ids of all documents before it; the CRC-32 is of the ids as little-endian unsigned 32-bit integers.
    """
    # two narrow prefix sums: over the blocks of a file, and over files, of which there is one row each
    in_part = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    narrow = blocks.select("part", "block", "n_ids")
    parts = narrow.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    base = narrow.withColumn("inside", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0))).join(parts, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("base"))
    based = blocks.select("part", "block", "file", "offset", "bytes", "doc_ids").join(written(base), ["part", "block"])
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = HuffmanCodec(lengths)
        for batch in batches_in:
            for path, offset, size, names, start in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ids, sizes = codec.decode_block(read_range(folder, path, offset, size))
                ids, edges = ids.astype("<u4"), np.concatenate([[0], np.cumsum(sizes)])
                cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
                out = {"doc_id": names, "start": edges[:-1] + start, "n_tokens": sizes, "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in cuts]}
                if with_ids:
                    out["ids"] = [ids[a:b].tolist() for a, b in cuts]
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    # a stated number: these narrow rows stand for much work, and would be put into one task by their size
    tasks = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = based.select("file", "offset", "bytes", "doc_ids", "base").repartition(tasks, "file", "offset")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def coded_roundtrip(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write all documents as coded files and read them back; see ``write_coded`` and ``read_coded``."""
    folder = shared_folder(docs.sparkSession)
    blocks, lengths = write_coded(docs, folder, id_col, text, tokenizer)
    return read_coded(blocks, lengths, folder)
