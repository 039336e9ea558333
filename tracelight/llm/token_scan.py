"""Token counts of documents in flat token files without an index, by a scan for separators.

Method. Files are little-endian unsigned 16-bit or 32-bit ids, one document after the other, each followed by the
end-of-document id. Files are cut into blocks of fixed bytes, read by many tasks at once. In a block all separators are
found by one vector comparison; documents that begin and end inside it are complete. Each block reports its separators
and the tokens before its first and after its last one. A prefix scan over the blocks of a file carries the number of
documents and the open tail across, so a document may span any number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelight.llm.common import shared_folder, slices, written
from tracelight.llm.token_files import TaskFile, narrow, read_range
from tracelight.llm.tokens import library_encoder, tokenizer_path

BLOCK_TOKENS = 1 << 20


def write_flat(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 50256) -> DataFrame:
    """Encode documents into flat files of 16-bit ids; returns ``file, tokens`` per file and ``doc_ids``, its documents in order.

    A special token's string inside a text is encoded as ordinary text, so the end id occurs at ends only. Null texts
    are empty. The result is a written table.
    """
    path = tokenizer or tokenizer_path()
    if end_id >= 1 << 16:
        raise ValueError("ids are 16-bit")
    schema = pa.schema([("file", pa.string()), ("tokens", pa.int64()), ("part", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, part = library_encoder(path, True), TaskFile(folder), 0
        for batch in parts:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                flat, counts = encoder.encode(texts[a:b])
                ends = np.cumsum(counts)
                out.write(np.insert(narrow(flat), ends, end_id).astype("<u2").tobytes())
                yield pa.RecordBatch.from_pydict({"file": [out.path], "tokens": [out.size // 2], "part": [part], "doc_ids": [ids[a:b]]}, schema=schema)
                part += 1
        out.close()

    return written(docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"`{text}` text").mapInArrow(run, "file string, tokens long, part long, doc_ids array<bigint>"))


def scan_separators(files: DataFrame, folder: str, end_id: int = 50256, id_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``file, document`` (from 0), ``start`` (first token in the file) and ``n_tokens`` (without the separator) of ``files(file, tokens)``.

    Tokens after the last separator are a last document without one. An empty file has no documents.
    """
    if id_bytes not in (2, 4):
        raise ValueError("ids are 2 or 4 bytes long")
    blocks = files.select("file", F.explode(F.expr(f"sequence(0, cast(greatest(tokens - 1, 0) div {block_tokens} as bigint))")).alias("block"), "tokens").where("tokens > 0")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for path, block, tokens in zip(*(batch.column(i).to_pylist() for i in range(3))):
                first = block * block_tokens
                data = np.frombuffer(read_range(folder, path, first * id_bytes, min(block_tokens, tokens - first) * id_bytes), f"<u{id_bytes}")
                at = np.flatnonzero(data == end_id) + first
                yield pa.RecordBatch.from_pydict({"file": [path], "block": [block], "first": [first], "stop": [first + len(data)], "ends": [at]}, schema=pa.schema(
                    [("file", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("stop", pa.int64()), ("ends", pa.list_(pa.int64()))]))

    # a stated number: these narrow rows stand for much work, and would be put into one task by their size
    tasks = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = written(blocks.repartition(tasks, "file", "block").mapInArrow(run, "file string, block long, first long, stop long, ends array<bigint>"))
    # the scan moves one narrow row per block: separators so far, and the last separator before the block
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carry = found.select("file", "block", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs"),
                         (F.coalesce(F.max(F.get("ends", F.size("ends") - 1)).over(before), F.lit(-1)) + 1).alias("open"),
                         (F.row_number().over(W.partitionBy("file").orderBy(F.desc("block"))) == 1).alias("last"))
    both = found.join(written(carry), ["file", "block"])
    starts = F.concat(F.array("open"), F.transform("ends", lambda e: e + 1))
    tail = F.when(F.col("last") & (F.element_at(starts, -1) < F.col("stop")), F.array("stop")).otherwise(F.expr("cast(array() as array<bigint>)"))
    pieces = both.select("file", "docs", F.posexplode(F.transform(F.concat("ends", tail), lambda e, i: F.struct(F.get(starts, i).alias("start"), e.alias("stop")))).alias("i", "d"))
    return pieces.select("file", (F.col("docs") + F.col("i")).alias("document"), F.col("d.start").alias("start"), (F.col("d.stop") - F.col("d.start")).alias("n_tokens"))


def document_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, n_tokens`` of all documents, counted in flat files written from them. Null and empty texts have 0 tokens; repeated rows stay."""
    folder = shared_folder(docs.sparkSession)
    files = write_flat(docs, folder, id_col, text, tokenizer)
    scanned = scan_separators(files.groupBy("file").agg(F.max("tokens").alias("tokens")), folder, block_tokens=block_tokens)
    # which document of a file has which id: the writer's lists, numbered through
    before = W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = files.select("file", "part", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0)).alias("base"))
    names = files.join(written(base), ["file", "part"]).select("file", "base", F.posexplode("doc_ids").alias("i", "doc_id")) \
        .select("file", (F.col("base") + F.col("i")).alias("document"), "doc_id")
    return written(names).join(written(scanned), ["file", "document"]).select("doc_id", "n_tokens")
