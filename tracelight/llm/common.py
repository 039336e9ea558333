"""What the training-data operators share: written tables, text blocks, ragged arrays, carried columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.session import ensure_checkpoint_dir

# The characters that separate words: space and the five ASCII line and tab controls. Fixed values.
WORD_BREAKS = "[\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder beneath the checkpoint folder, which driver and executors all reach."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tracelight-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe from lost executors, cut from its lineage."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables and byte files of one job in a folder of its own, which goes when the job ends; what is to stay is ``written``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.tables = spark, shared_folder(spark), 0

    def table(self, df: DataFrame) -> DataFrame:
        """``df`` as a Parquet table, like ``written``."""
        path = f"{self.base}/t{self.tables}"
        self.tables += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self) -> str:
        """Folder for byte files of tasks."""
        return f"{self.base}/files"

    def clear(self) -> None:
        fs, path = file_system(self.base)
        if fs.get_file_info(path).type.name == "Directory":
            fs.delete_dir(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    parts = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), WORD_BREAKS)
    return F.filter(parts, lambda w: w != "")


def byte_words(text: str | None) -> list[bytes]:
    """The same words as bytes: ``bytes.split`` breaks at exactly those six characters, none of which occurs inside a UTF-8 sequence."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def carried(df: DataFrame, carry: Iterable[str], taken: Iterable[str]) -> list[str]:
    """Columns of ``df`` to pass through; a column named like a result gives way to the result."""
    gone = set(taken)
    return [c for c in carry if c in df.columns and c not in gone]


def slices(texts: list, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``most`` characters each (one text at least), to bound what is in memory."""
    at = total = 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if i > at and total + size > most:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(texts):
        yield at, len(texts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of runs given by start and length, one run after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batches(columns: dict[str, list | np.ndarray | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def local_path(uri: str) -> str | None:
    """Path of a ``file:`` URI or plain path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def file_system(uri: str):
    """(file system, path) of a shared folder, for byte files that tasks write and read in ranges."""
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)
