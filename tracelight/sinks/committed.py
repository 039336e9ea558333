"""Result files that count only once a whole job has committed.

A Python data source writer in two phases. Every task writes one file of its own, under a name of its own, and reports
name, rows, bytes and checksum; the reports of the tasks that Spark accepted reach ``commit``, which writes the list of files
in one step: to a new name, then moved over the old one. A file of a failed, repeated or aborted attempt is never listed.
Readers go by the list, in the order of the partitions, so sorted text parts form one document.

The list has one entry for each task, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tracelight.sources.ranges import opened

MANIFEST = "_manifest.json"


@dataclass
class Part(WriterCommitMessage):
    partition: int
    file: str
    rows: int
    size: int
    sha256: str


class LineWriter(DataSourceArrowWriter):
    """Writes the one column of a frame: text as lines, bytes as they are."""

    def __init__(self, path: str, overwrite: bool, suffix: str):
        self.path, self.overwrite, self.suffix, self.job = path.rstrip("/"), overwrite, suffix, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        number = context.partitionId() if context else 0
        system, inner = opened(self.path)
        system.create_dir(inner, recursive=True)
        # the attempt is part of the name: two attempts of a task never write one file
        name = f"part-{number:06d}-{uuid.uuid4().hex}{self.suffix}"
        digest, rows, size = hashlib.sha256(), 0, 0
        out = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            values = batch.column(0).to_pylist()
            data = b"".join(values) if pa.types.is_binary(batch.schema.field(0).type) else "".join(f"{line}\n" for line in values).encode("utf-8")
            out = out or system.open_output_stream(f"{inner}/{name}")
            out.write(data)
            digest.update(data)
            rows, size = rows + batch.num_rows, size + len(data)
        if out is None:
            return Part(number, "", 0, 0, "")
        out.close()
        return Part(number, name, rows, size, digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        system, inner = opened(self.path)
        system.create_dir(inner, recursive=True)
        before = read_manifest(self.path)
        new = [{"file": m.file, "rows": m.rows, "size_bytes": m.size, "sha256": m.sha256} for m in sorted((m for m in messages if m and m.rows), key=lambda m: m.partition)]
        kept = [] if self.overwrite else before["files"]
        files = kept + new
        text = json.dumps({"job": self.job, "files": files, "rows": sum(f["rows"] for f in files)}, indent=0)
        fresh = f"{inner}/_{self.job}.json"
        with system.open_output_stream(fresh) as out:
            out.write(text.encode())
        system.move(fresh, f"{inner}/{MANIFEST}")  # the second phase: from here on the new files count
        if self.overwrite:
            for f in before["files"]:
                _delete(system, f"{inner}/{f['file']}")

    def abort(self, messages: list[Part | None]) -> None:
        system, inner = opened(self.path)
        for m in messages:
            if m and m.file:
                _delete(system, f"{inner}/{m.file}")


def _delete(system: fs.FileSystem, path: str) -> None:
    if system.get_file_info(path).type == fs.FileType.File:
        system.delete_file(path)


class CommittedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed_lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"], overwrite, self.options.get("suffix", ".txt"))


def write_lines(df: DataFrame, path: str, suffix: str = ".txt", append: bool = False) -> None:
    """The column ``value`` of ``df`` in committed files, one for each partition that has rows, in partition order.

    Text becomes lines and holds no line ends itself, null being an empty line; bytes are joined without anything between.
    """
    df.sparkSession.dataSource.register(CommittedLines)
    df.where(F.col("value").isNotNull() | F.lit(df.schema["value"].dataType.typeName() == "string")).select(F.coalesce("value", F.lit("").cast(df.schema["value"].dataType)).alias("value")).write.format("committed_lines").mode("append" if append else "overwrite").option("suffix", suffix).save(path)


def read_manifest(path: str) -> dict:
    """The list of committed files; an empty one where nothing was committed."""
    system, inner = opened(path.rstrip("/"))
    if system.get_file_info(f"{inner}/{MANIFEST}").type != fs.FileType.File:
        return {"job": None, "files": [], "rows": 0}
    with system.open_input_stream(f"{inner}/{MANIFEST}") as file:
        return json.loads(file.read())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of the committed files alone."""
    files = [f"{path.rstrip('/')}/{f['file']}" for f in read_manifest(path)["files"]]
    return spark.read.option("lineSep", "\n").text(files) if files else spark.createDataFrame([], "value string")


def unlisted_files(path: str) -> list[str]:
    """Part files that no commit lists: what failed attempts left, free to be deleted when no job writes there."""
    system, inner = opened(path.rstrip("/"))
    listed = {f["file"] for f in read_manifest(path)["files"]}
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("part-") and f.base_name not in listed)


def committed_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, rows, size_bytes, sha256`` of the committed files, from the list, without reading them."""
    rows = [(f"{path.rstrip('/')}/{f['file']}", f["rows"], f["size_bytes"], f["sha256"]) for f in read_manifest(path)["files"]]
    return spark.createDataFrame(rows, "path string, rows long, size_bytes long, sha256 string")


def json_line(df: DataFrame) -> Column:
    """A row as one JSON line; nulls stay."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    write_lines(df.select(json_line(df).alias("value")), path, ".json", append)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows written by ``write_jsonl``."""
    return read_lines(spark, path).select(F.from_json("value", schema).alias("_r")).select("_r.*")

