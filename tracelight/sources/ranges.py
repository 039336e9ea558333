"""Files read by byte ranges: chunks, fixed-size records and terminated records of files of any size.

A Python data source whose tasks read ranges of bytes. A large file is many tasks and many small files are one; small ranges
of a file share a task, too, and are counted apart in it. No row holds a whole file, so there is no 2 GiB ceiling. A record belongs to the range in which it starts and is read on beyond the
range's end. Conditions on ``path``, ``name`` and ``size`` are taken over by the source and prune files before any is opened.

Files are reached through Arrow's file systems (local, HDFS and object stores that it knows).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith,
    StringStartsWith,
)

from tracelight.functions.frames import joined_narrow

RANGE_BYTES = 64 << 20
CHUNK_BYTES = 4 << 20
_BUFFER = 1 << 20
_BEYOND = 4 << 10  # first step beyond a range's end, doubled with each further one
SCHEMA = "path string, name string, size long, modified_at timestamp, range_start long, offset long, lines_before long, content binary"

_TESTS: dict[type, Callable[[object, object], bool]] = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x, StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v,
}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a URI or a local path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """Pieces ``(path, size, modified, start, end)`` that one task reads one after the other; a piece is one range or several."""

    pieces: list[tuple[str, int, float, int, int]]


def cut(files: Iterable[tuple[str, int, float]], range_bytes: int, align: int = 1) -> list[list[tuple[str, int, float, int, int]]]:
    """Ranges of at most ``range_bytes``, borders at multiples of ``align``; small files share a task."""
    step = max(align, range_bytes - range_bytes % align)
    out: list[list[tuple[str, int, float, int, int]]] = []
    held, total = [], 0
    for path, size, modified in files:
        for start in range(0, size, step):
            piece = (path, size, modified, start, min(size, start + step))
            # opening a file counts as well, so that a task has a bounded number of them
            cost = piece[4] - start + (64 << 10)
            if held and total + cost > range_bytes + (64 << 10):
                out.append(held)
                held, total = [], 0
            held.append(piece)
            total += cost
    return out + [held] if held else out


def has_border(text: bytes) -> bool:
    """Whether occurrences of ``text`` can overlap each other, so that where they lie depends on where reading starts."""
    return any(text[:k] == text[-k:] for k in range(1, len(text)))


class RangeReader(DataSourceReader):
    """``mode`` is chunks (with ``overlap`` bytes of what follows), records (of ``record`` bytes), terminated (by ``terminator``) or newlines (a count per range)."""

    def __init__(self, options: dict[str, str]):
        self.paths = options["paths"].split("\n")
        self.mode = options.get("mode", "chunks")
        self.chunk, self.overlap, self.record = (int(options.get(k, d)) for k, d in (("chunk", CHUNK_BYTES), ("overlap", 0), ("record", 1)))
        self.terminator = bytes.fromhex(options.get("terminator", ""))
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.tasks = int(options.get("tasks", 0))  # ranges share tasks as long as there are that many; 0: each is its own
        align = {"chunks": self.chunk, "records": self.record}.get(self.mode, 1)
        self.step = max(align, self.range_bytes - self.range_bytes % align)
        self.pattern = options.get("namepattern", options.get("namePattern"))
        self.filters: list[tuple[type, str, object]] = []
        if self.mode == "terminated" and (not self.terminator or has_border(self.terminator)):
            raise ValueError("a terminator must not be empty or overlap itself")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            known = getattr(f, "attribute", None) in (("path",), ("name",), ("size",))
            if known and type(f) in _TESTS:
                self.filters.append((type(f), f.attribute[0], f.value))
            elif not known or not isinstance(f, IsNotNull):  # these three are never null
                yield f

    def _files(self) -> Iterator[tuple[str, int, float]]:
        for path in self.paths:
            system, inner = opened(path)
            info = system.get_file_info(inner)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
            found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
            for f in sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path):
                hidden = any(part[:1] in ("_", ".") for part in f.path[len(inner) :].split("/") if part)
                values = {"path": prefix + f.path, "name": f.base_name, "size": f.size}
                named = self.pattern is None or re.search(self.pattern, f.base_name.lower())
                if f.size and not hidden and named and all(_TESTS[t](values[a], x) for t, a, x in self.filters):
                    yield prefix + f.path, f.size, f.mtime.timestamp() if f.mtime else 0.0

    def partitions(self) -> Sequence[InputPartition]:
        files = list(self._files())
        share = min(RANGE_BYTES, sum(size for _, size, _ in files) // self.tasks) if self.tasks else 0
        run = self.step * max(1, share // self.step)  # whole ranges
        return [Range(pieces) for pieces in cut(files, run, self.step)] or [Range([])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for path, size, modified, first, last in partition.pieces:
            system, inner = opened(path)
            with system.open_input_file(inner) as file:
                for start in range(first, last, self.step):
                    for offset, lines, content in getattr(self, f"_{self.mode}")(file, size, start, min(last, start + self.step)):
                        rows.append((path, path.rsplit("/", 1)[-1], size, int(modified * 1_000_000), start, offset, lines, content))
                        held += len(content)
                        if held >= _BUFFER or len(rows) >= 4096:
                            yield _batch(rows)
                            rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _chunks(self, file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
        for at in range(start, end, self.chunk):
            yield at, 0, file.read_at(min(self.chunk + self.overlap, size - at), at)

    def _records(self, file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
        step = max(self.record, _BUFFER - _BUFFER % self.record)
        for at in range(start, end, step):
            data = file.read_at(min(step, end - at), at)
            for k in range(0, len(data) - self.record + 1, self.record):  # a partial record at the end of the file is left out
                yield at + k, 0, data[k : k + self.record]

    def _newlines(self, file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
        yield start, sum(file.read_at(min(_BUFFER, end - at), at).count(b"\n") for at in range(start, end, _BUFFER)), b""

    def _terminated(self, file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
        """Records that start in the range, without their terminator, and the line ends between the range's start and theirs."""
        mark = self.terminator
        # a record starts at 0 and behind every terminator; the first look-back finds one that ends at the range's start
        base = max(0, start - len(mark))
        data, at, lines, beyond = bytearray(), base, 0, _BEYOND
        begin = 0 if not start else None

        def more() -> bool:
            nonlocal at, beyond
            if at >= end:
                beyond *= 2
            piece = file.read_at(min(_BUFFER, max(end - at, beyond // 2), size - at), at)
            at += len(piece)
            data.extend(piece)
            return bool(piece)

        seen = 0  # where the search for the next terminator goes on
        while True:
            found = data.find(mark, seen)
            if found < 0:
                seen = max(0 if begin is None else begin, len(data) - len(mark) + 1, seen)
                if begin is None and base + seen >= end:
                    return
                if not more():
                    if begin is not None and begin < len(data):
                        yield base + begin, lines, bytes(data[begin:])
                    return
                continue
            behind = found + len(mark)
            if begin is not None:
                yield base + begin, lines, bytes(data[begin:found])
            lines += data.count(b"\n", max(begin if begin is not None else start - base, 0), behind)
            begin = behind
            if base + begin >= end:
                return
            if begin > _BUFFER:  # what has been read goes
                del data[:begin]
                base, begin, behind = base + begin, 0, 0
            seen = begin


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)


class ByteRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))


def _read(spark: SparkSession, paths: str | Sequence[str], mode: str, **options: object) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    given = {k: str(v) for k, v in options.items() if v is not None} | {"tasks": str(2 * spark.sparkContext.defaultParallelism)}
    return spark.read.format("byte_ranges").options(paths=paths if isinstance(paths, str) else "\n".join(paths), mode=mode, **given).load()


def read_chunks(spark: SparkSession, paths: str | Sequence[str], chunk: int = CHUNK_BYTES, overlap: int = 0, range_bytes: int = RANGE_BYTES, name_pattern: str | None = None) -> DataFrame:
    """``path, name, size, modified_at, offset, content``: consecutive chunks of every file, each with ``overlap`` bytes of the next."""
    return _read(spark, paths, "chunks", chunk=chunk, overlap=overlap, rangeBytes=range_bytes, namePattern=name_pattern).drop("range_start", "lines_before")


def read_records(spark: SparkSession, paths: str | Sequence[str], size: int, range_bytes: int = RANGE_BYTES, name_pattern: str | None = None) -> DataFrame:
    """``path, name, record_no, content``: records of a fixed number of bytes; a partial one at the end is left out."""
    found = _read(spark, paths, "records", record=size, rangeBytes=range_bytes, namePattern=name_pattern)
    return found.select("path", "name", F.expr(f"offset div {size}").alias("record_no"), "content")


def read_terminated_bytes(spark: SparkSession, paths: str | Sequence[str], terminator: bytes, range_bytes: int = RANGE_BYTES, name_pattern: str | None = None,
                          parts: bool = False) -> DataFrame:
    """``path, name, size, offset, start_line, content``: records ended by ``terminator``, which they do not hold; an unended tail is one too.

    ``start_line`` counts the line ends before a record. A file that is one range counts by itself; of larger files, one
    row for each range is summed over the earlier ranges and joined back, no content is moved. With ``parts`` the files of a
    folder are one file, cut behind line ends in the order of their names, and ``start_line`` counts through all of them.
    """
    options = {"terminator": terminator.hex(), "rangeBytes": range_bytes, "namePattern": name_pattern}
    counts = _read(spark, paths, "newlines", **options)
    counts = counts if parts else counts.where(F.col("size") > range_bytes)  # files of one range are pruned
    whole = F.regexp_replace("path", "/[^/]*$", "") if parts else F.col("path")
    earlier = W.partitionBy(whole).orderBy("path", "range_start").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("path", "range_start", F.sum("lines_before").over(earlier).alias("_before")).where("_before is not null")
    joined, _ = joined_narrow(_read(spark, paths, "terminated", **options), before, ["path", "range_start"])
    return joined.select("path", "name", "size", "offset", (F.col("lines_before") + F.coalesce("_before", F.lit(0)) + 1).alias("start_line"), "content")
