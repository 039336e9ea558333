"""Raw log lines with exact line numbers, read split by split."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tracelight.functions.frames import joined_narrow, settled
from tracelight.functions.text import redact, sha256_hex
from tracelight.schema import PARSE_ERROR, conform

LONG_LINE_BYTES = 1 << 20


@dataclass(frozen=True)
class Parsed:
    """Typed events and, beside them, the lines that could not be read (or only lossily)."""

    events: DataFrame
    rejects: DataFrame


def read_log_lines(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False,
                   name_pattern: str | None = None, parts: bool = False) -> DataFrame:
    """Non-blank lines of plain and gzip files, numbered from 1 within each file.

    Rows of one input split are contiguous, so a line number is the row's position in its split plus
    the lines of the file's earlier splits. Only one row per split is shuffled for that, counted once when
    this is called. ``_split`` stays with the lines, which lie as they were read: see ``operators.splits``.
    With ``parts`` the files of a folder are one log, cut in the order of their names, and the folder is its ``source_file``.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower())
    found = reader.text(list(paths) if not isinstance(paths, str) else paths)
    if name_pattern:  # before the row id, so that it prunes files
        found = found.where(F.lower(F.col("_metadata.file_name")).rlike(name_pattern))
    raw = found.select(
        F.col("value"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
    )
    splits = raw.groupBy("source_file", "_split").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    log = F.regexp_replace("source_file", "/[^/]*$", "") if parts else F.col("source_file")
    order = W.partitionBy(log).orderBy("source_file", "_split")
    offsets = splits.select(
        "source_file", "_split", "_first", F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        *([log.alias("_log"), F.row_number().over(order).cast("long").alias("_place")] if parts else []),
    )
    numbered, stayed = joined_narrow(raw, offsets, ["source_file", "_split"], "inner")
    if not stayed:
        numbered = numbered.sortWithinPartitions("source_file", "_split", "_row")
    if parts:
        numbered = numbered.drop("source_file", "_split").withColumnsRenamed({"_log": "source_file", "_place": "_split"})
    line = (F.col("_row") - F.col("_first") + F.col("_offset") + 1).alias("line_number")
    return decode_lines(numbered.select("source_file", line, "value", "_split"))


def decode_lines(raw: DataFrame) -> DataFrame:
    """Adds hash, length and damage flags to ``(source_file, line_number, value)`` and drops blank lines; lines are kept whole."""
    split = [c for c in ("_split",) if c in raw.columns]
    # rtrim keeps the raw bytes, which a regular expression would decode
    body = raw.select("source_file", "line_number", *split, F.rtrim(F.col("value"), F.lit("\r\n")).alias("_raw"))
    present = settled(body).where(F.col("_raw").rlike(r"[^\s\uFEFF]"))
    size = F.octet_length("_raw")
    staged = present.select("source_file", "line_number", *split, F.col("_raw").alias("_body"), (size > LONG_LINE_BYTES).alias("is_long"))
    sound = F.is_valid_utf8("_body")
    text = F.when(sound, F.col("_body")).otherwise(F.make_valid_utf8("_body"))
    return staged.select(
        "source_file", "line_number", F.when(text.startswith("\ufeff"), F.expr("substring(_body, 2)")).otherwise(text).alias("text"),
        sha256_hex(F.col("_body")).alias("raw_hash"), F.octet_length("_body").cast("long").alias("byte_len"),
        (~sound).alias("had_invalid_utf8"), "is_long", *split,
    )


def lines_from(df: DataFrame, text: Column, source_file: Column | str, line_number: Column) -> DataFrame:
    """Line table over text that is already in a frame (rendered or archived logs)."""
    name = F.lit(source_file) if isinstance(source_file, str) else source_file
    return decode_lines(df.select(name.alias("source_file"), line_number.cast("long").alias("line_number"), text.alias("value")))


# Which file names are read as which kind of log.
LOG_NAME_PATTERNS = {
    "http": r"(access|u_ex|request|nginx|httpd|apache|iis).*(\.log|\.txt|\.json|\.jsonl|\.gz)?",
    "db": r"(mysql|mariadb|postgres|pgaudit|mssql|sqlserver|errorlog|slow|general|db)",
    "waf": r"(waf|modsec|cloudflare|akamai|alb|firewall|cdn)",
    "app": r"(app|application|spring|django|flask|node|laravel|php|aspnet|stdout|error|gunicorn|uwsgi|pm2)",
}


def select_log_lines(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Lines of the files under ``root`` whose name marks them as logs of ``kind``."""
    return read_log_lines(spark, root, recursive=True, name_pattern=LOG_NAME_PATTERNS[kind])


def line_rejects(lines: DataFrame, parser: Column | str) -> DataFrame:
    """Warnings about damaged lines, which are still parsed."""
    name = F.lit(parser) if isinstance(parser, str) else parser
    problems = F.array_compact(F.array(
        F.when(F.col("is_long"), F.lit("line is longer than 1 MiB and was read whole")),
        F.when(F.col("had_invalid_utf8"), F.lit("bytes that are not UTF-8 were replaced")),
    ))
    return lines.withColumn("message", F.explode(problems)).withColumn("parser_name", name)


def parse_cases(lines: DataFrame, text: str, cases: Sequence[tuple[Column, Callable[[DataFrame], DataFrame]]],
                schema: StructType) -> DataFrame:
    """Parse every line by the first case whose condition holds, reading the lines once.

    A case adds the columns of ``schema`` it knows plus ``_error`` and, for lines it ignores, ``_skip``.
    It sees NULL text for lines of other cases, and only the chosen case is evaluated per line.
    """
    fields = [*schema.fields, StructField("_error", StringType()), StructField("_skip", BooleanType())]
    choice = None
    for index, (condition, _) in enumerate(cases):
        choice = F.when(condition, index) if choice is None else choice.when(condition, index)
    provenance = [c for c in lines.columns if c != text]
    df = lines.withColumn("_case", choice).withColumn("_whole", F.col(text))
    structs: list[str] = []
    for index, (_, parse) in enumerate(cases):
        masked = df.withColumn(text, F.when(F.col("_case") == index, F.col("_whole")))
        parsed = parse(masked)
        added = set(parsed.columns) - set(masked.columns)
        cells = [
            (F.col(f.name).cast(f.dataType) if f.name in added else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields
        ]
        # cells of other cases would be worked out from NULL text, field by field
        df = parsed.select(*df.columns, F.when(F.col("_case") == index, F.struct(*cells)).alias(f"_s{index}"))
        structs.append(f"_s{index}")
    chosen = None
    for index, name in enumerate(structs):
        chosen = F.when(F.col("_case") == index, F.col(name)) if chosen is None else chosen.when(F.col("_case") == index, F.col(name))
    taken = {f.name for f in fields}
    kept = [c for c in provenance if c not in taken]
    own = [F.col(c) for c in kept] + [F.col("_whole").alias(text)]
    # provenance columns that are also event columns (file, line) come from the line
    shared = [f.name for f in schema.fields if f.name in provenance and f.name != "raw_hash"]
    hashed = [F.col("raw_hash").alias("_line_hash")] if "raw_hash" in provenance else []
    flat = df.where(F.col("_case").isNotNull()).select(
        F.explode(F.array(F.struct(*own, *[F.col(c) for c in shared], *hashed, chosen.alias("_v")))).alias("_row")).select("_row.*")
    rest = [f"_v.{f.name}" for f in fields if f.name not in shared and f.name != "raw_hash"]
    return flat.select(*kept, text, *shared, *[c for c in ("_line_hash",) if hashed], *rest).where(~F.coalesce("_skip", F.lit(False))).drop("_skip")


def finish(staged: DataFrame, event_schema, error: str = "_error", parser: Column | str = "parser_name",
           redacted: Sequence[str] = (), redact_secrets: bool = False) -> Parsed:
    """Split parsed rows into events (no error) and rejects."""
    staged = settled(staged)
    events = conform(staged.where(F.col(error).isNull()), event_schema)
    if redact_secrets:
        for name in redacted:
            events = events.withColumn(name, redact(F.col(name)))
    parser_name = F.lit(parser) if isinstance(parser, str) and parser not in staged.columns else F.col(parser) if isinstance(parser, str) else parser
    failed = staged.where(F.col(error).isNotNull()).withColumn("message", F.col(error)).withColumn("_parser", parser_name)
    warned = line_rejects(staged, parser_name).withColumn("_parser", F.col("parser_name"))
    sample = F.substring("text", 1, 200)
    shape = lambda df: df.select(
        "source_file", "line_number", F.col("_parser").alias("parser_name"), "message", "_line_hash",
        (redact(sample) if redact_secrets else sample).alias("raw_sample"),
    )
    rejects = shape(failed).unionByName(shape(warned)).withColumnRenamed("_line_hash", "raw_hash")
    return Parsed(events, conform(rejects, PARSE_ERROR))
