"""Static inspection of file content: type, entropy, script signals, score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.functions import assess
from tracelight.functions.values import contains_any, holds
from tracelight.operators.findings import base_finding

# Extensions, name markers, code markers and weights.
HIGH_RISK_EXTENSIONS = ["php", "phtml", "phar", "jsp", "jspx", "asp", "aspx", "ashx", "asmx", "war", "jar", "js", "py", "pl", "sh",
                        "bat", "cmd", "ps1"]
COVER_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "txt", "pdf", "ico", "css"]
NAME_MARKERS = ["shell", "cmd", "command", "backdoor", "webshell", "upload", "cache", "image", "avatar"]
DYNAMIC_CALLS = ["eval", "assert", "create_function", "frombase64string"]
COMMAND_WORDS = ["runtime.getruntime().exec", "new processbuilder", "process.start(", "cmd.exe", "powershell", "/bin/sh", "/bin/bash"]
COMMAND_CALLS = ["system", "shell_exec", "passthru", "proc_open", "popen", "exec"]
REFLECTION_WORDS = ["class.forname", ".getmethod(", ".invoke(", "reflectionclass", "system.reflection", "assembly.load"]
INPUT_WORDS = ["$_get", "$_post", "$_request", "request.getparameter", "request.querystring", "request.form", "request["]
EVAL_MODIFIER = r"""preg_replace\s*\(\s*['"][^'"]*/e"""
WEIGHTS = {
    "high_risk_extension": 20, "double_extension": 20, "magic_mismatch": 25, "recent_change": 10, "high_entropy": 10,
    "long_base64": 15, "dynamic_execution": 25, "command_execution": 25, "reflection": 15, "http_param_bridge": 20,
    "suspicious_filename": 10, "small_file_high_risk": 10,
}
SMALL_FILE, LONG_BASE64, HIGH_ENTROPY, HIGH_LINE_ENTROPY, LINE_MINIMUM = 4096, 120, 7.2, 5.7, 40


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension without the dot; empty when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def is_high_risk_extension(ext: Column) -> Column:
    return F.lower(F.ltrim(ext, F.lit("."))).isin(*HIGH_RISK_EXTENSIONS)


def has_double_extension(path: Column) -> Column:
    parts = F.split(file_name(path), r"\.")
    return (F.size(parts) >= 3) & is_high_risk_extension(F.element_at(parts, -1)) & F.lower(F.try_element_at(parts, F.lit(-2))).isin(*COVER_EXTENSIONS)


def magic_type(content: Column) -> Column:
    """Content type from the leading bytes."""
    head = F.hex(F.substring(content, 1, 8))
    words = F.upper(F.regexp_extract(F.make_valid_utf8(F.substring(content, 1, 4096).cast("string")), r"^[ \t\r\n\f]*(?s)(.{0,16})", 1))
    is_text = F.is_valid_utf8(content.cast("string"))
    control = F.length(F.regexp_replace(F.hex(F.substring(content, 1, 4096)), r"(?:0[0-8BCEF]|1[0-9A-F]|7F)|(..)", "$1"))
    sample = F.least(F.octet_length(content), F.lit(4096))
    texty = ((sample * 2 - control) / 2 * 100 / sample) < 5
    return (
        F.when(F.octet_length(content) == 0, "empty").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif").when(head.startswith("255044462D"), "pdf")
        .when(head.startswith("504B0304") | head.startswith("504B0506"), "zip_archive").when(words.startswith("<?PHP"), "php_script")
        .when(words.startswith("<!DOCTYPE HTML") | words.startswith("<HTML"), "html").when(words.startswith("<?XML"), "xml")
        .when((words.startswith("{") | words.startswith("[")) & is_text, "json").when(is_text | texty, "text").otherwise("binary")
    )


def extension_mismatch(ext: Column, magic: Column) -> Column:
    return (
        F.when(ext.isin("jpg", "jpeg", "png", "gif", "ico", "webp"), ~magic.isin("jpeg", "png", "gif"))
        .when(ext.isin("zip", "jar", "war"), magic != "zip_archive").when(ext == "pdf", magic != "pdf").otherwise(False)
    )


def _call(lowered: Column, names: list[str]) -> Column:
    """A call of one of the names that is not the tail of a longer identifier."""
    return lowered.rlike(r"(?<![a-z0-9_])(" + "|".join(names) + r")\(")


def script_signals(path: Column, text: Column) -> Column:
    """Struct of the five script signals."""
    lowered = F.lower(text)
    dynamic = holds(lowered.contains("scriptenginemanager") | _call(lowered, DYNAMIC_CALLS) | lowered.rlike(EVAL_MODIFIER))
    command = contains_any(text, COMMAND_WORDS) | holds(_call(lowered, COMMAND_CALLS))
    reflection = contains_any(text, REFLECTION_WORDS)
    return F.struct(
        dynamic.alias("dynamic_execution"), command.alias("command_execution"), reflection.alias("reflection"),
        (contains_any(text, INPUT_WORDS) & (dynamic | command | reflection)).alias("http_param_bridge"),
        contains_any(file_name(path), NAME_MARKERS).alias("suspicious_filename"),
    )


def _entropy(data: np.ndarray) -> float:
    if data.size == 0:
        return 0.0
    counts = np.bincount(data, minlength=256)
    p = counts[counts > 0] / data.size
    return float(-(p * np.log2(p)).sum())


_BASE64 = np.zeros(256, dtype=bool)
_BASE64[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="]] = True


def _longest_run(mask: np.ndarray) -> int:
    if not mask.any():
        return 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max())


def measure(content: bytes) -> tuple[float, float, int]:
    data = np.frombuffer(content, dtype=np.uint8)
    cuts = np.flatnonzero((data == 10) | (data == 13))
    starts, ends = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [data.size]))
    lines = [data[a:b] for a, b in zip(starts, ends) if b - a >= LINE_MINIMUM]
    return _entropy(data), max((_entropy(x) for x in lines), default=0.0), _longest_run(_BASE64[data])


_MEASURES = T.StructType([
    T.StructField("entropy", T.DoubleType()), T.StructField("max_line_entropy", T.DoubleType()), T.StructField("base64_run", T.IntegerType()),
])


@F.pandas_udf(_MEASURES)
def content_measures(content: pd.Series) -> pd.DataFrame:
    """Byte entropy, highest line entropy (lines of 40 bytes or more) and longest base64 run."""
    rows = [measure(bytes(c)) if c is not None else (None, None, None) for c in content]
    return pd.DataFrame(rows, columns=["entropy", "max_line_entropy", "base64_run"])


def inspect_files(files: DataFrame, recent: Column | None = None) -> DataFrame:
    """``files(path, content, …)`` with type, measures, signals, score and reasons.

    Text signals read the whole content; bytes that are not UTF-8 are replaced and hide nothing else.
    """
    c = F.col
    text = F.make_valid_utf8(c("content").cast("string"))
    staged = (
        files.withColumn("extension", extension(c("path"))).withColumn("magic_type", magic_type(c("content")))
        .withColumn("_m", content_measures(c("content"))).withColumn("_s", script_signals(c("path"), text))
        .withColumn("sha256", F.sha2("content", 256)).withColumn("size_bytes", F.octet_length("content").cast("long"))
    )
    risky_code = c("_s.dynamic_execution") | c("_s.command_execution") | c("_s.http_param_bridge")
    signals = {
        "high_risk_extension": is_high_risk_extension(c("extension")), "double_extension": has_double_extension(c("path")),
        "magic_mismatch": extension_mismatch(c("extension"), c("magic_type")), "recent_change": F.lit(False) if recent is None else holds(recent),
        "high_entropy": (c("_m.entropy") >= HIGH_ENTROPY) | (c("_m.max_line_entropy") >= HIGH_LINE_ENTROPY),
        "long_base64": c("_m.base64_run") >= LONG_BASE64, **{n: c(f"_s.{n}") for n in ("dynamic_execution", "command_execution", "reflection", "http_param_bridge", "suspicious_filename")},
        "small_file_high_risk": (c("size_bytes") <= SMALL_FILE) & risky_code,
    }
    flagged = staged.select(
        *files.columns, "extension", "magic_type", "sha256", "size_bytes", c("_m.entropy").alias("entropy"),
        c("_m.max_line_entropy").alias("max_line_entropy"), c("_m.base64_run").alias("long_base64_run"),
        *[holds(v).alias(n) for n, v in signals.items()],
    )
    score = sum((F.when(c(n), w).otherwise(0) for n, w in WEIGHTS.items()), F.lit(0))
    reason = F.array_join(F.array_compact(F.array(*[F.when(c(n), F.lit(n)) for n in WEIGHTS])), ";")
    return flagged.withColumn("score", F.least(score, F.lit(100)).cast("int")).withColumn("reason", F.when(reason == "", "static_inventory").otherwise(reason))


def suspicious_files(inspected: DataFrame) -> DataFrame:
    """Files with any indicator other than a recent change."""
    named = [n for n in WEIGHTS if n != "recent_change"]
    keep = F.lit(False)
    for n in named:
        keep = keep | F.col(n)
    return inspected.where(keep | (F.col("score") >= 50)).withColumn("severity", assess.severity(F.col("score")))


def webshell_findings(inspected: DataFrame) -> DataFrame:
    """Findings of files scoring 50 or more."""
    c = F.col
    hits = inspected.where("score >= 50")
    summary = F.concat(F.lit("Content shows "), c("reason"), F.lit(" in "), c("path"), F.lit(" with sha256 "), c("sha256"),
                       F.lit(". Read the file before deciding."))
    extra = {"timestamp": F.when(c("modified_at") != "unknown", c("modified_at"))} if "modified_at" in inspected.columns else {}
    return hits.select(*base_finding(
        c("score"), "webshell_static", "FILE-WEBSHELL-STATIC-001", "File content looks like a web shell", "file", "Q1",
        "Q1 direct file evidence from content signals and file hash", "base_rule_score", summary,
        "Review content, deployment history and upload logs of the file.", source_file=c("path"), raw_hash=c("sha256"), **extra,
    ))
