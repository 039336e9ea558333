"""k failures of one source within a sliding window, and whether a success followed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions.times import instant, millis
from tracelight.operators.bands import band_sums
from tracelight.operators.findings import base_finding

WINDOW_MS = 600_000
THRESHOLD = 5


def brute_force(attempts: DataFrame, window: int = WINDOW_MS, threshold: int = THRESHOLD, chunk: int | None = None) -> DataFrame:
    """Sources whose failures reach ``threshold`` within ``window`` time units.

    ``attempts`` holds ``source, at (long, NULL when undated), failed (boolean)``. One row per source:
    trigger time, first failure in the window that triggered, whether a success lies within
    ``window`` after that failure, and the number of undated failures.
    """
    timed_failures = attempts.where(F.col("failed") & F.col("at").isNotNull())
    counts = band_sums(timed_failures, ["source"], "at", {"n": F.lit(1)}, before=window, after=0, chunk=chunk)
    triggers = counts.where(F.col("n") >= threshold).groupBy("source").agg(F.min("at").alias("trigger_at"))
    joined = attempts.join(triggers, "source")
    in_window = F.col("failed") & F.col("at").between(F.col("trigger_at") - window, F.col("trigger_at"))
    firsts = joined.groupBy("source", "trigger_at").agg(
        F.min(F.when(in_window, F.col("at"))).alias("first_failure_at"),
        F.sum(F.when(F.col("failed") & F.col("at").isNull(), 1).otherwise(0)).alias("untimed_failures"),
    )
    # a success can only count within [trigger - window, trigger + window]
    near = F.col("at").between(F.col("trigger_at") - window, F.col("trigger_at") + window)
    successes = joined.where(~F.col("failed") & near).select("source", F.col("at").alias("_ok_at"))
    hits = successes.join(firsts.select("source", "first_failure_at"), "source").where(
        F.col("_ok_at").between(F.col("first_failure_at"), F.col("first_failure_at") + window)
    ).select("source", F.lit(True).alias("later_success")).distinct()
    return firsts.join(hits, "source", "left").withColumn("later_success", F.coalesce("later_success", F.lit(False)))


def logon_brute_force(events: DataFrame, system: str, tz_offset: str = "+00:00") -> DataFrame:
    """Findings for repeated failed logons: ``system`` is ``windows`` or ``linux``."""
    windows = system == "windows"
    failure, success, ip = ("logon_failure", "logon_success", "source_ip") if windows else ("login_failed", "login_success", "src_ip")
    tried = events.where(F.col("action").isin(failure, success) & ~F.coalesce(F.col(ip), F.lit("")).isin("", "-")).select(
        F.col(ip).alias("source"), millis(instant(F.col("timestamp"), tz_offset)).alias("at"),
        (F.col("action") == failure).alias("failed"), "timestamp", "source_file", "line_number", "raw_hash",
    )
    hits = brute_force(tried.select("source", "at", "failed"))
    order = (
        F.struct(F.col("at").isNull().alias("late"), "at", "source_file", "line_number") if windows
        else F.struct("source_file", "line_number")
    )
    samples = tried.join(hits.select("source"), "source", "left_semi").groupBy("source").agg(
        F.min_by(F.struct("timestamp", "source_file", "line_number", "raw_hash"), order).alias("s")
    )
    noun = "logon" if windows else "login"
    what = "failed logon(s) (4625)" if windows else "failed login(s)"
    then = ", followed by a successful logon (4624)" if windows else ", followed by a successful login"
    untimed = F.when(
        F.col("untimed_failures") > 0,
        F.concat(F.lit("; "), F.col("untimed_failures").cast("string"), F.lit(f" further failed {noun}(s) carry no time and were left out of the count")),
    ).otherwise("")
    summary = F.concat(
        F.lit(f"{THRESHOLD} {what} in ten minutes came from "), F.col("source"),
        F.when(F.col("later_success"), F.lit(then)).otherwise(""), untimed,
        F.lit(". Password guessing is likely; check whether the account was used afterwards."),
    )
    high, low = (82, 62) if windows else (80, 60)
    return hits.join(samples, "source").select(*base_finding(
        F.when(F.col("later_success"), high).otherwise(low), "brute_force",
        "HOST-WINDOWS-BRUTE-001" if windows else "HOST-LINUX-SSHBRUTE-001",
        "Repeated Windows logon failures from one source" if windows else "Repeated SSH/auth failures from one source",
        "windows_event" if windows else "linux_event", "Q1", f"Q1 direct host event evidence from a {system} event export",
        "host_event_score", summary, "Review the account, the source and neighbouring Web and process evidence.",
        finding_id=F.concat(F.lit("HE-WIN-BF-" if windows else "HE-LNX-BF-"), F.col("source")),
        timestamp=F.col("s.timestamp"), source_file=F.col("s.source_file"), line_number=F.col("s.line_number"),
        raw_hash=F.col("s.raw_hash"), remote_ip=F.col("source"),
    ))
