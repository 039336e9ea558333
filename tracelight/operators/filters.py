"""Time windows and small row filters."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions.times import instant

DEFAULT_HOURS = 72
DEFAULT_LOG_DAYS = 30


@dataclass(frozen=True)
class TimeWindow:
    since: str | None = None
    until: str | None = None


def _parse(value: str) -> datetime:
    parsed = datetime.fromisoformat(value.replace("Z", "+00:00").replace(" ", "T", 1))
    return parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)


def _iso(value: datetime) -> str:
    return value.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def resolve_window(since: str | None = None, until: str | None = None, hours: int | None = None,
                   log_days: int | None = None, full_scan: bool = False, now: datetime | None = None) -> TimeWindow:
    """Analysis window: an explicit start wins, then hours, then days, all counted back from the end."""
    if full_scan:
        return TimeWindow()
    end = _parse(until) if until else now or datetime.now(timezone.utc)
    if since:
        start = _parse(since)
        if start > end:
            raise ValueError("since must not be after until")
    elif hours is not None:
        start = end - timedelta(hours=hours)
    elif log_days is not None:
        start = end - timedelta(days=log_days)
    else:
        start = end - timedelta(hours=DEFAULT_HOURS)
    return TimeWindow(_iso(start), _iso(end) if until else None)


def inside(column: str, window: TimeWindow, tz_offset: str = "+00:00", keep_undated: bool = True) -> Column:
    """Both bounds inclusive; undated rows are kept unless told otherwise."""
    at = instant(F.col(column), tz_offset)
    keep = F.lit(True)
    if window.since:
        keep = keep & (at >= F.to_timestamp(F.lit(window.since)))
    if window.until:
        keep = keep & (at <= F.to_timestamp(F.lit(window.until)))
    return (at.isNull() | keep) if keep_undated else (at.isNotNull() & keep)


def time_filter(df: DataFrame, column: str, window: TimeWindow, tz_offset: str = "+00:00") -> DataFrame:
    return df.where(inside(column, window, tz_offset))


def filtered_count(df: DataFrame, column: str, window: TimeWindow, tz_offset: str = "+00:00") -> DataFrame:
    """How many rows the window leaves out."""
    return df.agg(F.sum(F.when(inside(column, window, tz_offset), 0).otherwise(1)).alias("filtered"))


def recently_changed(files: DataFrame, window: TimeWindow, column: str = "modified_at", order: bool = True) -> DataFrame:
    """Files whose change time lies in the window, by time and path."""
    kept = files.where(inside(column, window, keep_undated=False))
    return kept.orderBy(column, "path") if order else kept
