"""Timestamp parsing. Every result is an instant; text keeps the offset it was written with."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelight.functions.values import let

# English month names.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_NAIVE = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$"


def instant(value: Column, tz_offset: str = "+00:00") -> Column:
    """RFC 3339 text, or ``YYYY-MM-DD[ T]HH:MM:SS`` read at ``tz_offset``; anything else is NULL."""
    return F.when(value.rlike(_RFC3339), F.try_to_timestamp(F.upper(value))).when(
        value.rlike(_NAIVE), F.try_to_timestamp(F.concat(value, F.lit(tz_offset)))
    )


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def seconds(ts: Column) -> Column:
    """Whole seconds since the epoch, rounded down."""
    return F.unix_seconds(ts)


def month_number(name: Column) -> Column:
    """Two-digit month from an English three-letter name, NULL when unknown."""
    names = F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS, 1) for v in (m, f"{i:02d}")])
    return F.try_element_at(names, F.lower(name))


def _offset_text(offset: Column) -> Column:
    """``+0800`` to ``+08:00``, zero offsets to ``Z``."""
    return F.when(offset.rlike(r"^[+-]0000$"), F.lit("Z")).otherwise(
        F.concat(F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, 4, 2))
    )


def _zone_suffix(tz_offset: str) -> str:
    return "Z" if tz_offset in ("+00:00", "-00:00", "Z") else tz_offset


def if_valid(iso: Column) -> Column:
    """RFC 3339 text itself when it denotes a real instant, else NULL."""
    return let(iso, lambda v: F.when(F.try_to_timestamp(v).isNotNull(), v))


_CLF = r"^\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}"


def clf_iso(raw: Column, tz_offset: str = "+00:00") -> Column:
    """``15/May/2026:08:00:00 +0000`` as RFC 3339 text; a missing offset means ``tz_offset``."""

    def build(stamp: Column) -> Column:
        part = lambda start, length: F.substring(stamp, start, length)
        zone = F.when(stamp.rlike(_CLF + r"$"), F.lit(_zone_suffix(tz_offset))).when(
            stamp.rlike(_CLF + r"\s+[+-]\d{4}(\s.*)?$"), _offset_text(F.regexp_extract(stamp, r"\s([+-]\d{4})", 1))
        )
        return F.concat(part(8, 4), F.lit("-"), month_number(part(4, 3)), F.lit("-"), part(1, 2), F.lit("T"), part(13, 8), zone)

    padded = F.regexp_replace(F.trim(raw), r"^(\d/)", "0$1")
    return if_valid(let(padded, build))


def naive_iso(value: Column, tz_offset: str = "+00:00") -> Column:
    """Canonical RFC 3339 text for a stamp :func:`instant` accepts (naive ones get the offset)."""

    def canonical(v: Column) -> Column:
        utc = F.regexp_replace(F.upper(v), r"[+-]00:00$", "Z")
        short = F.regexp_replace(F.regexp_replace(utc, r"(\.\d*?)0+(Z|[+-]\d{2}:\d{2})$", "$1$2"), r"\.(Z|[+-])", "$1")
        return F.when(v.rlike(_NAIVE), F.concat(F.translate(v, " ", "T"), F.lit(_zone_suffix(tz_offset)))).when(
            v.rlike(_RFC3339), F.when(v.contains("."), short).otherwise(utc)
        )

    return if_valid(let(value, canonical))


def syslog_iso(value: Column, now: datetime, tz_offset: str = "+00:00") -> Column:
    """``May 15 08:00:01`` without a year: this year, or last year when over a day in the future."""
    now = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    horizon = int(now.timestamp()) + 86_400

    def build(stamp: Column) -> Column:
        fields = F.split(F.trim(stamp), r"\s+")
        field = lambda i: F.get(fields, F.lit(i))
        tail = F.concat(
            F.lit("-"), month_number(field(0)), F.lit("-"), F.lpad(field(1), 2, "0"), F.lit("T"), field(2),
            F.lit(_zone_suffix(tz_offset)),
        )
        current = F.concat(F.lit(f"{now.year:04d}"), tail)
        ahead = F.coalesce(F.unix_seconds(F.try_to_timestamp(current)) > horizon, F.lit(False))
        return F.when(ahead, F.concat(F.lit(f"{now.year - 1:04d}"), tail)).otherwise(current)

    head = F.regexp_extract(value, r"^\s*([A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})", 1)
    return F.when(head != "", if_valid(let(head, build)))


def epoch_iso(epoch_seconds: Column) -> Column:
    """Whole epoch seconds as UTC text."""
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def audit_iso(epoch_text: Column) -> Column:
    """``1715000000.123`` (auditd) as UTC text at whole seconds."""
    whole = F.regexp_extract(epoch_text, r"^(\d+)", 1)
    return F.when(whole != "", epoch_iso(whole.cast("long")))


def micros_iso(micros_text: Column) -> Column:
    """journald microseconds as UTC text at whole seconds."""
    return F.when(micros_text.rlike(r"^-?\d{1,18}$"), epoch_iso(F.floor(micros_text.cast("long") / 1_000_000)))


def iso_utc(ts: Column) -> Column:
    """An instant as UTC text with up to six fractional digits, trailing zeros dropped."""
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    trimmed = F.regexp_replace(F.regexp_replace(full, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat(trimmed, F.lit("Z"))
