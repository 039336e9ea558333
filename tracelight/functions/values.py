"""Small Column helpers used everywhere."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def non_blank(column: Column) -> Column:
    """NULL for the empty string."""
    return F.when(column != "", column)


def dash_to_null(column: Column) -> Column:
    """NULL for the empty string and for a lone dash."""
    return F.when((column != "") & (column != "-"), column)


def text(column: Column) -> Column:
    """The string, or the empty string when NULL."""
    return F.coalesce(column.cast("string"), F.lit(""))


def holds(predicate: Column) -> Column:
    """A predicate with NULL read as false, safe to negate."""
    return F.coalesce(predicate, F.lit(False))


def contains_any(column: Column, needles: Iterable[str]) -> Column:
    """Case-insensitive substring test against fixed ASCII needles, in one pass over the text."""
    wanted = list(needles)
    if not wanted:
        return F.lit(False)
    firsts = "".join(sorted({re.escape(needle[0]) for needle in wanted}))
    return F.lower(text(column)).rlike(f"(?=[{firsts}])(?:{'|'.join(re.escape(needle) for needle in wanted)})")


def is_one_of(column: Column, values: Iterable[str]) -> Column:
    return holds(column.isin(*values))


def sorted_join(columns: list[Column], separator: str = ";") -> Column:
    """Join the non-NULL strings in sorted order, duplicates removed."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*columns)))), separator)


def squash(column: Column, limit: int | None = None) -> Column:
    """Collapse white space runs, trim, and bound the length."""
    squeezed = F.trim(F.regexp_replace(column, r"\s+", " "))
    return F.substring(squeezed, 1, limit) if limit else squeezed


def display_or(column: Column, fallback: Column | str) -> Column:
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(F.trim(text(column)) == "", fallback).otherwise(column)


def number_text(column: Column) -> Column:
    """A double as shortest text: integral values carry no fraction."""
    whole = column.cast("long")
    return F.when(column == whole.cast("double"), whole.cast("string")).otherwise(column.cast("string"))
