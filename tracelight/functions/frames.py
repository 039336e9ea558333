"""Frame-level helper shared by sources and operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, columns: Sequence[Column | str] | None = None) -> DataFrame:
    """Same rows with every column computed once here.

    Filters and join conditions that follow would otherwise be pushed into the expressions and
    evaluate costly ones again, several times per row.
    """
    row = F.struct(*(columns or df.columns))
    return df.select(F.explode(F.array(row)).alias("_row")).select("_row.*")


def joined_narrow(df: DataFrame, narrow: DataFrame, on: Sequence[str], how: str = "left", most_rows: int = 1_000_000) -> tuple[DataFrame, bool]:
    """``df`` joined with a table of a few values per input split, and whether ``df`` stayed where it was.

    ``narrow`` is computed once and counted; it is broadcast up to ``most_rows`` rows only, beyond that both sides are shuffled.
    """
    from tracelight.session import cut_lineage

    fixed = cut_lineage(narrow)
    small = fixed.count() <= most_rows
    return df.join(F.broadcast(fixed) if small else fixed, list(on), how), small
