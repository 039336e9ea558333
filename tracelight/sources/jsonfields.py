"""Reading loosely named JSON fields: alias lists, first usable one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions.values import let


def json_map(text: Column) -> Column:
    """Top-level fields of a JSON object as text; NULL when the line is not a JSON object."""
    return F.when(text.rlike(r"^\s*\{"), F.from_json(text, "map<string,string>"))


def lower_keys(fields: Column) -> Column:
    """Map with lower-cased keys; of keys differing only in case the first wins."""

    def build(keys: Column) -> Column:
        names = F.array_distinct(keys)
        values = F.map_values(fields)
        return F.map_from_arrays(names, F.transform(names, lambda k: F.get(values, (F.array_position(keys, k) - 1).cast("int"))))

    return let(F.transform(F.map_keys(fields), F.lower), build)


def with_fields(lines: DataFrame, text: Column, fold_case: bool = False, name: str = "_m") -> DataFrame:
    fields = json_map(text)
    return lines.withColumn(name, let(fields, lower_keys) if fold_case else fields)


def pick(fields: Column, *aliases: str) -> Column:
    """First alias holding a scalar."""
    scalar = lambda k: let(F.try_element_at(fields, F.lit(k)), lambda v: F.when(~v.startswith("{"), v))
    return F.coalesce(*[scalar(a) for a in aliases])


def pick_text(fields: Column, *aliases: str) -> Column:
    """As :func:`pick`, skipping empty strings and dashes."""
    usable = lambda k: let(
        F.try_element_at(fields, F.lit(k)), lambda v: F.when(~v.startswith("{") & ~v.isin("", "-"), v)
    )
    return F.coalesce(*[usable(a) for a in aliases])


def to_u16(value: Column) -> Column:
    return F.when(value.rlike(r"^\+?\d{1,5}$") & (value.cast("int") <= 65535), value.cast("int"))


def to_u64(value: Column) -> Column:
    return F.when(value.rlike(r"^\+?\d{1,18}$"), value.cast("long"))


def to_f64(value: Column) -> Column:
    return F.when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), value.cast("double"))
