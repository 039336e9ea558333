"""Rules to Spark columns. Every leaf is NULL-safe, so negation never leaks a NULL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelight.functions.assess import clamp_score
from tracelight.functions.text import form_decoded_lower
from tracelight.functions.values import holds, let
from tracelight.rules.model import Adjustment, Condition, Rule

FieldLookup = Callable[[str], "Column | None"]
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def field_name(name: str) -> str:
    """Field names compare lower-cased, with dashes and spaces as underscores."""
    return name.strip().strip('"').lower().replace("-", "_").replace(" ", "_")


def lookup_in(columns: Iterable[str]) -> FieldLookup:
    """Resolve rule fields against record columns; unknown fields are missing."""
    known = {field_name(c): c for c in columns}
    return lambda name: F.col(f"`{known[field_name(name)]}`") if field_name(name) in known else None


def _contains(value: Column, needles: Iterable[str]) -> Column:
    wanted = [n.lower() for n in needles]

    def found(view: Column) -> Column:
        result = F.lit(False)
        for needle in wanted:
            result = result | view.contains(needle)
        return result

    decoded = F.when(value.rlike(r"[%+]"), let(form_decoded_lower(value), found)).otherwise(False)
    return found(F.lower(value)) | decoded


def _number(value: Column) -> Column:
    return F.when(value.rlike(_FLOAT), value.cast("double"))


def condition(node: Condition, lookup: FieldLookup, default_field: str) -> Column:
    """Boolean column of a condition tree; a leaf on a missing field is false."""
    clauses: list[Column] = [condition(c, lookup, default_field) for c in node.all]
    if node.any:
        either = F.lit(False)
        for child in node.any:
            either = either | condition(child, lookup, default_field)
        clauses.append(either)
    if node.negated is not None:
        clauses.append(~condition(node.negated, lookup, default_field))

    value = lookup(node.field or default_field)
    missing = F.lit(False)
    leaf = lambda build: missing if value is None else holds(build(value))
    if node.equals is not None:
        clauses.append(leaf(lambda v: F.lower(v) == node.equals.lower()))
    if node.contains is not None:
        clauses.append(leaf(lambda v: _contains(v, [node.contains])))
    if node.contains_any:
        clauses.append(leaf(lambda v: _contains(v, node.contains_any)))
    if node.regex is not None:
        clauses.append(leaf(lambda v: v.rlike(node.regex)))
    if node.values:
        clauses.append(leaf(lambda v: F.lower(v).isin(*[x.lower() for x in node.values])))
    comparisons = {
        "gt": lambda v, x: v > x, "gte": lambda v, x: v >= x, "lt": lambda v, x: v < x, "lte": lambda v, x: v <= x,
    }
    for operator, compare in comparisons.items():
        bound = getattr(node, operator)
        if bound is not None:
            clauses.append(leaf(lambda v, c=compare, b=bound: c(_number(v), F.lit(b))))
    if node.status_in:
        status = lookup("status")
        clauses.append(
            missing if status is None else holds(F.when(status.rlike(r"^\+?\d{1,5}$"), status.cast("int")).isin(*node.status_in))
        )
    result = F.lit(True)
    for clause in clauses:
        result = result & clause
    return result


def score_struct(rule: Rule, lookup: FieldLookup, default_field: str) -> Column:
    """``struct(rule_id, score, base, reasons)`` of a matching record."""
    base = min(rule.base, 100)
    total: Column = F.lit(base)
    reasons: list[Column] = [F.lit(f"base score {base}")]

    def apply(change: Adjustment, sign: int) -> None:
        nonlocal total
        hit = condition(change.when, lookup, default_field)
        total = total + F.when(hit, sign * change.value).otherwise(0)
        default = f"{'+' if sign > 0 else '-'}{change.value} matched score condition"
        reasons.append(F.when(hit, F.lit(change.reason or default)))

    for change in rule.add:
        apply(change, 1)
    for change in rule.subtract:
        apply(change, -1)
    changes = bool(rule.add or rule.subtract)
    return F.struct(
        F.lit(rule.id).alias("rule_id"),
        (clamp_score(total) if changes else F.lit(base)).cast("int").alias("score"),
        F.lit(base).alias("base"),
        (F.array_compact(F.array(*reasons)) if changes else F.array(*reasons)).alias("reasons"),
    )
