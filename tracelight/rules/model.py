"""Rule language: a tree of conditions with a score, read from YAML, JSON or Python."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


class RuleError(ValueError):
    """A rule or rule file that cannot be used."""


@dataclass(frozen=True)
class Condition:
    """All given parts must hold; an empty condition is true."""

    all: tuple["Condition", ...] = ()
    any: tuple["Condition", ...] = ()
    negated: "Condition | None" = None
    field: str | None = None
    equals: str | None = None
    contains: str | None = None
    contains_any: tuple[str, ...] = ()
    regex: str | None = None
    values: tuple[str, ...] = ()
    gt: float | None = None
    gte: float | None = None
    lt: float | None = None
    lte: float | None = None
    status_in: tuple[int, ...] = ()

    @property
    def is_empty(self) -> bool:
        scalars = (self.negated, self.equals, self.contains, self.regex, self.gt, self.gte, self.lt, self.lte)
        return all(v is None for v in scalars) and not (
            self.all or self.any or self.contains_any or self.values or self.status_in
        )

    def regexes(self) -> Iterable[str]:
        if self.regex is not None:
            yield self.regex
        for child in (*self.all, *self.any, *((self.negated,) if self.negated else ())):
            yield from child.regexes()


@dataclass(frozen=True)
class Adjustment:
    when: Condition
    value: int
    reason: str | None = None


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    category: str
    match: Condition
    source: str = "http_access"
    enabled: bool = True
    severity: str | None = None
    base: int = 40
    add: tuple[Adjustment, ...] = ()
    subtract: tuple[Adjustment, ...] = ()
    recommendation: str | None = None
    description: str | None = None
    version: int = 1

    def problems(self) -> list[str]:
        found = [f"{part} must not be empty" for part in ("id", "name", "category", "source") if not getattr(self, part).strip()]
        if self.match.is_empty:
            found.append("match needs at least one condition")
        if not 0 <= self.base <= 100:
            found.append("score.base must be between 0 and 100")
        patterns = list(self.match.regexes())
        for change in (*self.add, *self.subtract):
            if not 0 <= change.value <= 100:
                found.append("score adjustment must be between 0 and 100")
            if change.when.is_empty:
                found.append("score adjustment needs a condition")
            patterns += change.when.regexes()
        for pattern in patterns:
            try:
                re.compile(pattern)
            except re.error as error:
                found.append(f"invalid regex `{pattern}`: {error}")
        return found


@dataclass(frozen=True)
class RuleFile:
    path: str
    sha256: str
    rules: tuple[Rule, ...] = field(default_factory=tuple)


_CONDITION_KEYS = {
    "all", "any", "not", "field", "equals", "contains", "contains_any", "regex", "in", "gt", "gte", "lt", "lte",
    "status_in", "status in",
}


def condition_from(node: dict[str, Any] | None) -> Condition:
    node = node or {}
    number = lambda key: None if node.get(key) is None else float(node[key])
    text = lambda key: None if node.get(key) is None else str(node[key])
    return Condition(
        all=tuple(condition_from(c) for c in node.get("all") or ()),
        any=tuple(condition_from(c) for c in node.get("any") or ()),
        negated=condition_from(node["not"]) if node.get("not") is not None else None,
        field=text("field"), equals=text("equals"), contains=text("contains"), regex=text("regex"),
        contains_any=tuple(str(v) for v in node.get("contains_any") or ()),
        values=tuple(str(v) for v in node.get("in") or ()),
        gt=number("gt"), gte=number("gte"), lt=number("lt"), lte=number("lte"),
        status_in=tuple(int(v) for v in node.get("status_in") or node.get("status in") or ()),
    )


def rule_from(node: dict[str, Any]) -> Rule:
    try:
        score = node.get("score") or {}
        changes = lambda key: tuple(
            Adjustment(condition_from(c["when"]), int(c["value"]), c.get("reason")) for c in score.get(key) or ()
        )
        return Rule(
            id=str(node["id"]), name=str(node["name"]), category=str(node["category"]),
            match=condition_from(node["match"]), source=str(node.get("source", "http_access")),
            enabled=bool(node.get("enabled", True)), severity=node.get("severity"),
            base=int(score.get("base", 40)), add=changes("add"), subtract=changes("subtract"),
            recommendation=node.get("recommendation"), description=node.get("description"),
            version=int(node.get("version", 1)),
        )
    except (KeyError, TypeError, ValueError) as error:
        raise RuleError(f"rule {node.get('id', '?')!r} is malformed: {error}") from error


def parse_rules(content: str, path: str = "<text>") -> tuple[Rule, ...]:
    """Rules of one file, validated; duplicate ids inside the file are an error."""
    try:
        import yaml

        document = yaml.safe_load(content)
    except ImportError:  # JSON is a subset of YAML
        document = json.loads(content)
    except Exception as error:
        raise RuleError(f"{path} is not valid YAML: {error}") from error
    rules = tuple(rule_from(node) for node in (document or {}).get("rules") or ())
    for rule in rules:
        problems = rule.problems()
        if problems:
            raise RuleError(f"{rule.id}: " + "; ".join(problems))
    _reject_duplicates([(rule.id, path) for rule in rules], "in")
    return rules


def _reject_duplicates(owners: list[tuple[str, str]], where: str) -> None:
    counts = Counter(rule_id for rule_id, _ in owners)
    repeated = {i: n for i, n in counts.items() if n > 1}
    if repeated:
        detail = "; ".join(
            f"{i} x{n} ({', '.join(sorted({p for r, p in owners if r == i}))})" for i, n in sorted(repeated.items())
        )
        raise RuleError(f"duplicate rule id(s) {where} rule files: {detail}")


def load_rules(paths: Iterable[str] = (), builtin: bool = True) -> list[RuleFile]:
    """Built-in catalogue plus rule files or folders; same content is loaded once, shared ids are an error."""
    loaded: list[RuleFile] = []
    if builtin:
        from tracelight.rules.catalog import BUILTIN

        loaded.append(RuleFile("<builtin>", catalogue_digest(BUILTIN), tuple(BUILTIN)))
    files: dict[Path, Path] = {}
    for path in map(Path, paths):
        members = sorted(p for p in path.iterdir() if p.suffix in (".yml", ".yaml", ".json")) if path.is_dir() else [path]
        for member in members:
            files.setdefault(member.resolve(), member)
    for resolved in sorted(files):
        content = resolved.read_text(encoding="utf-8")
        digest = hashlib.sha256(content.encode()).hexdigest()
        if all(item.sha256 != digest for item in loaded):
            loaded.append(RuleFile(str(files[resolved]), digest, parse_rules(content, str(files[resolved]))))
    _reject_duplicates([(rule.id, item.path) for item in loaded for rule in item.rules], "across")
    return loaded


def catalogue_digest(rules: Iterable[Rule]) -> str:
    return hashlib.sha256("\n".join(repr(rule) for rule in rules).encode()).hexdigest()


def all_rules(files: Iterable[RuleFile]) -> list[Rule]:
    return [rule for item in files for rule in item.rules]
