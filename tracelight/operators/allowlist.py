"""Allowlist: TOML configuration compiled to one suppression column."""

from __future__ import annotations

import ipaddress
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelight.functions.net import Network, strict_hex
from tracelight.functions.text import normalise_allow_path
from tracelight.functions.values import holds


@dataclass(frozen=True)
class Suppression:
    rule_id: str | None = None
    path_prefix: str | None = None
    source_ip: str | None = None
    user_agent_contains: str | None = None
    reason: str | None = None


@dataclass
class Allowlist:
    disabled_rules: list[str] = field(default_factory=list)
    exact_paths: list[str] = field(default_factory=list)
    path_prefixes: list[str] = field(default_factory=list)
    exact_ips: list[str] = field(default_factory=list)
    networks: list[str] = field(default_factory=list)
    user_agents: list[str] = field(default_factory=list)
    suppressions: list[Suppression] = field(default_factory=list)

    @staticmethod
    def from_toml(content: str) -> "Allowlist":
        doc = tomllib.loads(content)
        part = lambda table, key: list((doc.get(table) or {}).get(key) or [])
        return Allowlist(
            disabled_rules=part("rules", "disabled"), exact_paths=part("paths", "exact"),
            path_prefixes=part("paths", "prefix"), exact_ips=part("source_ips", "exact"),
            networks=part("source_ips", "internal"), user_agents=part("user_agents", "contains"),
            suppressions=[
                Suppression(**{k: v for k, v in entry.items() if k in Suppression.__dataclass_fields__})
                for entry in doc.get("suppress") or []
            ],
        )

    @staticmethod
    def load(path: str | Path) -> "Allowlist":
        return Allowlist.from_toml(Path(path).read_text(encoding="utf-8"))

    def warnings(self) -> list[str]:
        """Entries that cannot match as an address."""
        notes = [
            f"source_ips.internal `{e}`: neither an address nor a network, so it has no effect"
            for e in self.networks if _mapped_range(e) is None
        ]
        notes += [
            f"source_ips.exact `{e}`: no address, so it is compared as text"
            for e in self.exact_ips if _address_key(e) is None
        ]
        return notes

    def suppresses(self, rule_id: str, path: Column | None, ip: Column | None, user_agent: Column | None) -> Column:
        """True where a hit of ``rule_id`` on this record is allowlisted."""
        if any(rule_id.lower() == d.lower() for d in self.disabled_rules):
            return F.lit(True)
        result = self._path(path) | self._ip(ip) | self._agent(user_agent, self.user_agents)
        for entry in self.suppressions:
            if entry.rule_id is not None and entry.rule_id.lower() != rule_id.lower():
                continue
            parts = F.lit(True)
            if entry.path_prefix is not None:
                parts = parts & (F.lit(False) if path is None else holds(
                    normalise_allow_path(path).startswith(_normal_path(entry.path_prefix))))
            if entry.source_ip is not None:
                parts = parts & (F.lit(False) if ip is None else holds(ip == entry.source_ip))
            if entry.user_agent_contains is not None:
                parts = parts & self._agent(user_agent, [entry.user_agent_contains])
            result = result | parts
        return result

    def _path(self, path: Column | None) -> Column:
        if path is None or not (self.exact_paths or self.path_prefixes):
            return F.lit(False)
        normal = normalise_allow_path(path)
        result = F.lit(False)
        if self.exact_paths:
            result = path.isin(*self.exact_paths) | normal.isin(*[_normal_path(p) for p in self.exact_paths])
        for prefix in self.path_prefixes:
            result = result | normal.startswith(_normal_path(prefix))
        return holds(result)

    def _ip(self, ip: Column | None) -> Column:
        if ip is None or not (self.exact_ips or self.networks):
            return F.lit(False)
        key = strict_hex(F.trim(ip))
        result = F.lit(False)
        if self.exact_ips:
            result = ip.isin(*self.exact_ips)
            keys = [k for k in map(_address_key, self.exact_ips) if k]
            if keys:
                result = result | key.isin(*keys)
        for bounds in filter(None, map(_mapped_range, self.networks)):
            result = result | key.between(bounds.low, bounds.high)
        return holds(result)

    @staticmethod
    def _agent(user_agent: Column | None, needles: list[str]) -> Column:
        if user_agent is None:
            return F.lit(False)
        result = F.lit(False)
        for needle in needles:
            result = result | F.lower(user_agent).contains(needle.lower())
        return holds(result)


def _mapped_range(entry: str) -> Network | None:
    try:
        return Network.parse(entry)
    except ValueError:
        return None


def _address_key(entry: str) -> str | None:
    try:
        ip = ipaddress.ip_address(entry.strip())
    except ValueError:
        return None
    number = int(ip) | (0xFFFF << 32) if ip.version == 4 else int(ip)
    return f"{number:032x}"


def _normal_path(path: str) -> str:
    decoded = unquote(path, errors="replace")
    kept: list[str] = []
    for segment in decoded.split("/"):
        if segment == "..":
            del kept[-1:]
        elif segment not in ("", "."):
            kept.append(segment)
    return ("/" if decoded.startswith("/") else "") + "/".join(kept)
