"""The whole analysis: ingest results in, findings, chains, roll-ups and timeline out."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.operators import rollups
from tracelight.operators.allowlist import Allowlist
from tracelight.operators.baseline import downrank_repeated, known_files
from tracelight.operators.brute_force import logon_brute_force
from tracelight.operators.components import connected_components
from tracelight.operators.detectors import (
    container_findings, linux_event_findings, remote_logon_findings, runtime_findings, scan_findings, windows_event_findings,
)
from tracelight.operators.enrich import infer_clients, ioc_candidates, ioc_findings, ioc_matches
from tracelight.operators.filters import TimeWindow, time_filter
from tracelight.operators.findings import detect
from tracelight.operators.ordered import numbered_ids
from tracelight.operators.records import RecordSet, app_records, db_records, http_records, waf_records
from tracelight.operators.relations import component_edges, correlate, evidence_chains, file_context, prepared, related_ids, relation_pairs, with_nearest_ids
from tracelight.operators.timeline import timeline
from tracelight.rules.model import Rule, all_rules, load_rules
from tracelight.schema import FINDING, conform
from tracelight.session import cut_lineage
from tracelight.sources.inventory import records_of


@dataclass
class Evidence:
    """Typed tables of one case; everything is optional."""

    http: DataFrame | None = None
    db: DataFrame | None = None
    waf: DataFrame | None = None
    app: DataFrame | None = None
    windows: DataFrame | None = None
    linux: DataFrame | None = None
    containers: tuple[DataFrame, DataFrame, DataFrame] | None = None
    runtime: DataFrame | None = None
    connections: DataFrame | None = None
    inventories: dict[str, DataFrame] = field(default_factory=dict)
    files: DataFrame | None = None
    suspicious_files: DataFrame | None = None
    recent_files: DataFrame | None = None
    indicators: DataFrame | None = None
    extra_findings: DataFrame | None = None


@dataclass
class Settings:
    rules: list[Rule] | None = None
    allowlist: Allowlist | None = None
    window: TimeWindow = field(default_factory=TimeWindow)
    trusted_proxies: list[str] = field(default_factory=list)
    tz_offset: str = "+00:00"
    earlier_findings: DataFrame | None = None


@dataclass
class Analysis:
    findings: DataFrame
    hits: DataFrame
    chains: DataFrame
    chain_members: DataFrame
    sources: DataFrame
    types: DataFrame
    urls: DataFrame
    high_risk: DataFrame
    timeline: DataFrame
    evidence_chains: DataFrame
    tz_offset: str = "+00:00"

    def relations(self) -> DataFrame:
        """Related pairs, listed on request."""
        return relation_pairs(self.findings, self.tz_offset)

    def related(self) -> DataFrame:
        """``finding_id, related_id`` of all related findings, both ways."""
        return related_ids(self.relations())


def record_sets(evidence: Evidence, settings: Settings) -> list[RecordSet]:
    """Rule records of every source. Logs are cut to the window before anything is counted over time."""
    cut = lambda df: time_filter(df, "timestamp", settings.window, settings.tz_offset)
    sets: list[RecordSet] = []
    if evidence.http is not None:
        sets.append(http_records(cut(evidence.http), settings.tz_offset))
    sets += [records_of(name, df) for name, df in evidence.inventories.items()]
    for df, build in ((evidence.db, db_records), (evidence.app, app_records), (evidence.waf, waf_records)):
        if df is not None:
            sets.append(build(cut(df)))
    return sets


def coded_findings(evidence: Evidence, settings: Settings) -> list[tuple[str, DataFrame]]:
    """Findings of the coded detectors with their id prefix."""
    out: list[tuple[str, DataFrame]] = []
    if evidence.windows is not None:
        out += [("HE-WIN-F", windows_event_findings(evidence.windows)), ("HE-WIN-BF", logon_brute_force(evidence.windows, "windows", settings.tz_offset)),
                ("HE-WIN-RL", remote_logon_findings(evidence.windows))]
    if evidence.linux is not None:
        out += [("HE-LNX-F", linux_event_findings(evidence.linux)), ("HE-LNX-BF", logon_brute_force(evidence.linux, "linux", settings.tz_offset))]
    if evidence.connections is not None:
        out.append(("HE-ENR-F", scan_findings(evidence.connections)))
    if evidence.containers is not None:
        out.append(("CTR-F", container_findings(*evidence.containers)))
    if evidence.runtime is not None:
        out.append(("RT-F", runtime_findings(evidence.runtime)))
    return out


def analyse(evidence: Evidence, settings: Settings | None = None) -> Analysis:
    """Detect, enrich, compare with an earlier run, correlate, roll up.

    Findings are saved before correlation, which reads them several times.
    """
    settings = settings or Settings()
    rules = settings.rules if settings.rules is not None else all_rules(load_rules())
    if evidence.http is not None and settings.trusted_proxies:
        evidence = replace(evidence, http=infer_clients(evidence.http, settings.trusted_proxies))
    found, hits = detect(record_sets(evidence, settings), rules, settings.allowlist)
    parts = [found]
    for prefix, df in coded_findings(evidence, settings):
        numbered = df.where(F.col("finding_id").isNotNull()).unionByName(
            conform(numbered_ids(df.where(F.col("finding_id").isNull()), ["rule_id", "source_file", "line_number", "raw_hash", "evidence_summary"], prefix, "finding_id"), FINDING))
        parts.append(numbered)
    if evidence.indicators is not None:
        parts.append(ioc_findings(ioc_matches(ioc_candidates(evidence.http, evidence.db, evidence.files), evidence.indicators)))
    if evidence.extra_findings is not None:
        parts.append(evidence.extra_findings)
    findings = reduce(DataFrame.unionByName, [conform(p, FINDING) for p in parts])
    if settings.earlier_findings is not None:
        findings = conform(downrank_repeated(findings, settings.earlier_findings, known_files(settings.earlier_findings)), FINDING)
    findings = cut_lineage(findings)
    notes = None
    if evidence.suspicious_files is not None and evidence.recent_files is not None:
        notes = file_context(findings, evidence.suspicious_files, evidence.recent_files, settings.tz_offset)
    correlated = cut_lineage(with_nearest_ids(correlate(findings, notes, settings.tz_offset), settings.tz_offset))
    components = connected_components(component_edges(prepared(correlated, settings.tz_offset)))
    return Analysis(
        findings=correlated, hits=hits, chains=rollups.attack_chains(correlated, components, settings.tz_offset),
        chain_members=rollups.chain_members(correlated, components, settings.tz_offset),
        sources=rollups.source_stats(correlated, settings.tz_offset), types=rollups.type_stats(correlated), urls=rollups.url_stats(correlated),
        high_risk=rollups.high_risk_events(correlated), timeline=timeline(conform(correlated, FINDING), settings.tz_offset),
        evidence_chains=evidence_chains(correlated, settings.tz_offset, files=notes), tz_offset=settings.tz_offset,
    )
