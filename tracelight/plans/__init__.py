"""Registered queries and the analysis that chains the operators."""

from __future__ import annotations

import importlib

from tracelight.plans.registry import REGISTRY, Query

_MODULES = ["detection_queries", "correlation_queries", "ingest_queries", "enrichment_queries", "file_queries", "host_queries"]


def all_queries() -> dict[str, Query]:
    for name in _MODULES:
        importlib.import_module(f"tracelight.plans.{name}")
    return REGISTRY
