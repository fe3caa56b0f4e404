"""Registered queries and the SQL they are checked against, one module per operator family."""

from __future__ import annotations

import importlib

MODULES = [
    "cleaning",
    "alignment",
    "quality_queries",
    "feature_queries",
    "model_queries",
    "forecast_runs",
    "business_queries",
    "cohort_queries",
    "intelligence_queries",
]


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"catalog.{name}")
        queries.update(module.REG.queries)
        oracles.update(module.REG.oracles)
    return queries, oracles
