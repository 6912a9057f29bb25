"""Registered queries (one per operator family of the survey) and their
DuckDB oracle SQL. Importing this package fills the registry."""

from demandlens.plans import analysis, baskets, cleaning, extraction, forecasts, gap, ingest, outputs, quality, validation, wide  # noqa: F401  (registers queries)
from demandlens.plans.registry import REGISTRY, Query


def queries():
    return {name: q.build for name, q in REGISTRY.items()}


def oracle_sql():
    return {name: q.sql for name, q in REGISTRY.items() if q.sql is not None}


__all__ = ["REGISTRY", "Query", "queries", "oracle_sql"]
