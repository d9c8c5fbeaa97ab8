"""Phases composed from the operators: ingest, clean, analyze and the one-shot full analysis."""

from pubmetrics.plans.analyze import analyze_tables, annual_series, run_analyze
from pubmetrics.plans.clean import clean, clean_records, clean_tables, run_clean
from pubmetrics.plans.full import (
    aggregates,
    deduplicated,
    export_records,
    full_analysis,
    full_tables,
    in_scope,
    run_full_analysis,
)
from pubmetrics.plans.ingest import RunFiles, run_ingest

__all__ = [
    "RunFiles",
    "aggregates",
    "analyze_tables",
    "annual_series",
    "clean",
    "clean_records",
    "clean_tables",
    "deduplicated",
    "export_records",
    "full_analysis",
    "full_tables",
    "in_scope",
    "run_analyze",
    "run_clean",
    "run_full_analysis",
    "run_ingest",
]
