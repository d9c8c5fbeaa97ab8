"""Run records: what a phase read, wrote and counted, one row per run (SNK5)."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from pubmetrics.sources.writers import append_run_metrics

COMMON = "run_id string, timestamp_utc string"
CLEAN = (
    f"{COMMON}, input_path string, output_path string, output_format string, "
    "derived_fields array<string>, rows_before long, rows_after long, duplicates_removed long, "
    "coverage map<string,struct<n_nonnull:long,n_total:long,pct_nonnull:double>>, "
    "output_tables map<string,string>, notes array<string>"
)
ANALYZE = (
    f"{COMMON}, input_path string, period struct<start_year:int,end_year:int>, cagr double, "
    "output_tables map<string,string>, output_format string, yoy_pct_units string"
)
FULL = (
    f"{COMMON}, input_path string, output_root string, min_year int, max_year int, "
    "rows_input long, rows_raw long, rows_deduplicated long, rows_scoped long, "
    "output_tables map<string,string>"
)


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def append_record(spark: SparkSession, path: str, schema: str, values: Mapping) -> None:
    """One row of a run's own figures and paths; a rerun replaces it."""
    names = spark.createDataFrame([], schema).columns
    row = tuple(values.get(n) for n in names)
    append_run_metrics(spark.createDataFrame([row], schema), path)
