"""Analyze: annual series and growth of a cleaned record table (Entry B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pubmetrics.operators.trends import (
    annual_counts,
    filter_years,
    growth_summary,
    yoy_growth,
)
from pubmetrics.plans import records
from pubmetrics.plans.ingest import RunFiles
from pubmetrics.plans.records import append_record
from pubmetrics.sources.readers import load_records
from pubmetrics.sources.writers import write_csv, write_records


def annual_series(
    cleaned: DataFrame, min_year: int | None = None, max_year: int | None = None
) -> DataFrame:
    return annual_counts(filter_years(cleaned, min_year, max_year))


def analyze_tables(annual: DataFrame) -> dict[str, DataFrame]:
    """Growth tables of an annual series."""
    return {"yoy_growth": yoy_growth(annual), "cagr": growth_summary(annual)}


def run_analyze(
    spark: SparkSession,
    base: str,
    run_id: str,
    *,
    source: str | None = None,
    min_year: int | None = None,
    max_year: int | None = None,
    overwrite: bool = False,
) -> dict[str, DataFrame]:
    """Growth tables of a cleaned run; the records are read once, for the annual series."""
    files = RunFiles(base, run_id)
    source = source or files.clean()
    cleaned = load_records(spark, source)
    cleaned = cleaned.withColumn("pub_year", F.col("pub_year").try_cast("int"))
    # The series is one row per year.
    stored = write_records(
        annual_series(cleaned, min_year, max_year),
        files.work("analyze", "annual"),
        overwrite=overwrite,
    )
    annual = spark.read.parquet(stored)
    growth, at = analyze_tables(annual), records.now()
    growth["cagr"] = growth["cagr"].select(
        "*", F.lit(at).alias("timestamp_utc"), F.lit(run_id).alias("run_id")
    )
    tables = {"pubs_by_year_scoped": annual.orderBy("pub_year"), **growth}
    for name, table in tables.items():
        write_csv(table, files.table("analysis", name), overwrite=overwrite, single_file=True)
    summary = growth["cagr"].first()
    append_record(
        spark,
        files.metrics("analyze"),
        records.ANALYZE,
        {
            "run_id": run_id,
            "timestamp_utc": at,
            "input_path": source,
            "period": (summary["start_year"], summary["end_year"]),
            "cagr": summary["cagr"],
            "output_tables": {name: files.table("analysis", name) for name in tables},
            "output_format": "csv",
            "yoy_pct_units": "percent",
        },
    )
    return tables
