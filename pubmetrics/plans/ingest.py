"""Ingest: search, slice, deduplicate and land a raw record table (Entry D of the survey)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pubmetrics.functions import publication_year
from pubmetrics.operators.dedup import keep_first
from pubmetrics.operators.schema import (
    ORDER_COLUMN,
    SEARCH_FIELDS,
    plain_names,
    resolve_field,
)
from pubmetrics.sources.slices import in_slices
from pubmetrics.sources.writers import append_run_metrics, path_exists, read_as, write_records

SLICE_YEAR = "slice_year"


@dataclass(frozen=True)
class RunFiles:
    """Where a run keeps its tables: everything is namespaced by base folder and run id."""

    base: str
    run_id: str

    def raw(self) -> str:
        return f"{self.base}/data/raw/records_{self.run_id}"

    def clean(self) -> str:
        return f"{self.base}/data/processed/clean_{self.run_id}"

    def table(self, phase: str, name: str) -> str:
        return f"{self.base}/outputs/{phase}/{self.run_id}/{name}"

    def work(self, phase: str, name: str) -> str:
        return f"{self.base}/work/{phase}/{self.run_id}/{name}"

    def metrics(self, phase: str) -> str:
        return f"{self.base}/outputs/methods/{phase}"


def with_slice_year(df: DataFrame) -> DataFrame:
    """Add the slice a record belongs to, from whichever year and date columns it has."""

    def column(field: str) -> Column:
        pos = resolve_field(df.columns, SEARCH_FIELDS[field])
        return F.lit(None).cast("string") if pos is None else F.col(f"`{df.columns[pos]}`")

    return df.withColumn(SLICE_YEAR, publication_year(column("pub_year"), column("cover_date")))


def run_ingest(
    records: DataFrame,
    base: str,
    run_id: str,
    *,
    slicing: bool = False,
    start_year: int | None = None,
    end_year: int | None = None,
    max_years_back: int | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Land the records of a search and append the run's metrics; returns the landed table.

    With `slicing` only the given years are taken, the table is laid out by slice year and
    the first record per id is kept, earlier slices first. An existing run is never replaced.
    Headers are trimmed; of names that differ only in case, those no field is looked up by get a number.
    """
    spark = records.sparkSession
    records = records.toDF(*plain_names(records.columns))
    files = RunFiles(base, run_id)
    for known in ("parquet", "csv"):
        if path_exists(spark, f"{files.raw()}.{known}"):
            raise FileExistsError(f"raw records already exist: {files.raw()}.{known}")
    dated = with_slice_year(records)
    found = rows = dated
    if slicing:
        found = rows = in_slices(dated, start_year, end_year, max_years_back, year=SLICE_YEAR)
        if "eid" in rows.columns:
            rows = keep_first(rows, "eid", order=F.struct(SLICE_YEAR, ORDER_COLUMN))
    path = write_records(
        rows, files.raw(), fmt, partition_by=SLICE_YEAR if slicing and fmt == "parquet" else None
    )
    landed = (
        read_as(rows, path)
        if fmt == "parquet"
        else spark.read.csv(path, header=True, multiLine=True, escape='"')
    )
    append_run_metrics(
        _metrics(records, found, landed, run_id, slicing, path, fmt), files.metrics("ingest")
    )
    return landed


def _metrics(
    records: DataFrame,
    found: DataFrame,
    landed: DataFrame,
    run_id: str,
    slicing: bool,
    path: str,
    fmt: str,
) -> DataFrame:
    """AGG14: estimated and landed records and the years that had any before dedup, as one row."""
    covered = found.groupBy(F.col(SLICE_YEAR).cast("int").alias("year")).agg(
        F.lit("found").alias("kind"), F.count(F.lit(1)).alias("n")
    )
    kept = landed.groupBy(F.col(SLICE_YEAR).cast("int").alias("year")).agg(
        F.lit("landed").alias("kind"), F.count(F.lit(1)).alias("n")
    )
    seen = records.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(None).cast("int").alias("year"), F.lit("estimated").alias("kind"), "n"
    )
    return (
        kept.unionByName(seen)
        .unionByName(covered)
        .agg(
            F.coalesce(F.sum(F.when(F.col("kind") == "estimated", F.col("n"))), F.lit(0)).alias(
                "n_results_estimated"
            ),
            F.coalesce(F.sum(F.when(F.col("kind") == "landed", F.col("n"))), F.lit(0)).alias(
                "n_records_downloaded"
            ),
            F.array_sort(F.collect_set(F.when(F.col("kind") == "found", F.col("year")))).alias(
                "years_covered"
            ),
        )
        .select(
            F.lit(run_id).alias("run_id"),
            F.lit("slicing" if slicing else "single").alias("strategy_used"),
            "*",
            F.array(*(F.lit(c) for c in records.columns)).alias("columns_present"),
            F.lit(path).alias("raw_output_path"),
            F.lit(fmt).alias("output_format"),
        )
    )
