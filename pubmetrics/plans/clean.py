"""Clean: keep-first dedup, year, author and journal normalisation, base tables (Entry A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from pubmetrics.functions import fill_authors, publication_year, trim_text
from pubmetrics.operators.counts import item_counts, value_counts
from pubmetrics.operators.dedup import keep_first, keep_first_counted
from pubmetrics.operators.quality import COVERAGE_FIELDS, coverage, report_kpis
from pubmetrics.operators.schema import (
    ORDER_COLUMN,
    SEARCH_FIELDS,
    canonicalize,
    resolve_field,
)
from pubmetrics.operators.trends import annual_counts
from pubmetrics.plans import records
from pubmetrics.plans.ingest import RunFiles
from pubmetrics.plans.records import append_record
from pubmetrics.sources.readers import load_records
from pubmetrics.sources.writers import read_as, write_csv, write_records


def clean_records(df: DataFrame, *, dedup: bool = True, nulls: str = "collapse") -> DataFrame:
    """Clean canonical records: first row per id, int year, filled authors, trimmed journal."""
    rows = keep_first(df, "eid", nulls=nulls) if dedup else df
    return (
        rows.withColumn("pub_year", publication_year(F.col("pub_year"), F.col("cover_date")))
        .withColumn("authors", fill_authors(F.col("authors"), F.col("creator")))
        .withColumn("journal", trim_text(F.col("journal")))
    )


def clean(raw: DataFrame, *, nulls: str = "collapse", keep_other: bool = True) -> DataFrame:
    """Clean a raw record table under any known header; not deduplicated without an id column."""
    has_id = resolve_field([c.strip() for c in raw.columns], SEARCH_FIELDS["eid"]) is not None
    if has_id and ORDER_COLUMN not in raw.columns:
        raise ValueError(f"keep-first needs {ORDER_COLUMN}: load the records with ordered=True")
    return clean_records(canonicalize(raw, keep_other=keep_other), dedup=has_id, nulls=nulls)


def clean_counted(raw: DataFrame) -> DataFrame:
    """`clean` with the number of raw rows each kept one stands for, as `_rows`."""
    canonical = canonicalize(raw, keep_other=True)
    if resolve_field([c.strip() for c in raw.columns], SEARCH_FIELDS["eid"]) is None:
        rows = canonical.withColumn("_rows", F.lit(1).cast("bigint"))
    elif ORDER_COLUMN not in raw.columns:
        raise ValueError(f"keep-first needs {ORDER_COLUMN}: load the records with ordered=True")
    else:
        rows = keep_first_counted(canonical, "eid")
    return clean_records(rows, dedup=False)


def clean_tables(cleaned: DataFrame) -> dict[str, DataFrame]:
    """Base tables of a cleaned record table."""
    return {
        "pubs_by_year": annual_counts(cleaned),
        "top_journals": value_counts(cleaned, "journal", keep_blank=True),
        "top_authors": item_counts(cleaned, "authors"),
        "keyword_freq": item_counts(cleaned, "author_keywords"),
        "coverage": coverage(cleaned),
        "report_kpis": report_kpis(cleaned),
    }


def run_clean(
    spark: SparkSession,
    base: str,
    run_id: str,
    *,
    source: str | None = None,
    fmt: str = "parquet",
    overwrite: bool = False,
) -> dict[str, DataFrame]:
    """Clean a landed run (or `source`), store the result, its base tables and a record of the run.

    The raw records are read once: rows, duplicates and coverage are measured while the result is
    written, and the base tables read the stored result.
    """
    files = RunFiles(base, run_id)
    source = source or files.raw()
    raw = load_records(spark, source, ordered=True)
    seen, rows = Observation(), clean_counted(raw)
    measures = [
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        *(F.count(c).alias(f"n_{name}") for name, c in COVERAGE_FIELDS.items()),
    ]
    path = write_records(
        rows, files.clean(), fmt, overwrite=overwrite, observe=(seen, measures), drop=["_rows"]
    )
    cleaned = read_as(rows.drop("_rows"), path) if fmt == "parquet" else load_records(spark, path)
    if fmt == "csv":
        cleaned = cleaned.withColumn("pub_year", F.col("pub_year").try_cast("int"))
    tables = clean_tables(cleaned)
    for name, table in tables.items():
        write_csv(table, files.table("analysis", name), overwrite=overwrite)
    n = seen.get
    total = n["rows_after"]
    names = [c.strip() for c in raw.columns]
    lacking = [f for f in SEARCH_FIELDS if resolve_field(names, SEARCH_FIELDS[f]) is None]
    append_record(
        spark,
        files.metrics("clean"),
        records.CLEAN,
        {
            "run_id": run_id,
            "timestamp_utc": records.now(),
            "input_path": source,
            "output_path": path,
            "output_format": fmt,
            "derived_fields": ["pub_year", "authors"],
            "rows_before": n["rows_before"],
            "rows_after": total,
            "duplicates_removed": n["rows_before"] - total,
            "coverage": {
                name: (n[f"n_{name}"], total, n[f"n_{name}"] / total if total else 0.0)
                for name in COVERAGE_FIELDS
            },
            "output_tables": {name: files.table("analysis", name) for name in tables},
            "notes": [f"no column for {f}; its tables are empty" for f in lacking],
        },
    )
    return {"records": cleaned, **tables}
