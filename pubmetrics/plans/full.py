"""One-shot analysis of an export: composite dedup, scope, all result tables (Entry C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from pubmetrics.functions import (
    first_author,
    norm_doi,
    norm_id,
    norm_text,
    numeric_year,
    publication_year,
)
from pubmetrics.operators.counts import TOP_N, item_counts, ranked, value_counts
from pubmetrics.operators.dedup import keep_first, keep_first_counted, with_record_key
from pubmetrics.operators.geo import bubble_sizes, regions_over_time
from pubmetrics.operators.keywords import (
    MIN_DOCS,
    coded_sets,
    heaviest_edges,
    keyword_codes,
    keyword_frequency,
    top_keywords,
    with_keyword_set,
)
from pubmetrics.operators.schema import EXPORT_FIELDS, ORDER_COLUMN, canonicalize
from pubmetrics.operators.trends import annual_counts, kpi_interest, trend
from pubmetrics.plans import records
from pubmetrics.plans.ingest import RunFiles
from pubmetrics.plans.records import append_record
from pubmetrics.sources.slices import SLICE_COLUMN, with_slices
from pubmetrics.sources.writers import (
    path_exists,
    read_as,
    staged_write,
    stored_at,
    swap_in,
    write_csv,
)

# The default scope.
MIN_YEAR = 1983
MAX_YEAR = 2025


def with_year(df: DataFrame, *, strict: bool = False) -> DataFrame:
    """Integer `_year` of canonical records; `strict` ignores the cover date (PRJ3)."""
    year = (
        numeric_year(F.col("pub_year"))
        if strict
        else publication_year(F.col("pub_year"), F.col("cover_date"))
    )
    return df.withColumn("_year", year)


def export_records(raw: DataFrame, *, strict: bool = False) -> DataFrame:
    """Canonical records of an export with `_year`, which may be null."""
    canonical = canonicalize(raw, EXPORT_FIELDS, require_year=True, keep_other=True)
    return with_year(canonical, strict=strict)


def deduplicated(canonical: DataFrame) -> DataFrame:
    """Dated records, first per composite key, with the normalised parts of the key (SNK4)."""
    dated = canonical.filter(F.col("_year").isNotNull())
    return with_key_parts(keep_first(with_record_key(dated, "_year"), "_dedup_key"))


def with_key_parts(unique: DataFrame) -> DataFrame:
    return (
        unique.withColumn("_eid", norm_id(F.col("eid")))
        .withColumn("_doi", norm_doi(F.col("doi")))
        .withColumn("_t", norm_text(F.col("title")))
        .withColumn("_a1", first_author(F.col("authors")))
    )


def deduplicated_counted(canonical: DataFrame) -> DataFrame:
    """`deduplicated` with the rows each record stands for as `_rows`; all undated ones are one row without a key."""
    keyed = with_record_key(canonical, "_year")
    keyed = keyed.withColumn("_dedup_key", F.when(F.col("_year").isNotNull(), F.col("_dedup_key")))
    return with_key_parts(keep_first_counted(keyed, "_dedup_key"))


def in_scope(unique: DataFrame, min_year: int = MIN_YEAR, max_year: int = MAX_YEAR) -> DataFrame:
    """FLT3: applied after deduplication, so a first copy out of scope hides later ones."""
    return unique.filter(F.col("_year").between(min_year, max_year))


def aggregates(scoped: DataFrame, unique: DataFrame) -> dict[str, DataFrame]:
    """The tables several results build on, each one pass over the records.

    Geography uses the unscoped records and its own periods.
    """
    return {
        "annual": annual_counts(scoped, "_year", "year", "n_pubs"),
        "keyword_freq": keyword_frequency(with_keyword_set(scoped)),
        "geo": regions_over_time(unique, year="_year"),
    }


def full_tables(
    scoped: DataFrame,
    shared: dict[str, DataFrame],
    min_year: int = MIN_YEAR,
    max_year: int = MAX_YEAR,
    *,
    min_docs: int = MIN_DOCS,
) -> dict[str, DataFrame]:
    """Result tables from the scoped records and their `aggregates`, lazy or stored."""
    annual, frequency, geo = shared["annual"], shared["keyword_freq"], shared["geo"]
    codes = keyword_codes(frequency, min_docs)
    sets = coded_sets(with_keyword_set(scoped), codes)
    return {
        "pubs_by_year": trend(annual),
        "kpi_interest": kpi_interest(annual, min_year, max_year),
        "top_journals": value_counts(scoped, "journal", limit=TOP_N),
        "top_document_types": value_counts(scoped, "doc_type", "doctype", limit=TOP_N),
        "top_authors": item_counts(scoped, "authors", "author", limit=TOP_N),
        "keyword_freq": ranked(frequency, "keyword"),
        "top_keywords": top_keywords(frequency),
        "bubble_regions_over_time": geo.orderBy("bin", "region"),
        "bubble_sizes": bubble_sizes(geo).orderBy("bin", "region"),
        "keyword_edges": heaviest_edges(sets, codes),
    }


def full_analysis(
    raw: DataFrame, min_year: int = MIN_YEAR, max_year: int = MAX_YEAR, *, strict: bool = False
) -> dict[str, DataFrame]:
    """All result tables as frames over one export; only coded keyword sets are stored on the way."""
    if ORDER_COLUMN not in raw.columns:
        raise ValueError(f"keep-first needs {ORDER_COLUMN}: load the records with ordered=True")
    unique = deduplicated(export_records(raw, strict=strict))
    scoped = in_scope(unique, min_year, max_year)
    shared = aggregates(scoped, unique)
    return {"dataset_scope": scoped, **full_tables(scoped, shared, min_year, max_year)}


def run_full_analysis(
    raw: DataFrame,
    base: str,
    run_id: str,
    min_year: int = MIN_YEAR,
    max_year: int = MAX_YEAR,
    *,
    strict: bool = False,
    overwrite: bool = False,
    source: str | None = None,
) -> dict[str, DataFrame]:
    """Run the analysis, store its tables and a record of the run; `source` names the export in it.

    The export is read once: its deduplicated records are written in one piece, by scope and year, the rows
    counted by the tasks that write them. Records in scope are then moved to be the dataset table, the
    others stay as a work table, and every other table reads those: year-pruned columnar scans, and
    no lineage to replay when an executor is lost. Years from 1900 to 2100 have a folder each (`_slice`), all
    others share one.
    """
    spark, files = raw.sparkSession, RunFiles(base, run_id)
    scope_path = f"{files.table('full_analysis', 'dataset_scope')}.parquet"
    if not overwrite and path_exists(spark, scope_path):
        raise FileExistsError(f"output already exists: {scope_path}")
    unique, scoped, counts = _stored_records(
        deduplicated_counted(export_records(raw, strict=strict)),
        f"{files.work('full', 'deduplicated')}.parquet",
        scope_path,
        F.col("_year").between(min_year, max_year),
    )
    shared = {
        name: stored_at(table, files.work("full", name))
        for name, table in aggregates(scoped, unique).items()
    }
    tables = full_tables(
        scoped,
        shared,
        min_year,
        max_year,
    )
    for name, table in tables.items():
        write_csv(
            table,
            files.table("full_analysis", name),
            overwrite=overwrite,
            single_file=name != "keyword_freq",
        )
    append_record(
        spark,
        files.metrics("full_analysis"),
        records.FULL,
        {
            "run_id": run_id,
            "timestamp_utc": records.now(),
            "input_path": source,
            "output_root": f"{base}/outputs/full_analysis/{run_id}",
            "min_year": min_year,
            "max_year": max_year,
            **counts,
            "output_tables": {
                "dataset_scope": scope_path,
                **{name: files.table("full_analysis", name) for name in tables},
            },
        },
    )
    return {"dataset_scope": scoped, **tables}


def _stored_records(
    rows: DataFrame, work: str, scope_path: str, inside: Column
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Deduplicated records, those in scope, both stored, and the run's counts (AGG14)."""
    spark, seen = rows.sparkSession, Observation()
    dated = F.col("_dedup_key").isNotNull()
    laid = with_slices(rows.withColumn("_scope", F.coalesce(inside, F.lit(False))), "_year")
    n = F.col("_rows")
    # Undated rows are counted and left out; the tasks that write a record are those that count it.
    laid = laid.hint("rebalance", F.col("_scope"), F.col(SLICE_COLUMN)).observe(
        seen,
        F.coalesce(F.sum(n), F.lit(0)).alias("rows_input"),
        F.coalesce(F.sum(F.when(dated, n)), F.lit(0)).alias("rows_raw"),
        F.count_if(dated).alias("rows_deduplicated"),
        F.count_if(dated & F.col("_scope")).alias("rows_scoped"),
    )
    laid = laid.filter(dated).drop("_rows")
    staged_write(
        spark,
        work,
        lambda path: laid.write.partitionBy("_scope", SLICE_COLUMN).parquet(path),
        overwrite=True,
    )
    table = laid.drop("_scope")
    found = f"{work}/_scope=true"
    if path_exists(spark, found):
        swap_in(spark, found, scope_path)
    else:
        empty = spark.createDataFrame([], table.schema)
        staged_write(spark, scope_path, empty.write.parquet, overwrite=True)
    scoped = unique = read_as(table, scope_path).drop(SLICE_COLUMN)
    if path_exists(spark, f"{work}/_scope=false"):
        outside = read_as(table, f"{work}/_scope=false").drop(SLICE_COLUMN)
        unique = scoped.unionByName(outside)
    return unique, scoped, seen.get
