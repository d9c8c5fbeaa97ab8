"""Coverage, run counts and report figures (AGG13-AGG15)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from pubmetrics.functions import record_key, split_items, trim_text
from pubmetrics.operators.schema import ORDER_COLUMN

COVERAGE_FIELDS = {
    "pub_year": "pub_year",
    "journal": "journal",
    "authors": "authors",
    "keywords": "author_keywords",
}


def coverage(df: DataFrame, fields: Mapping[str, str] = COVERAGE_FIELDS) -> DataFrame:
    """AGG13: non-null rows, rows and their ratio per field; a missing column counts as null.

    One pass; the wide one-row result is then turned into a row per field.
    """
    present = {
        name: F.count(col) if col in df.columns else F.lit(0).cast("bigint")
        for name, col in fields.items()
    }
    wide = df.agg(
        F.count(F.lit(1)).alias("n_total"),
        *(n.alias(f"_n_{i}") for i, n in enumerate(present.values())),
    )
    rows = F.array(
        *(
            F.struct(F.lit(name).alias("field"), F.col(f"_n_{i}").alias("n_nonnull"))
            for i, name in enumerate(present)
        )
    )
    ratio = F.try_divide(F.col("n_nonnull").cast("double"), F.col("n_total"))
    return wide.select("n_total", F.inline(rows)).select(
        "field",
        "n_nonnull",
        "n_total",
        F.coalesce(ratio, F.lit(0.0)).alias("pct_nonnull"),
    )


def run_counts(
    df: DataFrame, min_year: int, max_year: int, year: str = "year", order: str = ORDER_COLUMN
) -> DataFrame:
    """AGG14: rows read, rows with a year, rows after DED2 and rows in scope, in one pass.

    Per key only a count and the year of the first row are kept, so the shuffle carries no
    record fields; undated rows share one group that is already counted in the tasks.
    """
    key = record_key(
        F.col("eid"), F.col("doi"), F.col("title"), F.col(year), F.col("authors")
    )
    dated = F.col(year).isNotNull()
    per_key = (
        df.select(
            F.when(dated, key).alias("key"),
            F.col(year).alias("year"),
            F.col(order).alias("ord"),
        )
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("year", "ord").alias("first_year"))
    )
    is_record = F.col("key").isNotNull()

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return per_key.agg(
        total(F.col("n")).alias("rows_input"),
        total(F.when(is_record, F.col("n"))).alias("rows_raw"),
        F.count_if(is_record).alias("rows_deduplicated"),
        F.count_if(is_record & F.col("first_year").between(min_year, max_year)).alias(
            "rows_scoped"
        ),
    )


def report_kpis(df: DataFrame, year: str = "pub_year") -> DataFrame:
    """AGG15: distinct authors, journals and years, and dated publications, as one row.

    A record becomes tagged values, counted per value inside the tasks: one scan and one
    shuffle instead of a distinct count per field.
    """

    def tagged(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    values = F.concat(
        F.transform(split_items(F.col("authors")), lambda a: tagged("author", a)),
        F.array(
            tagged("journal", trim_text(F.col("journal"))),
            tagged("year", F.col(year).cast("string")),
        ),
    )
    per_value = (
        df.select(F.inline(values))
        .filter(F.col("value").isNotNull())
        .groupBy("kind", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def distinct(kind: str, name: str) -> Column:
        return F.count_if(F.col("kind") == kind).alias(name)

    return per_value.agg(
        distinct("author", "n_authors"),
        distinct("journal", "n_journals"),
        distinct("year", "n_years"),
        F.coalesce(F.sum(F.when(F.col("kind") == "year", F.col("n"))), F.lit(0))
        .cast("bigint")
        .alias("total_publications"),
    )
