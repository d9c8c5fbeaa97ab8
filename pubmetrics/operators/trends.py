"""Annual series and growth (AGG1, AGG9-AGG12, WIN1-WIN6, FLT1-FLT3).

The windows here have no partition key: they run on the aggregated series, one row per
distinct year, never on records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def filter_years(
    df: DataFrame,
    min_year: int | None = None,
    max_year: int | None = None,
    year: str = "pub_year",
) -> DataFrame:
    """FLT1 / FLT2: rows with a year, within the inclusive bounds that are given."""
    out = df.filter(F.col(year).isNotNull())
    if min_year is not None:
        out = out.filter(F.col(year) >= min_year)
    if max_year is not None:
        out = out.filter(F.col(year) <= max_year)
    return out


def annual_counts(
    df: DataFrame, year: str = "pub_year", out_year: str | None = None, out_count: str = "count"
) -> DataFrame:
    """AGG1: publications per year, ascending; rows without a year are left out."""
    out_year = out_year or year
    dated = df.filter(F.col(year).isNotNull()).select(F.col(year).alias(out_year))
    return dated.groupBy(out_year).agg(F.count(F.lit(1)).alias(out_count)).orderBy(out_year)


def yoy_growth(annual: DataFrame, year: str = "pub_year", count: str = "count") -> DataFrame:
    """WIN2: change to the previous row; the percentage only where that row is positive."""
    prev = F.lag(count, 1).over(Window.orderBy(year))
    return (
        annual.select(F.col(year).alias("year"), F.col(count).alias("count"), prev.alias("_prev"))
        .withColumn("yoy_abs", (F.col("count") - F.col("_prev")).cast("double"))
        .withColumn("yoy_pct", F.when(F.col("_prev") > 0, F.col("yoy_abs") / F.col("_prev") * 100))
        .select("year", "count", "yoy_abs", "yoy_pct")
        .orderBy("year")
    )


def trend(annual: DataFrame, year: str = "year", count: str = "n_pubs") -> DataFrame:
    """WIN3 / WIN4: percentage change to the previous row and trailing three-row mean."""
    by_year = Window.orderBy(year)
    last3 = by_year.rowsBetween(-2, 0)
    change = F.try_divide(F.col(count).cast("double"), F.lag(count, 1).over(by_year))
    return annual.select(
        F.col(year).alias("year"),
        F.col(count).alias("n_pubs"),
        ((change - 1) * 100).alias("yoy_pct"),
        F.when(F.count(count).over(last3) == 3, F.avg(count).over(last3)).alias("ma3"),
    ).orderBy("year")


def _cagr_columns(year: str, count: str) -> list[Column]:
    used = F.when(F.col(count) > 0, F.col(year))
    start_year, end_year = F.min(used), F.max(used)
    start_count = F.min_by(F.col(count).cast("double"), used)
    end_count = F.max_by(F.col(count).cast("double"), used)
    span = end_year - start_year
    growth = F.pow(F.try_divide(end_count, start_count), F.try_divide(F.lit(1.0), span)) - 1
    return [
        start_year.alias("start_year"),
        end_year.alias("end_year"),
        start_count.alias("start_count"),
        end_count.alias("end_count"),
        F.coalesce(F.when(span > 0, growth), F.lit(0.0)).alias("cagr"),
    ]


def _recent_columns(count: str, rank: str) -> list[Column]:
    def mean_of(low: int, high: int) -> Column:
        total = F.sum(F.when(F.col(rank).between(low, high), F.col(count)))
        return F.when(F.count(F.lit(1)) >= 10, total / 5)

    last5, prev5 = mean_of(1, 5), mean_of(6, 10)
    return [
        last5.alias("avg_last5"),
        prev5.alias("avg_prev5"),
        F.try_divide(last5, prev5).alias("avg_last5_vs_prev5"),
    ]


def _ranked_from_last(annual: DataFrame, year: str) -> DataFrame:
    return annual.withColumn("_from_last", F.row_number().over(Window.orderBy(F.col(year).desc())))


def cagr(annual: DataFrame, year: str = "pub_year", count: str = "count") -> DataFrame:
    """AGG9: compound growth between the first and last nonzero year; 0.0 when undefined."""
    return annual.agg(*_cagr_columns(year, count))


def recent_growth(annual: DataFrame, year: str = "pub_year", count: str = "count") -> DataFrame:
    """AGG11: mean of the last five rows against the five before; null under ten rows."""
    return _ranked_from_last(annual, year).agg(*_recent_columns(count, "_from_last"))


def growth_summary(annual: DataFrame, year: str = "pub_year", count: str = "count") -> DataFrame:
    """AGG12: AGG9 and AGG11 in one row, from one pass over the series."""
    return _ranked_from_last(annual, year).agg(
        *_cagr_columns(year, count), *_recent_columns(count, "_from_last")
    )


def kpi_interest(
    annual: DataFrame,
    min_year: int,
    max_year: int,
    year: str = "year",
    count: str = "n_pubs",
) -> DataFrame:
    """AGG10: records, the requested bounds and growth with the span floored at one year.

    Unlike AGG9 an empty series gives null growth.
    """
    start, end = F.min_by(count, year), F.max_by(count, year)
    span = F.greatest(F.max(year) - F.min(year), F.lit(1))
    growth = F.pow(F.try_divide(end.cast("double"), start), F.lit(1.0) / span) - 1
    return annual.agg(
        F.coalesce(F.sum(count), F.lit(0)).cast("bigint").alias("docs"),
        F.lit(min_year).alias("year_min"),
        F.lit(max_year).alias("year_max"),
        F.when(F.count(F.lit(1)) > 0, growth).alias("cagr"),
    )
