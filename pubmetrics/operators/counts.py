"""Frequency tables (AGG2-AGG5, SRT2, LIM1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pubmetrics.functions import split_items, trim_text

TOP_N = 25


def ranked(df: DataFrame, item: str, count: str = "count", limit: int | None = None) -> DataFrame:
    """Most frequent first, ties by item; the limit is a per-task top-k, never a full sort."""
    out = df.orderBy(F.col(count).desc(), F.col(item).asc())
    return out if limit is None else out.limit(limit)


def tally(df: DataFrame, item: str) -> DataFrame:
    """Rows per item; counted inside every task before the shuffle, so hot items stay small."""
    return df.groupBy(item).agg(F.count(F.lit(1)).alias("count"))


def value_counts(
    df: DataFrame,
    column: str,
    out: str | None = None,
    *,
    limit: int | None = None,
    keep_blank: bool = False,
) -> DataFrame:
    """AGG2 / AGG3: occurrences of each trimmed value; null never counts, blank only if kept."""
    out = out or column
    values = df.select(trim_text(F.col(column)).alias(out)).filter(F.col(out).isNotNull())
    if not keep_blank:
        values = values.filter(F.col(out) != "")
    return ranked(tally(values, out), out, limit=limit)


def item_counts(
    df: DataFrame, column: str, out: str = "item", *, limit: int | None = None
) -> DataFrame:
    """AGG4 / AGG5: occurrences of each part of a delimited column; repeats in a row count."""
    return ranked(tally(explode_items(df, split_items(F.col(column)), out), out), out, limit=limit)


def explode_items(df: DataFrame, items: Column, out: str) -> DataFrame:
    return df.select(explode_nonempty(items).alias(out))


def explode_nonempty(items: Column) -> Column:
    """`explode` that evaluates a derived array once.

    Exploding a plain column makes Catalyst add a size filter on it and push that below the
    projection that derives the array, which is then evaluated twice.
    """
    return F.explode(F.when(F.size(items) > 0, items))
