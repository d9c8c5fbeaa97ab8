"""Keep-first deduplication and duplicate counts (DED1-DED3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pubmetrics.functions import record_key
from pubmetrics.operators.schema import ORDER_COLUMN


def keep_first(
    df: DataFrame,
    *keys: str,
    order: str | Column = ORDER_COLUMN,
    nulls: str = "collapse",
) -> DataFrame:
    """DED1: the first row per key in input order.

    The rank filter is planned as a group limit on both sides of the shuffle, so a map task
    sends at most one row per key however hot the key is. Null keys form one group;
    `nulls="keep"` keeps every row with a null key instead, each in a group of its own.
    """
    if nulls not in ("collapse", "keep"):
        raise ValueError(f"nulls must be 'collapse' or 'keep', not {nulls!r}")
    order = F.col(order) if isinstance(order, str) else order
    groups = [F.col(k) for k in keys]
    if nulls == "keep":
        any_null = F.lit(False)
        for k in groups:
            any_null = any_null | k.isNull()
        groups.append(F.when(any_null, order))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def keep_first_counted(
    df: DataFrame, key: str, *, order: str = ORDER_COLUMN, out: str = "_rows"
) -> DataFrame:
    """DED1 / DED3: the first row per key, and in `out` how many rows had that key.

    Rows are combined inside the map tasks, a row and a count per key, so a hot key (or the null
    one) stays small; what was removed is then known without reading the input again.
    """
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*(F.col(f"`{c}`") for c in rest)), order).alias("_first")
    rows = df.groupBy(key).agg(first, F.count(F.lit(1)).alias(out))
    columns = [F.col(key) if c == key else F.col(f"_first.`{c}`") for c in df.columns]
    return rows.select(*columns, out)


def with_record_key(df: DataFrame, year: str = "year") -> DataFrame:
    """PRJ12 as column `_dedup_key` of a canonical frame."""
    key = record_key(
        F.col("eid"), F.col("doi"), F.col("title"), F.col(year), F.col("authors")
    )
    return df.withColumn("_dedup_key", key)


def keep_first_record(df: DataFrame, year: str = "year", order: str = ORDER_COLUMN) -> DataFrame:
    """DED2: the first row per composite record key; adds `_dedup_key`."""
    return keep_first(with_record_key(df, year), "_dedup_key", order=order)


def duplicate_stats(df: DataFrame, *keys: str) -> DataFrame:
    """DED3: one row with rows before, rows after and duplicates removed.

    Only the keys and their partial counts are shuffled.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")
    kept = F.count(F.lit(1)).cast("bigint")
    return per_key.agg(
        total.alias("rows_before"),
        kept.alias("rows_after"),
        (total - kept).alias("duplicates_removed"),
    )
