"""Year-sliced record access (SRC4-SRC7)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pubmetrics.operators.dedup import keep_first
from pubmetrics.operators.schema import ORDER_COLUMN
from pubmetrics.sources.writers import staged_write

# Years with a folder of their own.
FIRST_SLICE, LAST_SLICE = 1900, 2100
SLICE_COLUMN = "_slice"
SCHEMA_FOLDER = "_schema"


def slice_bounds(
    start_year: int | None = None,
    end_year: int | None = None,
    max_years_back: int | None = None,
    current_year: int | None = None,
) -> tuple[int, int]:
    """SRC5: the given bounds; if either is missing, both follow from `max_years_back`."""
    if start_year is not None and end_year is not None:
        return int(start_year), int(end_year)
    if max_years_back is None:
        raise ValueError("give start_year and end_year, or max_years_back")
    last = current_year or datetime.now(timezone.utc).year
    return last - int(max_years_back) + 1, last


def in_slices(
    df: DataFrame,
    start_year: int | None = None,
    end_year: int | None = None,
    max_years_back: int | None = None,
    *,
    year: str = "pub_year",
    current_year: int | None = None,
) -> DataFrame:
    """Records of the slices. On a year-partitioned table only those partitions are read."""
    low, high = slice_bounds(start_year, end_year, max_years_back, current_year)
    return df.filter(F.col(year).between(low, high))


def sliced_scan(
    df: DataFrame,
    start_year: int | None = None,
    end_year: int | None = None,
    max_years_back: int | None = None,
    *,
    year: str = "pub_year",
    order: str = ORDER_COLUMN,
    current_year: int | None = None,
) -> DataFrame:
    """SRC4: records of the slices, first per id in slice order, then in input order."""
    rows = in_slices(
        df, start_year, end_year, max_years_back, year=year, current_year=current_year
    )
    if "eid" not in df.columns:
        return rows
    return keep_first(rows, "eid", order=F.struct(year, order))


def slice_counts(df: DataFrame, year: str = "pub_year") -> DataFrame:
    """SRC6: records per slice, from the year column alone."""
    return df.groupBy(F.col(year).alias("year")).agg(F.count(F.lit(1)).alias("n")).orderBy("year")


def result_size(df: DataFrame) -> DataFrame:
    """SRC6: records matching, as one row; no record field is read."""
    return df.agg(F.count(F.lit(1)).alias("n_results_estimated"))


def covered_years(df: DataFrame, year: str = "pub_year") -> DataFrame:
    """SRC7: slices holding at least one record."""
    return df.select(F.col(year).alias("year")).distinct().orderBy("year")


def year_slice(year: Column) -> Column:
    """The folder of a year: itself within the documented range, null, one folder, for all others."""
    return F.when(year.between(FIRST_SLICE, LAST_SLICE), year.cast("int"))


def with_slices(df: DataFrame, year: str) -> DataFrame:
    """The rows with their folder's column; a column of that name must not be there."""
    if SLICE_COLUMN in (c.lower() for c in df.columns):
        raise ValueError(f"column {SLICE_COLUMN} is taken")
    return df.withColumn(SLICE_COLUMN, year_slice(F.col(year)))


def within_slices(low: int, high: int) -> Column:
    """Condition on the folder's column that prunes those without a year from low to high."""
    some = F.col(SLICE_COLUMN).between(max(low, FIRST_SLICE), min(high, LAST_SLICE))
    return some | F.col(SLICE_COLUMN).isNull() if low < FIRST_SLICE or high > LAST_SLICE else some


def stored_slice_counts(spark: SparkSession, path: str, year: str = "pub_year") -> DataFrame:
    """SRC6 / SRC7: records per year of a store by `write_sliced`, years without any left out.

    Years with a folder are counted by folder: no column is read, the files' footers know their rows.
    Only the folder of all other years, null included, is counted by the year in its files.
    """
    stored = _store(spark, path)
    folder = F.col(SLICE_COLUMN)
    own = stored.filter(folder.isNotNull()).select(folder.alias("year"))
    rest = stored.filter(folder.isNull()).select(F.col(year).cast("int").alias("year"))
    counted = [slices.groupBy("year").agg(F.count(F.lit(1)).alias("n")) for slices in (own, rest)]
    return counted[0].unionByName(counted[1]).filter(F.col("year").isNotNull()).orderBy("year")


def _store(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/{SCHEMA_FOLDER}").schema
    return spark.read.schema(
        StructType([*schema, StructField(SLICE_COLUMN, IntegerType())])
    ).parquet(path)


def write_sliced(
    df: DataFrame, path: str, year: str = "pub_year", *, overwrite: bool = False
) -> None:
    """SRC4: store records by year, the layout the sliced reads prune.

    There is one folder for each year from 1900 to 2100 and one for all others, null included, however many
    there are; the year itself stays in the files. `rebalance` gathers each folder's rows into few
    files and lets adaptive execution split a year that holds much of the data over several tasks.
    """
    spark = df.sparkSession

    def write(staged: str) -> None:
        rows = with_slices(df, year).hint("rebalance", F.col(SLICE_COLUMN))
        rows.write.partitionBy(SLICE_COLUMN).parquet(staged)
        # Hidden from the table's readers; a store without rows has no other file with its schema.
        spark.createDataFrame([], df.schema).write.parquet(f"{staged}/{SCHEMA_FOLDER}")

    staged_write(spark, path, write, overwrite=overwrite)


def read_sliced(
    spark: SparkSession,
    path: str,
    start_year: int | None = None,
    end_year: int | None = None,
    max_years_back: int | None = None,
    *,
    year: str = "pub_year",
    current_year: int | None = None,
) -> DataFrame:
    """Slices of a table stored by `write_sliced`; the bounds prune its folders."""
    low, high = slice_bounds(start_year, end_year, max_years_back, current_year)
    stored = _store(spark, path)
    return in_slices(stored.filter(within_slices(low, high)), low, high, year=year).drop(SLICE_COLUMN)
