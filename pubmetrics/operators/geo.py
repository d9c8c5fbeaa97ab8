"""Regional activity over time (PRJ14-PRJ19, AGG7, FLT7)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pubmetrics.functions import (
    COUNTRY_ALIASES,
    COUNTRY_REGIONS,
    UNKNOWN_REGION,
    extract_countries,
    trim_text,
    year_bin,
)
from pubmetrics.functions.years import YEAR_BINS
from pubmetrics.operators.counts import explode_nonempty

BUBBLE_SCALE = 60


def region_table(spark: SparkSession, regions: Mapping[str, str] = COUNTRY_REGIONS) -> DataFrame:
    """PRJ17: the country to region lookup as a table.

    The built-in rows are literals of the plan and broadcast; a caller's own mapping becomes a table
    of any size without a hint.
    """
    if regions is not COUNTRY_REGIONS:
        return spark.createDataFrame(list(regions.items()), "country string, region string")
    rows = F.array(
        *(
            F.struct(F.lit(country).alias("country"), F.lit(region).alias("region"))
            for country, region in regions.items()
        )
    )
    return F.broadcast(spark.range(1).select(F.inline(rows)))


def with_region(
    df: DataFrame, country: str = "country", regions: DataFrame | None = None
) -> DataFrame:
    """JON2: region of each country, `Unknown` without a match.

    `regions` has one row per country; Catalyst chooses the join of a caller's table.
    """
    regions = region_table(df.sparkSession) if regions is None else regions
    lookup = regions.select(
        F.col("country").alias("_country"), F.col("region").alias("_region")
    )
    key = F.lower(trim_text(df[country]))
    return (
        df.join(lookup, key == F.col("_country"), "left")
        .withColumn("region", F.coalesce("_region", F.lit(UNKNOWN_REGION)))
        .drop("_country", "_region")
    )


def regions_over_time(
    df: DataFrame,
    *,
    year: str = "year",
    affiliations: str = "affiliations",
    bins: Sequence[tuple[int, int]] = YEAR_BINS,
    aliases: Mapping[str, str] = COUNTRY_ALIASES,
    regions: DataFrame | None = None,
) -> DataFrame:
    """AGG7: publications per period and region, each record's weight split over its countries.

    The records are reduced to whole counts per (period, country, countries in the record)
    before any weight is summed or any region looked up: counts combine inside the tasks and
    do not depend on the order of addition.
    """
    low, high = min(b[0] for b in bins), max(b[1] for b in bins)
    records = df.filter(F.col(year).between(low, high)).select(
        year_bin(F.col(year), bins).alias("bin"),
        extract_countries(F.col(affiliations), aliases).alias("countries"),
    )
    # A year between two periods explodes to nothing; filtering on the period instead would
    # push its whole derivation down to the scan, once per bound.
    binned = F.when(F.col("bin").isNotNull(), F.col("countries"))
    counts = (
        records.select(
            "bin", F.size("countries").alias("n"), explode_nonempty(binned).alias("country")
        )
        .groupBy("bin", "country", "n")
        .agg(F.count(F.lit(1)).alias("records"))
    )
    return (
        with_region(counts, "country", regions)
        .groupBy("bin", "region")
        .agg(F.sum(F.col("records") / F.col("n")).alias("N_pub"))
        .orderBy("bin", "region")
    )


def bubble_sizes(regions: DataFrame) -> DataFrame:
    """PRJ19: marker size of each (period, region) row, relative to the largest.

    The window spans the aggregated table only: periods times regions.
    """
    largest = F.greatest(F.max("N_pub").over(Window.partitionBy()), F.lit(1.0))
    return regions.withColumn("marker_size", F.sqrt(F.col("N_pub") / largest) * BUBBLE_SCALE)
