"""Publication years as Column expressions (PRJ1-PRJ3, PRJ14, PRJ20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pubmetrics.functions.text import trim_text

# The default reporting periods, both ends inclusive.
YEAR_BINS = ((2002, 2006), (2007, 2011), (2012, 2016), (2017, 2021), (2022, 2025))

# `try_cast` alone would accept 'NaN' and '2020d'.
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def coerce_year(c: Column) -> Column:
    """PRJ1: first four characters of the trimmed text if all are digits, else null."""
    digits = F.regexp_extract(trim_text(c.cast("string")), "^([0-9]{4})", 1)
    return digits.try_cast("int")


def lenient_number(c: Column) -> Column:
    """Text to double; anything that is not a finite plain number gives null."""
    text = trim_text(c.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def numeric_year(c: Column) -> Column:
    """PRJ3: numeric text truncated to an int, anything else null."""
    return lenient_number(c).try_cast("int")


def lenient_int(c: Column, default: int = 0) -> Column:
    """PRJ20: numeric text truncated to a bigint, anything else the default."""
    return F.coalesce(lenient_number(c).try_cast("bigint"), F.lit(default).cast("bigint"))


def publication_year(pub_year: Column, cover_date: Column) -> Column:
    """PRJ2: numeric year, row-wise filled from the first four digits of the cover date."""
    return F.coalesce(numeric_year(pub_year), coerce_year(cover_date))


def bin_label(low: int, high: int) -> str:
    return f"{low}-{high}"


def year_bin(c: Column, bins: Sequence[tuple[int, int]] = YEAR_BINS) -> Column:
    """PRJ14: label of the period holding the year, else null."""
    out = F.lit(None).cast("string")
    for low, high in reversed(bins):
        out = F.when(c.between(low, high), F.lit(bin_label(low, high))).otherwise(out)
    return out
