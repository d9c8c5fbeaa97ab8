"""Text normalisation as Column expressions (PRJ5-PRJ11)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The code points a Unicode-aware strip removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set for a regular expression: Java's Unicode \s lacks x1c-x1f.
_WS_RUN = r"(?U)[\s\x1c-\x1f]+"

SEPARATOR = ";"


def trim_text(c: Column) -> Column:
    """Strip Unicode whitespace from both ends (`trim` alone strips only spaces)."""
    return F.btrim(c, F.lit(WHITESPACE))


def norm_text(c: Column) -> Column:
    """PRJ6: null becomes '', then trim, lowercase, one space per whitespace run."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _WS_RUN, " ")))


def split_items(c: Column) -> Column:
    """PRJ9: trimmed non-blank parts of a delimited string, case and repeats kept."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), SEPARATOR), trim_text)
    return F.filter(parts, lambda x: x != "")


def split_keywords(c: Column) -> Column:
    """PRJ7: normalised non-blank parts of a delimited string; null gives an empty array.

    The whole string is normalised once; a part then has at most one space at either end.
    """
    parts = F.transform(F.split(norm_text(c), SEPARATOR), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def keyword_set(*cols: Column) -> Column:
    """PRJ13: sorted distinct keywords over several delimited columns."""
    return F.sort_array(F.array_distinct(F.concat(*(split_keywords(c) for c in cols))))


def first_author(c: Column) -> Column:
    """PRJ8: normalised text before the first separator; null or blank gives ''."""
    return norm_text(F.substring_index(c, SEPARATOR, 1))


def fill_authors(authors: Column, creator: Column) -> Column:
    """PRJ4: a null author string takes the creator; a blank one stays blank."""
    return F.coalesce(authors, creator)


def norm_id(c: Column) -> Column:
    """PRJ10: null becomes '', trimmed, case kept."""
    return trim_text(F.coalesce(c, F.lit("")))


def norm_doi(c: Column) -> Column:
    """PRJ11: null becomes '', trimmed, lowercase."""
    return F.lower(norm_id(c))


def record_key(eid: Column, doi: Column, title: Column, year: Column, authors: Column) -> Column:
    """PRJ12: tiered identity of a record: id, else DOI, else title, year and first author."""
    eid, doi = norm_id(eid), norm_doi(doi)
    fallback = F.concat(
        F.lit("FALL:"),
        F.concat_ws("|", norm_text(title), year.cast("string"), first_author(authors)),
    )
    return (
        F.when(eid != "", F.concat(F.lit("EID:"), eid))
        .when(doi != "", F.concat(F.lit("DOI:"), doi))
        .otherwise(fallback)
    )
