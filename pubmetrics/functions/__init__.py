"""Column -> Column functions; all built-in expressions, no Python UDF."""

from pubmetrics.functions.places import (
    COUNTRY_ALIASES,
    COUNTRY_REGIONS,
    UNKNOWN_REGION,
    country_alias,
    country_tokens,
    extract_countries,
)
from pubmetrics.functions.text import (
    fill_authors,
    first_author,
    keyword_set,
    norm_doi,
    norm_id,
    norm_text,
    record_key,
    split_items,
    split_keywords,
    trim_text,
)
from pubmetrics.functions.years import (
    YEAR_BINS,
    bin_label,
    coerce_year,
    lenient_int,
    lenient_number,
    numeric_year,
    publication_year,
    year_bin,
)

__all__ = [
    "COUNTRY_ALIASES",
    "COUNTRY_REGIONS",
    "UNKNOWN_REGION",
    "YEAR_BINS",
    "bin_label",
    "coerce_year",
    "country_alias",
    "country_tokens",
    "extract_countries",
    "fill_authors",
    "first_author",
    "keyword_set",
    "lenient_int",
    "lenient_number",
    "norm_doi",
    "norm_id",
    "norm_text",
    "numeric_year",
    "publication_year",
    "record_key",
    "split_items",
    "split_keywords",
    "trim_text",
    "year_bin",
]
