"""Countries of affiliation strings (PRJ15, PRJ16) and the default region table (PRJ17)."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, functions as F

from pubmetrics.functions.text import SEPARATOR, trim_text

# Country spellings mapped to the name used by the region table.
COUNTRY_ALIASES = {
    "usa": "united states",
    "us": "united states",
    "uk": "united kingdom",
    "uae": "united arab emirates",
    "viet nam": "vietnam",
}

# Region of each country.
COUNTRY_REGIONS = {
    "united states": "North America",
    "canada": "North America",
    "united kingdom": "Europe & Central Asia",
    "italy": "Europe & Central Asia",
    "france": "Europe & Central Asia",
    "germany": "Europe & Central Asia",
    "spain": "Europe & Central Asia",
    "turkey": "Europe & Central Asia",
    "saudi arabia": "Middle East & North Africa",
    "united arab emirates": "Middle East & North Africa",
    "qatar": "Middle East & North Africa",
    "iran": "Middle East & North Africa",
    "iran, islamic republic of": "Middle East & North Africa",
    "egypt": "Middle East & North Africa",
    "pakistan": "South Asia",
    "india": "South Asia",
    "bangladesh": "South Asia",
    "china": "East Asia & Pacific",
    "japan": "East Asia & Pacific",
    "malaysia": "East Asia & Pacific",
    "indonesia": "East Asia & Pacific",
    "singapore": "East Asia & Pacific",
    "australia": "East Asia & Pacific",
    "nigeria": "Sub-Saharan Africa",
    "south africa": "Sub-Saharan Africa",
    "brazil": "Latin America & Caribbean",
    "mexico": "Latin America & Caribbean",
}

UNKNOWN_REGION = "Unknown"


def country_alias(c: Column, aliases: Mapping[str, str] = COUNTRY_ALIASES) -> Column:
    """PRJ16: canonical name of a lowercase country token, itself if it has no alias."""
    if not aliases:
        return c
    pairs = F.create_map(*(F.lit(x) for x in chain.from_iterable(aliases.items())))
    return F.coalesce(F.try_element_at(pairs, c), c)


def country_tokens(c: Column) -> Column:
    """Last comma part of every affiliation, trimmed and lowercase, before aliasing."""
    segments = F.split(F.lower(F.coalesce(c, F.lit(""))), SEPARATOR)
    tokens = F.transform(segments, lambda s: trim_text(F.substring_index(s, ",", -1)))
    return F.filter(tokens, lambda t: t != "")


def extract_countries(c: Column, aliases: Mapping[str, str] = COUNTRY_ALIASES) -> Column:
    """PRJ15: distinct countries of a record; null or blank text gives an empty array."""
    return F.array_distinct(
        F.transform(country_tokens(c), lambda t: country_alias(t, aliases))
    )
