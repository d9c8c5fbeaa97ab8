"""SQL that DuckDB runs on the same tables, one statement per registered query.

The statements state each operator's result with the database's own functions; whitespace in
the derived records is ASCII, so its plain `trim` is enough there.
"""

from __future__ import annotations

from pubmetrics.functions import COUNTRY_ALIASES, COUNTRY_REGIONS, YEAR_BINS
from pubmetrics.views.publications import COUNTRIES

MIN_YEAR, MAX_YEAR = 1998, 2021

ORACLES: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g'))"


def parts(x: str, each: str = "trim(p)") -> str:
    """Non-blank parts of a `;` list, `each` applied to part `p`."""
    return (
        f"list_filter(list_transform(string_split(coalesce({x}, ''), ';'), "
        f"lambda p: {each}), lambda p: p <> '')"
    )


def distinct_sorted(x: str) -> str:
    return f"list_sort(list_distinct({x}))"


YEAR_OF_DATE = "try_cast(regexp_extract(trim(cover_date), '^([0-9]{4})', 1) AS INTEGER)"
YEAR_NUMBER = "CAST(trunc(try_cast(pub_year AS DOUBLE)) AS INTEGER)"
YEAR = f"coalesce({YEAR_NUMBER}, {YEAR_OF_DATE})"
KEYWORDS = (
    distinct_sorted(
        f"list_concat({parts('author_keywords', norm('p'))}, "
        f"{parts('index_keywords', norm('p'))})"
    )
)
TOKENS = parts("affiliations", "lower(trim(string_split(p, ',')[-1]))")
ALIAS_CASES = " ".join(
    f"WHEN {quoted(a)} THEN {quoted(c)}" for a, c in COUNTRY_ALIASES.items()
)
BIN_CASES = " ".join(
    f"WHEN {{y}} BETWEEN {low} AND {high} THEN '{low}-{high}'" for low, high in YEAR_BINS
)
REGION_ROWS = ", ".join(f"({quoted(c)}, {quoted(r)})" for c, r in COUNTRY_REGIONS.items())


def alias(x: str) -> str:
    return f"CASE {x} {ALIAS_CASES} ELSE {x} END"


def bin_of(y: str) -> str:
    return f"CASE {BIN_CASES.format(y=y)} END"


PLACES = f"list_distinct(list_transform({TOKENS}, lambda t: {alias('t')}))"

_LINE_ORDER = "ORDER BY l_linenumber, l_suppkey, l_partkey"
_COUNTRY_LIST = "[" + ", ".join(quoted(c) for c in COUNTRIES) + "]"

PUBS = f"""
lists AS (
  SELECT l_orderkey,
    string_agg(s_name, '; ' {_LINE_ORDER}) AS line_authors,
    string_agg(p_name, '; ' {_LINE_ORDER}) AS line_names,
    string_agg(p_type || ' ; ' || upper(p_brand), ';' {_LINE_ORDER}) AS line_types,
    string_agg(s_name || ', City, ' || ({_COUNTRY_LIST})[s_nationkey + 1], '; ' {_LINE_ORDER})
      AS line_places
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY l_orderkey
),
copies AS (
  SELECT o.*, 0 AS cp FROM orders o
  UNION ALL
  SELECT o.*, 1 AS cp FROM orders o WHERE o_orderkey % 11 = 0
),
base AS (
  SELECT *, o_orderkey AS k, CAST(year(o_orderdate) + o_orderkey % 24 AS VARCHAR) AS y,
    '  Study  Of ' || c_mktsegment || ' ' || CAST(o_orderkey % 97 AS VARCHAR) AS t
  FROM copies
  JOIN customer ON o_custkey = c_custkey
  LEFT JOIN lists ON l_orderkey = o_orderkey
),
pubs AS (
  SELECT
    CAST(k * 2 + cp AS BIGINT) AS src_ord,
    CASE WHEN k % 13 <> 0 THEN '2-s2.0-' || k END AS eid,
    CASE WHEN k % 5 <> 0 THEN ' 10.1000/X' || k || ' ' END AS doi,
    CASE WHEN cp = 1 THEN upper(t) ELSE t END AS title,
    CASE WHEN k % 19 = 0 THEN 'n/a' ELSE y || strftime(o_orderdate, '-%m-%d') END AS cover_date,
    CASE WHEN k % 3 = 0 THEN y WHEN k % 17 = 0 THEN 'n.d.' END AS pub_year,
    CASE WHEN line_authors IS NOT NULL THEN string_split(line_authors, ';')[1] END AS creator,
    CASE WHEN k % 7 <> 0 THEN line_authors END AS authors,
    CASE WHEN k % 23 <> 0 AND cp = 0
      THEN ' ' || c_mktsegment || ' Review ' || (c_nationkey % 8) END AS journal,
    o_orderpriority AS doc_type,
    line_names AS author_keywords,
    line_types AS index_keywords,
    line_places AS affiliations
  FROM base
)"""

DATED = f"""{PUBS},
dated AS (
  SELECT *, {YEAR} AS _year FROM pubs WHERE {YEAR} IS NOT NULL
),
keyed AS (
  SELECT *, trim(coalesce(eid, '')) AS _eid, lower(trim(coalesce(doi, ''))) AS _doi,
    {norm('title')} AS _t, {norm("string_split(trim(coalesce(authors, '')), ';')[1]")} AS _a1
  FROM dated
),
with_key AS (
  SELECT *, CASE WHEN _eid <> '' THEN 'EID:' || _eid WHEN _doi <> '' THEN 'DOI:' || _doi
    ELSE 'FALL:' || _t || '|' || _year || '|' || _a1 END AS _dedup_key
  FROM keyed
)"""

UNIQUE = f"""{DATED},
uniq AS (
  SELECT * FROM with_key
  QUALIFY row_number() OVER (PARTITION BY _dedup_key ORDER BY src_ord) = 1
),
scoped AS (SELECT * FROM uniq WHERE _year BETWEEN {MIN_YEAR} AND {MAX_YEAR})"""

CLEAN = f"""{PUBS},
firsts AS (
  SELECT * FROM pubs QUALIFY row_number() OVER (PARTITION BY eid ORDER BY src_ord) = 1
),
clean AS (
  SELECT eid, {YEAR} AS pub_year, coalesce(authors, creator) AS authors,
    trim(journal) AS journal, author_keywords
  FROM firsts
),
annual AS (
  SELECT pub_year, count(*) AS count FROM clean WHERE pub_year IS NOT NULL GROUP BY pub_year
)"""

SCOPED_ANNUAL = f"""{UNIQUE},
annual AS (SELECT _year AS year, count(*) AS n_pubs FROM scoped GROUP BY _year)"""

SCOPED_KEYWORDS = f"""{UNIQUE},
sets AS (SELECT src_ord, {KEYWORDS} AS kws FROM scoped),
held AS (SELECT src_ord, unnest(kws) AS keyword FROM sets),
freq AS (SELECT keyword, count(*) AS count FROM held GROUP BY keyword)"""

RAW_KEYWORDS = f"""{PUBS},
sets AS (SELECT src_ord, {KEYWORDS} AS kws FROM pubs),
held AS (SELECT src_ord, unnest(kws) AS keyword FROM sets),
freq AS (SELECT keyword, count(*) AS count FROM held GROUP BY keyword),
vocab AS (
  SELECT keyword FROM freq WHERE count >= (SELECT count(*) / 15.0 FROM sets)
)"""

EDGES = """
kept AS (SELECT src_ord, keyword FROM held JOIN vocab USING (keyword)),
edges AS (
  SELECT a.keyword AS "from", b.keyword AS "to", count(*) AS value
  FROM kept a JOIN kept b ON a.src_ord = b.src_ord AND a.keyword < b.keyword
  GROUP BY ALL
)"""

SCOPED_EDGES = f"""{SCOPED_KEYWORDS},
vocab AS (SELECT keyword FROM freq WHERE count >= 5),{EDGES}"""

REGIONS = f"""{UNIQUE},
places AS (
  SELECT {bin_of('_year')} AS bin, {PLACES} AS countries
  FROM uniq WHERE _year BETWEEN 2002 AND 2025
),
shares AS (
  SELECT bin, unnest(countries) AS country, 1.0::DOUBLE / len(countries) AS w
  FROM places WHERE len(countries) > 0
),
lookup(country, region) AS (VALUES {REGION_ROWS}),
agg AS (
  SELECT bin, coalesce(region, 'Unknown') AS region, sum(w) AS N_pub
  FROM shares LEFT JOIN lookup USING (country) GROUP BY ALL
)"""

FOUND = f"""{PUBS},
found AS (
  SELECT src_ord, eid, {YEAR} AS pub_year, doc_type FROM pubs
  WHERE {YEAR} BETWEEN 1999 AND 2015 AND doc_type IN ('1-URGENT', '2-HIGH', '5-LOW')
    AND contains(lower(concat_ws(' # ', title, author_keywords, index_keywords)), 'study')
    AND (contains(lower(concat_ws(' # ', title, author_keywords, index_keywords)), 'red widget')
      OR contains(lower(concat_ws(' # ', title, author_keywords, index_keywords)), 'hot gear')
      OR contains(lower(concat_ws(' # ', title, author_keywords, index_keywords)), 'brand#7'))
)"""


def oracle(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH {ctes.strip()}\n{select.strip()}"


ORACLES["load_records"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
oracle("ingest_records", PUBS, """
SELECT CAST(src_ord AS VARCHAR) AS src_ord, eid, title,
  CASE WHEN src_ord % 2 = 0 THEN journal END AS journal,
  CASE WHEN src_ord % 2 = 1 THEN doc_type END AS doc_type
FROM pubs""")
oracle("ingest_whole_records", PUBS, """
SELECT CAST(src_ord AS VARCHAR) AS src_ord, eid, doi, title, cover_date, pub_year,
  CASE WHEN src_ord % 2 = 0 THEN creator END AS creator, authors,
  CASE WHEN src_ord % 2 = 0 THEN journal END AS journal,
  CASE WHEN src_ord % 2 = 1 THEN doc_type END AS doc_type, author_keywords,
  CASE WHEN src_ord % 2 = 1 THEN index_keywords END AS index_keywords, affiliations
FROM pubs""")
oracle("sliced_scan", PUBS, f"""
SELECT src_ord, eid, {YEAR} AS year, doc_type FROM pubs WHERE {YEAR} BETWEEN 1999 AND 2018
QUALIFY row_number() OVER (PARTITION BY eid ORDER BY {YEAR}, src_ord) = 1""")
oracle("sliced_store", PUBS, f"""
SELECT src_ord, eid, {YEAR} AS year, doc_type FROM pubs WHERE {YEAR} BETWEEN 2003 AND 2009""")
oracle("export_round_trip", UNIQUE, """
SELECT _dedup_key, _year, title, authors, journal, affiliations FROM uniq""")
BROKEN = f"""{PUBS},
broken AS (
  SELECT * REPLACE (
    title || chr(10) || '"' || doc_type || '", said' AS title,
    replace(affiliations, '; ', ';' || chr(13) || chr(10) || chr(10)) AS affiliations)
  FROM pubs
)"""
oracle("export_in_splits", BROKEN, """
SELECT eid AS "EID", doi AS "DOI", title AS "Title", nullif(cover_date, 'n/a') AS cover_date, pub_year AS "Year",
  authors AS "Authors", journal AS "Source title", doc_type AS "Document Type",
  author_keywords AS "Author Keywords", index_keywords AS "Index Keywords",
  affiliations AS "Affiliations"
FROM broken""")
oracle("export_headers", BROKEN, """
SELECT eid AS "EID", title AS "Title", CASE WHEN src_ord % 2 = 0 THEN doi END AS "DOI",
  pub_year AS "Year", CASE WHEN src_ord % 2 = 1 THEN authors END AS unnamed,
  CASE WHEN src_ord % 2 = 1 THEN affiliations END AS "Affiliations"
FROM broken""")
oracle("converted_in_place", PUBS, """
SELECT eid AS "EID", doi AS "DOI", title AS "Title", nullif(cover_date, 'n/a') AS cover_date, pub_year AS "Year",
  authors AS "Authors", journal AS "Source title", doc_type AS "Document Type",
  author_keywords AS "Author Keywords", index_keywords AS "Index Keywords",
  affiliations AS "Affiliations"
FROM pubs""")
SPREAD = f"""{PUBS},
spread AS (
  SELECT src_ord, eid, doc_type,
    CAST(CASE WHEN src_ord % 10 = 0 THEN {YEAR} * 50 + src_ord ELSE {YEAR} END AS INTEGER) AS year
  FROM pubs
)"""
oracle("sliced_outliers", SPREAD, "SELECT * FROM spread WHERE year BETWEEN 2010 AND 150000")
oracle("stored_slice_counts", SPREAD, """
SELECT year, count(*) AS n FROM spread WHERE year IS NOT NULL GROUP BY year ORDER BY year""")
oracle("slice_counts", PUBS, f"""
SELECT {YEAR} AS year, count(*) AS n FROM pubs
WHERE {YEAR} BETWEEN {MIN_YEAR} AND {MAX_YEAR} GROUP BY 1 ORDER BY 1""")
oracle("result_size", FOUND, "SELECT count(*) AS n_results_estimated FROM found")
oracle("covered_years", PUBS, f"""
SELECT DISTINCT {YEAR} AS year FROM pubs WHERE {YEAR} BETWEEN 1979 AND 2025 ORDER BY 1""")
ORACLES["search_records"] = """
SELECT doc_id, lang, source, n_chars FROM documents
WHERE lang IN ('en', 'de') AND contains(lower(text), 'er')
  AND (contains(lower(text), 'ing the') OR contains(lower(text), 'tion of')
    OR contains(lower(text), 'und der'))"""
oracle("search_publications", FOUND, "SELECT src_ord, eid, pub_year, doc_type FROM found")


def words(x: str) -> str:
    """The words of a text, each between blanks."""
    return rf"' ' || regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g') || ' '"


ORACLES["search_words"] = f"""
WITH texts AS (SELECT *, {words('text')} AS w FROM documents WHERE lang IN ('en', 'de'))
SELECT doc_id, lang, source FROM texts
WHERE (contains(w, ' of the ') OR contains(w, ' und der ') OR contains(w, ' an'))
  AND NOT (contains(w, ' ing ') AND contains(w, ' thth'))"""
oracle("search_phrases", f"""{PUBS},
texts AS (
  SELECT src_ord, title, {words('title')} AS t, {words('author_keywords')} AS a,
    {words('index_keywords')} AS i
  FROM pubs
)""", """
SELECT src_ord, title FROM texts
WHERE (contains(t || '#' || a || '#' || i, ' red widget ') OR contains(t || '#' || a || '#' || i, ' gear ')
    OR contains(i, ' brand 7 '))
  AND (contains(t, ' study of auto') OR contains(t, ' study of building '))""")
oracle("dataset_scope", UNIQUE, """
SELECT src_ord, eid, title, _year, _eid, _doi, _t, _a1, _dedup_key FROM scoped""")

oracle("canonicalize", PUBS, """
SELECT src_ord, eid, CAST(NULL AS VARCHAR) AS doi, title, cover_date, pub_year,
  CAST(NULL AS VARCHAR) AS creator, authors, journal, doc_type, author_keywords,
  CAST(NULL AS VARCHAR) AS index_keywords, affiliations
FROM pubs""")
oracle("canonicalize_all", PUBS, """
SELECT src_ord, eid, doi, title, cover_date, pub_year, CAST(NULL AS VARCHAR) AS creator, authors,
  journal, doc_type, author_keywords, index_keywords, affiliations
FROM pubs""")
oracle("empty_dim_counts", PUBS, """
SELECT doc_type AS doctype, count(*) AS count FROM pubs WHERE false GROUP BY 1""")

oracle("coerce_year", PUBS, f"SELECT src_ord, cover_date, {YEAR_OF_DATE} AS year FROM pubs")
oracle("derive_pub_year", PUBS, f"SELECT src_ord, {YEAR} AS year FROM pubs")
oracle("strict_year", PUBS, f"""
SELECT src_ord, {YEAR_NUMBER} AS year FROM pubs WHERE {YEAR_NUMBER} IS NOT NULL""")
oracle("fill_authors", PUBS, "SELECT src_ord, coalesce(authors, creator) AS authors FROM pubs")
ORACLES["norm_text"] = f"SELECT doc_id, {norm('text')} AS text FROM documents"
oracle("norm_title", PUBS, f"SELECT src_ord, {norm('title')} AS title FROM pubs")
oracle("split_keywords", f"""{PUBS},
sets AS (SELECT src_ord, {parts('index_keywords', norm('p'))} AS kws FROM pubs)""", """
SELECT src_ord, CAST(len(kws) AS INTEGER) AS n_keywords,
  array_to_string(kws, '; ') AS keywords
FROM sets""")
oracle("first_author", PUBS, f"""
SELECT src_ord, {norm("string_split(trim(coalesce(authors, '')), ';')[1]")} AS first_author
FROM pubs""")
oracle("dedup_key", DATED, "SELECT src_ord, _dedup_key FROM with_key")
oracle("keyword_sets", RAW_KEYWORDS, """
SELECT src_ord, CAST(len(kws) AS INTEGER) AS n_keywords,
  array_to_string(kws, '; ') AS keywords
FROM sets""")
oracle("year_bins", PUBS, f"""
SELECT src_ord, {YEAR_OF_DATE} AS year, {bin_of(YEAR_OF_DATE)} AS bin FROM pubs""")
oracle("extract_countries", f"""{PUBS},
places AS (SELECT src_ord, {PLACES} AS countries FROM pubs)""", """
SELECT src_ord, CAST(len(countries) AS INTEGER) AS n_countries,
  array_to_string(list_sort(countries), '; ') AS countries
FROM places""")
oracle("country_alias", f"""{PUBS},
tokens AS (SELECT unnest({TOKENS}) AS token FROM pubs)""", f"""
SELECT token, {alias('token')} AS country, count(*) AS count FROM tokens GROUP BY ALL""")
oracle("country_region", f"""{PUBS},
places AS (SELECT unnest({PLACES}) AS country FROM pubs),
lookup(country, region) AS (VALUES {REGION_ROWS})""", """
SELECT country, coalesce(region, 'Unknown') AS region, count(*) AS count
FROM places LEFT JOIN lookup USING (country) GROUP BY ALL""")
oracle("lenient_int", PUBS, """
SELECT src_ord, coalesce(CAST(trunc(try_cast(pub_year AS DOUBLE)) AS BIGINT), 0) AS value
FROM pubs""")

oracle("dedup_eid", PUBS, """
SELECT src_ord, eid, title, journal FROM pubs
QUALIFY row_number() OVER (PARTITION BY eid ORDER BY src_ord) = 1""")
oracle("dedup_eid_keep_nulls", PUBS, """
SELECT src_ord, eid, title, journal FROM pubs
QUALIFY eid IS NULL OR row_number() OVER (PARTITION BY eid ORDER BY src_ord) = 1""")
oracle("dedup_composite", UNIQUE, "SELECT src_ord, _dedup_key, _year, journal FROM uniq")
oracle("duplicate_stats", PUBS, """
SELECT count(*) AS rows_before,
  count(DISTINCT eid) + CAST(bool_or(eid IS NULL) AS BIGINT) AS rows_after,
  count(*) - count(DISTINCT eid) - CAST(bool_or(eid IS NULL) AS BIGINT) AS duplicates_removed
FROM pubs""")

oracle("pubs_by_year", CLEAN, "SELECT pub_year, count FROM annual ORDER BY pub_year")
oracle("filter_years", CLEAN, """
SELECT pub_year, count FROM annual WHERE pub_year BETWEEN 2004 AND 2016 ORDER BY pub_year""")
oracle("top_journals_all", CLEAN, """
SELECT journal, count(*) AS count FROM clean WHERE journal IS NOT NULL
GROUP BY journal ORDER BY count DESC, journal""")
oracle("author_counts", CLEAN, f"""
SELECT item, count(*) AS count FROM (SELECT unnest({parts('authors')}) AS item FROM clean)
GROUP BY item ORDER BY count DESC, item""")
oracle("keyword_counts", CLEAN, f"""
SELECT item, count(*) AS count
FROM (SELECT unnest({parts('author_keywords')}) AS item FROM clean)
GROUP BY item ORDER BY count DESC, item""")
oracle("top_journals", UNIQUE, """
SELECT trim(journal) AS journal, count(*) AS count FROM scoped
WHERE trim(journal) <> '' GROUP BY 1 ORDER BY count DESC, 1 LIMIT 25""")
oracle("top_document_types", UNIQUE, """
SELECT trim(doc_type) AS doctype, count(*) AS count FROM scoped
WHERE trim(doc_type) <> '' GROUP BY 1 ORDER BY count DESC, 1 LIMIT 25""")
oracle("top_authors", UNIQUE, f"""
SELECT author, count(*) AS count FROM (SELECT unnest({parts('authors')}) AS author FROM scoped)
GROUP BY author ORDER BY count DESC, author LIMIT 25""")

oracle("yoy_growth", CLEAN, """
SELECT pub_year AS year, count, CAST(count - prev AS DOUBLE) AS yoy_abs,
  CASE WHEN prev > 0 THEN round((count - prev) / CAST(prev AS DOUBLE) * 100, 6) END AS yoy_pct
FROM (SELECT *, lag(count) OVER (ORDER BY pub_year) AS prev FROM annual) ORDER BY year""")

CAGR_SELECT = """
  min(pub_year) AS start_year, max(pub_year) AS end_year,
  CAST(arg_min(count, pub_year) AS DOUBLE) AS start_count,
  CAST(arg_max(count, pub_year) AS DOUBLE) AS end_count,
  round(CASE WHEN max(pub_year) > min(pub_year)
    THEN pow(CAST(arg_max(count, pub_year) AS DOUBLE) / arg_min(count, pub_year),
      1.0::DOUBLE / (max(pub_year) - min(pub_year))) - 1 ELSE 0.0 END, 6) AS cagr"""
RECENT_SELECT = """
  round(CASE WHEN count(*) >= 10
    THEN CAST(sum(count) FILTER (rn <= 5) AS DOUBLE) / 5 END, 6) AS avg_last5,
  round(CASE WHEN count(*) >= 10
    THEN CAST(sum(count) FILTER (rn BETWEEN 6 AND 10) AS DOUBLE) / 5 END, 6) AS avg_prev5,
  round(CASE WHEN count(*) >= 10 THEN CAST(sum(count) FILTER (rn <= 5) AS DOUBLE)
    / nullif(sum(count) FILTER (rn BETWEEN 6 AND 10), 0) END, 6) AS avg_last5_vs_prev5"""
RANKED = "(SELECT *, row_number() OVER (ORDER BY pub_year DESC) AS rn FROM {})"

oracle("cagr", CLEAN, f"SELECT {CAGR_SELECT} FROM annual")
oracle("avg_last5_vs_prev5", CLEAN, f"SELECT {RECENT_SELECT} FROM {RANKED.format('annual')}")
oracle("growth_summary", f"""{CLEAN},
bounded AS (SELECT * FROM annual WHERE pub_year BETWEEN 2000 AND 2019)""", f"""
SELECT {CAGR_SELECT}, {RECENT_SELECT} FROM {RANKED.format('bounded')}""")
oracle("pubs_trend", SCOPED_ANNUAL, """
SELECT year, n_pubs,
  round((CAST(n_pubs AS DOUBLE) / lag(n_pubs) OVER (ORDER BY year) - 1) * 100, 6) AS yoy_pct,
  round(CASE WHEN count(*) OVER w = 3 THEN avg(n_pubs) OVER w END, 6) AS ma3
FROM annual
WINDOW w AS (ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ORDER BY year""")
oracle("kpi_interest", SCOPED_ANNUAL, f"""
SELECT CAST(coalesce(sum(n_pubs), 0) AS BIGINT) AS docs,
  CAST({MIN_YEAR} AS INTEGER) AS year_min, CAST({MAX_YEAR} AS INTEGER) AS year_max,
  round(pow(CAST(arg_max(n_pubs, year) AS DOUBLE) / arg_min(n_pubs, year),
    1.0::DOUBLE / greatest(max(year) - min(year), 1)) - 1, 6) AS cagr
FROM annual""")

oracle("keyword_freq", SCOPED_KEYWORDS, """
SELECT keyword, count FROM freq ORDER BY count DESC, keyword""")
oracle("top_keywords", SCOPED_KEYWORDS, """
SELECT keyword, count FROM freq ORDER BY count DESC, keyword LIMIT 20""")
oracle("keyword_vocab", RAW_KEYWORDS, "SELECT keyword FROM vocab")
oracle("keyword_cooccurrence_frequent", f"{RAW_KEYWORDS},{EDGES}", "SELECT * FROM edges")
oracle("keyword_cooccurrence", SCOPED_EDGES, "SELECT * FROM edges")
oracle("keyword_edges_top", SCOPED_EDGES, """
SELECT * FROM edges ORDER BY value DESC, "from", "to" LIMIT 400""")

oracle("geo_regions_over_time", REGIONS, """
SELECT bin, region, round(N_pub, 6) AS N_pub FROM agg ORDER BY bin, region""")
oracle("geo_bubble_size", REGIONS, """
SELECT bin, region, round(N_pub, 6) AS N_pub,
  round(sqrt(N_pub / greatest((SELECT max(N_pub) FROM agg), 1.0)) * 60, 6) AS marker_size
FROM agg ORDER BY bin, region""")

oracle("coverage", CLEAN, " UNION ALL ".join(
    f"SELECT '{field}' AS field, count({col}) AS n_nonnull, count(*) AS n_total, "
    f"round(count({col}) / CAST(count(*) AS DOUBLE), 6) AS pct_nonnull FROM clean"
    for field, col in (
        ("pub_year", "pub_year"),
        ("journal", "journal"),
        ("authors", "authors"),
        ("keywords", "author_keywords"),
    )
))
oracle("run_counts", UNIQUE, """
SELECT (SELECT count(*) FROM pubs) AS rows_input, (SELECT count(*) FROM dated) AS rows_raw,
  (SELECT count(*) FROM uniq) AS rows_deduplicated, (SELECT count(*) FROM scoped) AS rows_scoped""")
oracle("report_kpis", CLEAN, f"""
SELECT (SELECT count(DISTINCT item) FROM (SELECT unnest({parts('authors')}) AS item FROM clean))
    AS n_authors,
  (SELECT count(DISTINCT journal) FROM clean) AS n_journals,
  (SELECT count(*) FROM annual) AS n_years,
  (SELECT CAST(coalesce(sum(count), 0) AS BIGINT) FROM annual) AS total_publications""")
oracle("clean_run_record", CLEAN, """
SELECT 'r' AS run_id, 'parquet' AS output_format, (SELECT count(*) FROM pubs) AS rows_before,
  (SELECT count(*) FROM clean) AS rows_after,
  (SELECT count(*) FROM pubs) - (SELECT count(*) FROM clean) AS duplicates_removed, field, n_nonnull
FROM (""" + " UNION ALL ".join(
    f"SELECT '{field}' AS field, count({col}) AS n_nonnull FROM clean"
    for field, col in (
        ("pub_year", "pub_year"),
        ("journal", "journal"),
        ("authors", "authors"),
        ("keywords", "author_keywords"),
    )
) + ")")
oracle("full_run_record", UNIQUE, f"""
SELECT 'r' AS run_id, CAST({MIN_YEAR} AS BIGINT) AS min_year, CAST({MAX_YEAR} AS BIGINT) AS max_year,
  (SELECT count(*) FROM pubs) AS rows_input, (SELECT count(*) FROM dated) AS rows_raw,
  (SELECT count(*) FROM uniq) AS rows_deduplicated, (SELECT count(*) FROM scoped) AS rows_scoped""")
