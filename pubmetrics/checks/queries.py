"""One query per operator over the whole given tables.

Most run on `publications`, the record table derived from orders and line items. Ratios and
powers are rounded here, not in the library, so that two engines can be compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pubmetrics import functions as fn
from pubmetrics import operators as op, plans
from pubmetrics import sources as src
from pubmetrics.plans.clean import clean_records
from pubmetrics.plans.full import deduplicated, export_records, in_scope, with_year
from pubmetrics.views import ORDER_KEYS, publications, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# The scope and thresholds of the checks; narrow enough to leave rows out at every scale.
MIN_YEAR, MAX_YEAR = 1998, 2021
CLEAN_COLUMNS = ("src_ord", "eid", "cover_date", "pub_year")
KEY_COLUMNS = (*CLEAN_COLUMNS, "doi", "title", "authors")
EXPORT_HEADERS = {
    "eid": "EID",
    "doi": "DOI",
    "title": "Title",
    "cover_date": "cover_date",
    "pub_year": "Year",
    "authors": "Authors",
    "journal": "Source title",
    "doc_type": "Document Type",
    "author_keywords": "Author Keywords",
    "index_keywords": "Index Keywords",
    "affiliations": "Affiliations",
}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def cleaned(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Cleaned records; a field cleaning derives brings the columns it derives from."""
    needed = dict.fromkeys((*CLEAN_COLUMNS, *columns))
    if "authors" in needed:
        needed["creator"] = None
    raw = publications(spark, sf_dir, tuple(needed))
    absent = {c: F.lit(None).cast("string") for c in ("creator", "authors", "journal")}
    filled = raw.withColumns({c: v for c, v in absent.items() if c not in needed})
    return clean_records(filled).select(*needed)


def unique_records(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Dated records after the composite dedup, with `_year`."""
    wanted = tuple(dict.fromkeys((*KEY_COLUMNS, *columns)))
    return deduplicated(with_year(publications(spark, sf_dir, wanted)))


def scoped_records(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return in_scope(unique_records(spark, sf_dir, *columns), MIN_YEAR, MAX_YEAR)


def export_table(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """The record table under the headers of a CSV export; rows in order have their ORDER_KEYS too."""
    raw = publications(spark, sf_dir, ("src_ord", *EXPORT_HEADERS), in_order=in_order)
    keys = ORDER_KEYS if in_order else ()
    return raw.select("src_ord", *(F.col(c).alias(h) for c, h in EXPORT_HEADERS.items()), *keys)


def joined(items: Column) -> Column:
    return F.array_join(items, "; ")


# --- sources and sinks ---------------------------------------------------------------------


@query
def load_records(spark, sf_dir):
    """SRC1: a table by base path, format found by what exists."""
    return src.load_records(spark, f"{sf_dir}/documents")


@query
def ingest_records(spark, sf_dir):
    """SRC3 / SET1: record batches with different keys become one table."""
    raw = publications(spark, sf_dir, ("src_ord", "eid", "title", "journal", "doc_type"))
    firsts = raw.filter(F.col("src_ord") % 2 == 0).select("src_ord", "eid", "title", "journal")
    repeats = raw.filter(F.col("src_ord") % 2 == 1).select("src_ord", "eid", "title", "doc_type")
    return src.union_records([firsts, repeats])


@query
def ingest_whole_records(spark, sf_dir):
    """SRC3 / SET1: the whole record table from batches with different keys."""
    raw = publications(spark, sf_dir)
    firsts = raw.filter(F.col("src_ord") % 2 == 0).drop("doc_type", "index_keywords")
    repeats = raw.filter(F.col("src_ord") % 2 == 1).drop("journal", "creator")
    return src.union_records([firsts, repeats])


@query
def sliced_scan(spark, sf_dir):
    """SRC4 / SRC5: year slices, first record per id in slice order."""
    raw = publications(spark, sf_dir, (*CLEAN_COLUMNS, "doc_type"))
    dated = raw.withColumn(
        "year", fn.publication_year(F.col("pub_year"), F.col("cover_date"))
    )
    sliced = src.sliced_scan(dated, max_years_back=20, current_year=2018, year="year")
    return sliced.select("src_ord", "eid", "year", "doc_type")


@query
def sliced_store(spark, sf_dir):
    """SRC4 / SNK4: records stored by year and read back by slice."""
    raw = publications(spark, sf_dir, (*CLEAN_COLUMNS, "doc_type"))
    dated = raw.select(
        "src_ord",
        "eid",
        "doc_type",
        fn.publication_year(F.col("pub_year"), F.col("cover_date")).alias("year"),
    )
    path = src.shared_folder(spark, "sliced")
    src.write_sliced(dated, path, "year")
    return src.read_sliced(spark, path, 2003, 2009, year="year").select(
        "src_ord", "eid", "year", "doc_type"
    )


@query
def export_round_trip(spark, sf_dir):
    """SRC2 / SNK1: the whole table written as CSV, read back and deduplicated in file order."""
    path = src.write_records(
        export_table(spark, sf_dir, in_order=True), src.shared_folder(spark, "export"), "csv", order=ORDER_KEYS
    )
    raw = src.load_records(spark, path, ordered=True)
    return deduplicated(export_records(raw)).select(
        "_dedup_key", "_year", "title", "authors", "journal", "affiliations"
    )


def breaking_export(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """The export with line ends, quotes and separators inside fields."""
    broken = {
        "Title": F.concat("Title", F.lit('\n"'), "Document Type", F.lit('", said')),
        "Affiliations": F.replace("Affiliations", F.lit("; "), F.lit(";\r\n\n")),
    }
    return export_table(spark, sf_dir, in_order).withColumns(broken)


@query
def export_in_splits(spark, sf_dir):
    """SRC2: fields with line ends inside, each file read by as many tasks as it has splits."""
    path = src.write_records(
        breaking_export(spark, sf_dir, in_order=True), src.shared_folder(spark, "export"), "csv", order=ORDER_KEYS
    )
    return src.read_export(spark, path, multi_line="split")


@query
def export_headers(spark, sf_dir):
    """SRC2 / SCH1: one call over files whose headers differ in columns and order, and have a blank name."""
    folder = src.shared_folder(spark, "exports")
    rows = breaking_export(spark, sf_dir)
    odd = F.col("src_ord") % 2 == 1
    src.write_csv(rows.filter(~odd).select("EID", "Title", "DOI", "Year"), f"{folder}/part=1")
    other = rows.filter(odd).select("Year", F.col("Authors").alias(" "), "EID", "Title", "Affiliations")
    src.write_csv(other, f"{folder}/part=2")
    found = src.read_export(spark, [f"{folder}/part=1", f"{folder}/part=2"], multi_line="split")
    return found.withColumnRenamed("_c1", "unnamed")


@query
def converted_in_place(spark, sf_dir):
    """SNK1 / SNK2: a table turned into CSV and back under its own name, each time read while it is replaced."""
    base = src.shared_folder(spark, "converted")
    src.write_records(export_table(spark, sf_dir, in_order=True).drop(*ORDER_KEYS), base)
    for fmt in ("csv", "parquet"):
        src.write_records(src.load_records(spark, base, ordered=True), base, fmt, overwrite=True)
    return src.load_records(spark, base).drop("src_ord")


@query
def sliced_outliers(spark, sf_dir):
    """SRC4: a store in which a tenth of the years lie far outside the documented range."""
    path = src.shared_folder(spark, "sliced")
    src.write_sliced(spread_years(spark, sf_dir), path, "year")
    return src.read_sliced(spark, path, 2010, 150_000, year="year")


def spread_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = publications(spark, sf_dir, (*CLEAN_COLUMNS, "doc_type"))
    year = fn.publication_year(F.col("pub_year"), F.col("cover_date"))
    year = F.when(F.col("src_ord") % 10 == 0, year * 50 + F.col("src_ord").cast("int")).otherwise(year)
    return raw.select("src_ord", "eid", "doc_type", year.alias("year"))


@query
def stored_slice_counts(spark, sf_dir):
    """SRC6 / SRC7: records per year of a store, from its folders and footers."""
    path = src.shared_folder(spark, "sliced")
    src.write_sliced(spread_years(spark, sf_dir), path, "year")
    return src.stored_slice_counts(spark, path, "year")


@query
def slice_counts(spark, sf_dir):
    """SRC6: records per year slice."""
    raw = publications(spark, sf_dir, ("pub_year", "cover_date"))
    year = fn.publication_year(F.col("pub_year"), F.col("cover_date"))
    dated = raw.select(year.alias("year"))
    return src.slice_counts(src.in_slices(dated, MIN_YEAR, MAX_YEAR, year="year"), "year")


@query
def result_size(spark, sf_dir):
    """SRC6: matches of a search without reading the records."""
    return src.result_size(found_publications(spark, sf_dir))


@query
def covered_years(spark, sf_dir):
    """SRC7: slices with at least one record."""
    raw = publications(spark, sf_dir, ("pub_year", "cover_date"))
    year = fn.publication_year(F.col("pub_year"), F.col("cover_date"))
    dated = raw.select(year.alias("year"))
    return src.covered_years(src.in_slices(dated, 1979, 2025, year="year"), "year")


@query
def search_records(spark, sf_dir):
    """SRC8: terms and language over the whole document texts."""
    docs = table(spark, sf_dir, "documents")
    found = op.search_records(
        docs,
        ["text"],
        any_of=["ing the", "tion of", "und der"],
        all_of=["er"],
        limit_to={"lang": ["en", "de"]},
    )
    return found.select("doc_id", "lang", "source", "n_chars")


def found_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = publications(
        spark,
        sf_dir,
        (*CLEAN_COLUMNS, "title", "doc_type", "author_keywords", "index_keywords"),
    )
    dated = raw.withColumn("pub_year", fn.publication_year(F.col("pub_year"), F.col("cover_date")))
    return op.search_records(
        dated,
        ["title", "author_keywords", "index_keywords"],
        any_of=["Red Widget", "hot gear", "brand#7"],
        all_of=["study"],
        limit_to={"doc_type": ["1-URGENT", "2-HIGH", "5-LOW"]},
        min_year=1999,
        max_year=2015,
    )


@query
def search_publications(spark, sf_dir):
    """SRC8: terms in several fields, limited to years and document types."""
    return found_publications(spark, sf_dir).select("src_ord", "eid", "pub_year", "doc_type")


@query
def search_words(spark, sf_dir):
    """SRC8: whole words, phrases, beginnings of words and exclusions over the whole document texts."""
    docs = table(spark, sf_dir, "documents")
    words = op.Search.any_of("of the", "und der", "an*") & ~op.Search.all_of("ing", "thth*")
    found = op.search_records(docs, ["text"], words=words, limit_to={"lang": ["en", "de"]})
    return found.select("doc_id", "lang", "source")


@query
def search_phrases(spark, sf_dir):
    """SRC8: phrases over several fields, some limited to one of them; `gear` is not found inside a word."""
    phrase = op.Search.phrase
    words = (
        op.Search.any_of("red widget", "gear", phrase("brand 7", "index_keywords"))
        & (phrase("study of auto*", "title") | phrase("study of building", "title"))
    )
    raw = publications(
        spark, sf_dir, ("src_ord", "title", "author_keywords", "index_keywords")
    )
    fields = ["title", "author_keywords", "index_keywords"]
    return op.search_records(raw, fields, words=words).select("src_ord", "title")


@query
def dataset_scope(spark, sf_dir):
    """SNK4 / FLT3: scoped records with the derived key columns."""
    return scoped_records(spark, sf_dir).select(
        "src_ord", "eid", "title", "_year", "_eid", "_doi", "_t", "_a1", "_dedup_key"
    )


# --- schema --------------------------------------------------------------------------------


@query
def canonicalize(spark, sf_dir):
    """SCH1 / SCH2: export headers to the canonical schema; fields without a column are null."""
    headers = export_table(spark, sf_dir).drop("Index Keywords", "DOI")
    return op.canonicalize(headers, op.EXPORT_FIELDS, require_year=True)


@query
def canonicalize_all(spark, sf_dir):
    """SCH1 / SCH2: all export headers to the canonical schema, which takes no creator from an export."""
    return op.canonicalize(export_table(spark, sf_dir), op.EXPORT_FIELDS, require_year=True)


@query
def empty_dim_counts(spark, sf_dir):
    """SCH4: counts of a field the export lacks: no rows, right columns."""
    headers = export_table(spark, sf_dir).drop("Document Type")
    records = op.canonicalize(headers, op.EXPORT_FIELDS)
    return op.value_counts(records, "doc_type", "doctype", limit=25)


# --- projections ---------------------------------------------------------------------------


@query
def coerce_year(spark, sf_dir):
    """PRJ1."""
    raw = publications(spark, sf_dir, ("src_ord", "cover_date"))
    return raw.withColumn("year", fn.coerce_year(F.col("cover_date")))


@query
def derive_pub_year(spark, sf_dir):
    """PRJ2."""
    raw = publications(spark, sf_dir, ("src_ord", "cover_date", "pub_year"))
    year = fn.publication_year(F.col("pub_year"), F.col("cover_date"))
    return raw.select("src_ord", year.alias("year"))


@query
def strict_year(spark, sf_dir):
    """PRJ3: rows whose year column is not a number are dropped."""
    raw = publications(spark, sf_dir, ("src_ord", "pub_year"))
    return raw.select("src_ord", fn.numeric_year(F.col("pub_year")).alias("year")).filter(
        F.col("year").isNotNull()
    )


@query
def fill_authors(spark, sf_dir):
    """PRJ4."""
    raw = publications(spark, sf_dir, ("src_ord", "authors", "creator"))
    filled = fn.fill_authors(F.col("authors"), F.col("creator"))
    return raw.select("src_ord", filled.alias("authors"))


@query
def norm_text(spark, sf_dir):
    """PRJ6 over the whole document texts."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", fn.norm_text(F.col("text")).alias("text"))


@query
def norm_title(spark, sf_dir):
    """PRJ6 over record titles."""
    raw = publications(spark, sf_dir, ("src_ord", "title"))
    return raw.select("src_ord", fn.norm_text(F.col("title")).alias("title"))


@query
def split_keywords(spark, sf_dir):
    """PRJ7, repeats kept."""
    raw = publications(spark, sf_dir, ("src_ord", "index_keywords"))
    words = fn.split_keywords(F.col("index_keywords"))
    return raw.select(
        "src_ord", F.size(words).alias("n_keywords"), joined(words).alias("keywords")
    )


@query
def first_author(spark, sf_dir):
    """PRJ8."""
    raw = publications(spark, sf_dir, ("src_ord", "authors"))
    return raw.select("src_ord", fn.first_author(F.col("authors")).alias("first_author"))


@query
def dedup_key(spark, sf_dir):
    """PRJ10-PRJ12 on every dated record."""
    dated = with_year(publications(spark, sf_dir, KEY_COLUMNS)).filter("_year is not null")
    return op.with_record_key(dated, "_year").select("src_ord", "_dedup_key")


@query
def keyword_sets(spark, sf_dir):
    """PRJ13."""
    raw = publications(spark, sf_dir, ("src_ord", "author_keywords", "index_keywords"))
    return op.with_keyword_set(raw).select(
        "src_ord", F.size("keywords").alias("n_keywords"), joined("keywords").alias("keywords")
    )


@query
def year_bins(spark, sf_dir):
    """PRJ14."""
    raw = publications(spark, sf_dir, ("src_ord", "cover_date"))
    year = fn.coerce_year(F.col("cover_date"))
    return raw.select("src_ord", year.alias("year"), fn.year_bin(year).alias("bin"))


@query
def extract_countries(spark, sf_dir):
    """PRJ15 / PRJ16 / SET2."""
    raw = publications(spark, sf_dir, ("src_ord", "affiliations"))
    countries = fn.extract_countries(F.col("affiliations"))
    return raw.select(
        "src_ord",
        F.size(countries).alias("n_countries"),
        joined(F.array_sort(countries)).alias("countries"),
    )


@query
def country_alias(spark, sf_dir):
    """JON1: country tokens of all affiliations and the names they stand for."""
    raw = publications(spark, sf_dir, ("affiliations",))
    tokens = raw.select(F.explode(fn.country_tokens(F.col("affiliations"))).alias("token"))
    return op.tally(tokens, "token").select(
        "token", fn.country_alias(F.col("token")).alias("country"), "count"
    )


@query
def country_region(spark, sf_dir):
    """PRJ17 / JON2: countries of all records and their regions."""
    raw = publications(spark, sf_dir, ("affiliations",))
    countries = raw.select(F.explode(fn.extract_countries(F.col("affiliations"))).alias("country"))
    return op.with_region(op.tally(countries, "country")).select("country", "region", "count")


@query
def lenient_int(spark, sf_dir):
    """PRJ20: year text as a number, 0 where it is none."""
    raw = publications(spark, sf_dir, ("src_ord", "pub_year"))
    return raw.select("src_ord", fn.lenient_int(F.col("pub_year")).alias("value"))


# --- dedup ---------------------------------------------------------------------------------


@query
def dedup_eid(spark, sf_dir):
    """DED1: the null ids collapse to one row."""
    raw = publications(spark, sf_dir, ("src_ord", "eid", "title", "journal"))
    return op.keep_first(raw, "eid")


@query
def dedup_eid_keep_nulls(spark, sf_dir):
    """DED1 with every record without an id kept."""
    raw = publications(spark, sf_dir, ("src_ord", "eid", "title", "journal"))
    return op.keep_first(raw, "eid", nulls="keep")


@query
def dedup_composite(spark, sf_dir):
    """DED2."""
    return unique_records(spark, sf_dir, "journal").select(
        "src_ord", "_dedup_key", "_year", "journal"
    )


@query
def duplicate_stats(spark, sf_dir):
    """DED3."""
    return op.duplicate_stats(publications(spark, sf_dir, ("eid",)), "eid")


# --- counts --------------------------------------------------------------------------------


@query
def pubs_by_year(spark, sf_dir):
    """AGG1 / FLT1 / SRT1."""
    return op.annual_counts(cleaned(spark, sf_dir))


@query
def filter_years(spark, sf_dir):
    """FLT2: an open and a closed bound."""
    rows = op.filter_years(cleaned(spark, sf_dir), min_year=2004)
    return op.annual_counts(op.filter_years(rows, max_year=2016))


@query
def top_journals_all(spark, sf_dir):
    """AGG2 / PRJ5."""
    return op.value_counts(cleaned(spark, sf_dir, "journal"), "journal", keep_blank=True)


@query
def author_counts(spark, sf_dir):
    """AGG4 / PRJ9: repeats within a record count."""
    return op.item_counts(cleaned(spark, sf_dir, "authors"), "authors")


@query
def keyword_counts(spark, sf_dir):
    """AGG4 on author keywords."""
    return op.item_counts(cleaned(spark, sf_dir, "author_keywords"), "author_keywords")


@query
def top_journals(spark, sf_dir):
    """AGG3 / LIM1."""
    return op.value_counts(scoped_records(spark, sf_dir, "journal"), "journal", limit=25)


@query
def top_document_types(spark, sf_dir):
    """AGG3 / LIM1."""
    scoped = scoped_records(spark, sf_dir, "doc_type")
    return op.value_counts(scoped, "doc_type", "doctype", limit=25)


@query
def top_authors(spark, sf_dir):
    """AGG5 / LIM1."""
    return op.item_counts(scoped_records(spark, sf_dir), "authors", "author", limit=25)


# --- growth --------------------------------------------------------------------------------


@query
def yoy_growth(spark, sf_dir):
    """WIN1 / WIN2."""
    return rounded(op.yoy_growth(op.annual_counts(cleaned(spark, sf_dir))), "yoy_pct")


@query
def cagr(spark, sf_dir):
    """AGG9 / WIN5 / FLT5."""
    return rounded(op.cagr(op.annual_counts(cleaned(spark, sf_dir))), "cagr")


@query
def avg_last5_vs_prev5(spark, sf_dir):
    """AGG11 / WIN6."""
    growth = op.recent_growth(op.annual_counts(cleaned(spark, sf_dir)))
    return rounded(growth, "avg_last5", "avg_prev5", "avg_last5_vs_prev5")


@query
def growth_summary(spark, sf_dir):
    """AGG12 within year bounds."""
    rows = op.filter_years(cleaned(spark, sf_dir), 2000, 2019)
    growth = op.growth_summary(op.annual_counts(rows))
    return rounded(growth, "cagr", "avg_last5", "avg_prev5", "avg_last5_vs_prev5")


@query
def pubs_trend(spark, sf_dir):
    """AGG1 / WIN3 / WIN4 on the scoped records."""
    annual = op.annual_counts(scoped_records(spark, sf_dir), "_year", "year", "n_pubs")
    return rounded(op.trend(annual), "yoy_pct", "ma3")


@query
def kpi_interest(spark, sf_dir):
    """AGG10."""
    annual = op.annual_counts(scoped_records(spark, sf_dir), "_year", "year", "n_pubs")
    return rounded(op.kpi_interest(annual, MIN_YEAR, MAX_YEAR), "cagr")


# --- keywords ------------------------------------------------------------------------------


def scoped_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = scoped_records(spark, sf_dir, "author_keywords", "index_keywords")
    return op.with_keyword_set(scoped)


def raw_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = publications(spark, sf_dir, ("src_ord", "author_keywords", "index_keywords"))
    return op.with_keyword_set(raw)


@query
def keyword_freq(spark, sf_dir):
    """AGG6 / SRT2."""
    return op.keyword_frequency(scoped_keywords(spark, sf_dir))


@query
def top_keywords(spark, sf_dir):
    """LIM2."""
    return op.top_keywords(op.keyword_frequency(scoped_keywords(spark, sf_dir)))


def fifteenth(keyed: DataFrame) -> Column:
    """A document frequency that grows with the records."""
    return keyed.agg((F.count(F.lit(1)) / 15).alias("share")).scalar()


@query
def keyword_vocab(spark, sf_dir):
    """FLT6: keywords held by a fifteenth of the records."""
    keyed = raw_keywords(spark, sf_dir)
    return op.keyword_vocabulary(op.keyword_frequency(keyed), fifteenth(keyed))


@query
def keyword_cooccurrence_frequent(spark, sf_dir):
    """JON3: pairs within that vocabulary."""
    keyed = raw_keywords(spark, sf_dir)
    return op.keyword_cooccurrence(keyed, min_docs=fifteenth(keyed))


def frequent_keywords(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keyword sets of the scoped records, and their document frequencies, both stored."""
    sets = src.stored(scoped_keywords(spark, sf_dir).select("src_ord", "keywords"), "keywords")
    return sets, src.stored(op.keyword_frequency(sets), "frequency")


@query
def keyword_cooccurrence(spark, sf_dir):
    """AGG8 / JON4 on the scoped records, the default threshold."""
    sets, frequency = frequent_keywords(spark, sf_dir)
    return op.keyword_cooccurrence(sets, frequency=frequency)


@query
def keyword_edges_top(spark, sf_dir):
    """LIM3 by threshold: keywords that cannot carry a heavy edge are not paired."""
    sets, frequency = frequent_keywords(spark, sf_dir)
    codes = op.keyword_codes(frequency)
    return op.heaviest_edges(op.coded_sets(sets, codes), codes)


# --- geography -----------------------------------------------------------------------------


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.regions_over_time(unique_records(spark, sf_dir, "affiliations"), year="_year")


@query
def geo_regions_over_time(spark, sf_dir):
    """AGG7 / PRJ18 / FLT7: unscoped records, own periods."""
    return rounded(regions(spark, sf_dir), "N_pub")


@query
def geo_bubble_size(spark, sf_dir):
    """PRJ19."""
    return rounded(op.bubble_sizes(regions(spark, sf_dir)), "N_pub", "marker_size")


# --- quality -------------------------------------------------------------------------------


@query
def coverage(spark, sf_dir):
    """AGG13."""
    records = cleaned(spark, sf_dir, "journal", "authors", "author_keywords")
    return rounded(op.coverage(records), "pct_nonnull")


@query
def run_counts(spark, sf_dir):
    """AGG14."""
    records = with_year(publications(spark, sf_dir, KEY_COLUMNS))
    return op.run_counts(records, MIN_YEAR, MAX_YEAR, "_year")


@query
def report_kpis(spark, sf_dir):
    """AGG15."""
    return op.report_kpis(cleaned(spark, sf_dir, "authors", "journal"))


# --- phases --------------------------------------------------------------------------------


@query
def clean_run_record(spark, sf_dir):
    """SNK5 / AGG13 / DED3: the record of a clean run over the whole table, measured while it was written."""
    base = src.shared_folder(spark, "runs")
    names = {"authors": "author_names", "author_keywords": "authkeywords", "journal": "publicationName"}
    raw = publications(spark, sf_dir).withColumnsRenamed({**names, "creator": "dc:creator"})
    source = src.write_records(raw, f"{base}/raw")
    plans.run_clean(spark, base, "r", source=source)
    record = spark.read.json(plans.RunFiles(base, "r").metrics("clean"))
    per_field = F.array(
        *(
            F.struct(F.lit(f).alias("field"), F.col(f"coverage.{f}.n_nonnull").alias("n_nonnull"))
            for f in op.COVERAGE_FIELDS
        )
    )
    counts = ("rows_before", "rows_after", "duplicates_removed")
    return record.select("run_id", "output_format", *counts, F.inline(per_field))


@query
def full_run_record(spark, sf_dir):
    """SNK5 / AGG14: the record of a full analysis of the export."""
    base = src.shared_folder(spark, "runs")
    plans.run_full_analysis(export_table(spark, sf_dir), base, "r", MIN_YEAR, MAX_YEAR)
    record = spark.read.json(plans.RunFiles(base, "r").metrics("full_analysis"))
    counts = ("rows_input", "rows_raw", "rows_deduplicated", "rows_scoped")
    return record.select("run_id", "min_year", "max_year", *counts)
