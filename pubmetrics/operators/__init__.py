"""DataFrame -> DataFrame operators."""

from pubmetrics.operators.counts import item_counts, ranked, tally, value_counts
from pubmetrics.operators.dedup import (
    duplicate_stats,
    keep_first,
    keep_first_counted,
    keep_first_record,
    with_record_key,
)
from pubmetrics.operators.geo import bubble_sizes, region_table, regions_over_time, with_region
from pubmetrics.operators.keywords import (
    coded_sets,
    heaviest_edges,
    keyword_codes,
    keyword_cooccurrence,
    keyword_frequency,
    keyword_vocabulary,
    top_edges,
    top_keywords,
    with_keyword_set,
)
from pubmetrics.operators.quality import COVERAGE_FIELDS, coverage, report_kpis, run_counts
from pubmetrics.operators.schema import EXPORT_FIELDS, SEARCH_FIELDS, canonicalize, resolve_field
from pubmetrics.operators.search import Search, holds, mentions, search_records
from pubmetrics.operators.trends import (
    annual_counts,
    cagr,
    filter_years,
    growth_summary,
    kpi_interest,
    recent_growth,
    trend,
    yoy_growth,
)

__all__ = [
    "COVERAGE_FIELDS",
    "EXPORT_FIELDS",
    "SEARCH_FIELDS",
    "Search",
    "annual_counts",
    "bubble_sizes",
    "cagr",
    "canonicalize",
    "coded_sets",
    "coverage",
    "duplicate_stats",
    "filter_years",
    "growth_summary",
    "heaviest_edges",
    "holds",
    "item_counts",
    "keep_first",
    "keep_first_counted",
    "keep_first_record",
    "keyword_codes",
    "keyword_cooccurrence",
    "keyword_frequency",
    "keyword_vocabulary",
    "kpi_interest",
    "mentions",
    "ranked",
    "recent_growth",
    "region_table",
    "regions_over_time",
    "report_kpis",
    "resolve_field",
    "run_counts",
    "search_records",
    "tally",
    "top_edges",
    "top_keywords",
    "trend",
    "value_counts",
    "with_keyword_set",
    "with_record_key",
    "with_region",
    "yoy_growth",
]
