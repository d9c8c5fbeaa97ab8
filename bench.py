"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores),
BENCH_RUNS (timed runs per query, default 2; the fastest counts), BENCH_QUERIES (names
separated by commas, default the headline list). The two runs at the end time whole phases
with all their tables written, from records landed as parquet beforehand.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pubmetrics import plans  # noqa: E402
from pubmetrics.checks import QUERIES  # noqa: E402
from pubmetrics.checks.queries import export_table  # noqa: E402
from pubmetrics.sources import load_records, shared_folder, write_records  # noqa: E402
from pubmetrics.views import publications  # noqa: E402

HEADLINE = (
    "sliced_scan",
    "search_records",
    "canonicalize",
    "norm_text",
    "dedup_eid",
    "dedup_composite",
    "duplicate_stats",
    "pubs_by_year",
    "pubs_trend",
    "growth_summary",
    "top_journals",
    "author_counts",
    "keyword_freq",
    "keyword_cooccurrence",
    "keyword_edges_top",
    "geo_regions_over_time",
    "coverage",
    "run_counts",
    "report_kpis",
)


def seconds(spark: SparkSession, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def phase_seconds(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """One run of the full analysis, and one of clean and analyze."""
    base = shared_folder(spark, "bench")
    export = write_records(export_table(spark, sf_dir), f"{base}/export")
    raw = publications(spark, sf_dir).withColumnRenamed("authors", "author_names")
    landed = write_records(raw.withColumnRenamed("author_keywords", "authkeywords"), f"{base}/raw")
    start = time.perf_counter()
    plans.run_full_analysis(load_records(spark, export, ordered=True), base, "bench")
    middle = time.perf_counter()
    plans.run_clean(spark, base, "bench", source=landed)
    plans.run_analyze(spark, base, "bench")
    end = time.perf_counter()
    return {
        "full_analysis_run": round(middle - start, 3),
        "clean_and_analyze_run": round(end - middle, 3),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    partitions = str(os.cpu_count() if cpus == "*" else int(cpus))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pubmetrics-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds(spark, sf_dir, "pubs_by_year")
    best = {}
    for name in names:
        best[name] = round(min(seconds(spark, sf_dir, name) for _ in range(max(runs, 1))), 3)
    if not chosen:
        best.update(phase_seconds(spark, sf_dir))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
