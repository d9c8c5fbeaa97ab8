"""Phases end to end on a small export with hand-derived results."""

import pytest

from conftest import rows
from pubmetrics import plans
from pubmetrics import sources as src

# Ten dated years with a gap (2013), an undated row, an id three times, two rows without an id
# (one record under the default null handling), a blank and a null journal.
RAW = "title,pub_year,eid,author_names,publicationName,authkeywords,coverDate\n" + "".join(
    (
        "Ports,2008,p1,Ana; Ben,Harbour Studies,ports; tolls,\n",
        "Ships,,p2,Cid,Harbour Studies,ships,2009-05-01\n",
        "Cranes,2010,p3,Ana,Crane Notes,,\n",
        "Cranes again,2010,p3,Ana,Crane Notes,,\n",
        "Cranes once more,2011,p3,Ana,Crane Notes,,\n",
        "Tides,2011,p4,Ben,,tolls,\n",
        "Locks,2012,p5,Cid; Ana,  ,locks,\n",
        "Rivers,2014,p6,Dot,River Letters,ports,\n",
        "Dams,2015,p7,Dot,River Letters,,\n",
        "Weirs,2016,p8,Eli,River Letters,,\n",
        "Fish,2017,p9,Eli,River Letters,,\n",
        "Nets,2018,p10,Eli,Crane Notes,,\n",
        "No date,,p11,Fay,Crane Notes,,\n",
        "No id,2018,,Fay,Harbour Studies,,\n",
        "No id either,2018,,Gus,Harbour Studies,,\n",
    )
)
YEARS = [(2008, 1), (2009, 1), (2010, 1), (2011, 1), (2012, 1), (2014, 1), (2015, 1), (2016, 1), (2017, 1), (2018, 2)]


@pytest.fixture
def raw_csv(tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(RAW)
    return str(path)


def test_clean_then_analyze(spark, tmp_path, raw_csv):
    base = str(tmp_path / "runs")
    out = plans.run_clean(spark, base, "r1", source=raw_csv)
    years = {r.eid: r.pub_year for r in out["records"].collect()}
    assert len(years) == 12 and (years["p2"], years["p3"], years["p11"], years[None]) == (2009, 2010, None, 2018)
    assert rows(out["pubs_by_year"]) == YEARS
    assert dict(rows(out["keyword_freq"])) == {"ports": 2, "tolls": 2, "ships": 1, "locks": 1}
    metrics = spark.read.json(f"{base}/outputs/methods/clean").first()
    assert (metrics.rows_before, metrics.rows_after, metrics.duplicates_removed) == (15, 12, 3)
    growth = plans.run_analyze(spark, base, "r1")
    assert [tuple(r)[:2] for r in growth["yoy_growth"].collect()] == YEARS
    assert rows(growth["cagr"])[0][:4] == (2008, 2018, 1.0, 2.0)


def test_clean_replaces_a_run_only_when_told(spark, tmp_path, raw_csv):
    base = str(tmp_path / "runs")
    plans.run_clean(spark, base, "r1", source=raw_csv)
    with pytest.raises(FileExistsError):
        plans.run_clean(spark, base, "r1", source=raw_csv)
    later = tmp_path / "later.csv"
    later.write_text("title,pub_year,eid\nOne,1999,x\n")
    plans.run_clean(spark, base, "r1", source=str(later), fmt="csv", overwrite=True)
    # The other format's earlier rows are gone, and the run has one row of metrics.
    assert rows(plans.run_analyze(spark, base, "r1", min_year=1990)["pubs_by_year_scoped"]) == [(1999, 1)]
    assert spark.read.json(f"{base}/outputs/methods/clean").count() == 1


def test_padded_id_header_is_deduplicated(spark):
    raw = spark.createDataFrame([(1, "a", "2001"), (2, "a", "2002")], "src_ord int, ` eid ` string, pub_year string")
    assert plans.clean(raw).count() == 1


def test_full_analysis_of_an_empty_scope(spark, tmp_path):
    raw = spark.createDataFrame([(1, "a", None, "2019-01-01")], "src_ord int, EID string, Year string, coverDate string")
    lazy = rows(plans.full_analysis(raw, strict=True)["kpi_interest"])
    base = str(tmp_path / "runs")
    stored = plans.run_full_analysis(raw, base, "e", strict=True)
    assert rows(stored["kpi_interest"]) == lazy and lazy[0][0] == 0
    assert stored["dataset_scope"].count() == 0


def test_clean_without_an_id_column_keeps_all_rows(spark):
    raw = spark.createDataFrame([("A", "2020"), ("A", "2020")], "title string, pub_year string")
    assert plans.clean(raw).count() == 2
    with pytest.raises(ValueError, match="src_ord"):
        plans.clean(spark.createDataFrame([("1",)], "eid string"))


def test_ingest_single_and_sliced(spark, tmp_path, raw_csv):
    base = str(tmp_path / "runs")
    raw = src.load_records(spark, raw_csv, ordered=True)
    assert plans.run_ingest(raw, base, "one").count() == 15
    with pytest.raises(FileExistsError):
        plans.run_ingest(raw, base, "one", fmt="csv")
    sliced = plans.run_ingest(raw, base, "two", slicing=True, start_year=2016, end_year=2030)
    assert sorted(str(r.eid) for r in sliced.collect()) == ["None", "p10", "p8", "p9"]
    text = plans.run_ingest(raw, base, "three", slicing=True, max_years_back=50, fmt="csv")
    assert text.count() == 11
    metrics = {r.run_id: r for r in spark.read.json(f"{base}/outputs/methods/ingest").collect()}
    assert metrics["one"].n_records_downloaded == 15 and metrics["one"].strategy_used == "single"
    assert metrics["two"].n_results_estimated == 15
    assert metrics["two"].n_records_downloaded == 4
    assert list(metrics["two"].years_covered) == [2016, 2017, 2018]
    assert "author_names" in metrics["two"].columns_present
    # The next phase finds the landed run by its id.
    assert plans.run_clean(spark, base, "one")["records"].count() == 12
    assert plans.run_clean(spark, base, "three")["records"].count() == 11


EXPORT = "Authors,Title,Year,Source title,DOI,EID,Affiliations,Author Keywords,Index Keywords,Document Type,Cited\n" + "".join(
    f'"Au{i % 3}; Bo",T{i},{2000 + i % 4},J{i % 2},10.1/{i},e{i % 8},'
    f'"Lab, Italy; Lab, {"USA" if i % 2 else "Qatar"}",Alpha; beta,GAMMA,Article,{i}\n'
    for i in range(10)
)


@pytest.fixture
def export(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(EXPORT)
    return src.read_export(spark, str(path), ordered=True)


def check_full(tables):
    assert rows(tables["pubs_by_year"]) == [
        (2000, 2, None, None), (2001, 2, 0.0, None), (2002, 2, 0.0, 2.0), (2003, 2, 0.0, 2.0)
    ]
    assert rows(tables["kpi_interest"]) == [(8, 1983, 2025, 0.0)]
    assert rows(tables["top_authors"])[0] == ("Bo", 8)
    assert rows(tables["top_document_types"]) == [("Article", 8)]
    assert rows(tables["keyword_freq"]) == [("alpha", 8), ("beta", 8), ("gamma", 8)]
    assert sorted(rows(tables["keyword_edges"])) == [
        ("alpha", "beta", 8), ("alpha", "gamma", 8), ("beta", "gamma", 8)
    ]
    assert rows(tables["bubble_regions_over_time"]) == [
        ("2002-2006", "Europe & Central Asia", 2.0),
        ("2002-2006", "Middle East & North Africa", 1.0),
        ("2002-2006", "North America", 1.0),
    ]
    assert tables["dataset_scope"].count() == 8
    assert {"_year", "_eid", "_doi", "_t", "_a1", "_dedup_key", "Cited"} <= set(
        tables["dataset_scope"].columns
    )


def test_full_analysis_lazy(export):
    check_full(plans.full_analysis(export))


def test_full_analysis_stored(spark, export, tmp_path):
    base = str(tmp_path / "runs")
    tables = plans.run_full_analysis(export, base, "f1")
    check_full(tables)
    counts = spark.read.json(f"{base}/outputs/methods/full_analysis").first()
    assert (counts.rows_input, counts.rows_raw) == (10, 10)
    assert (counts.rows_deduplicated, counts.rows_scoped) == (8, 8)
    stored = src.read_export(spark, f"{base}/outputs/full_analysis/f1/keyword_freq")
    assert rows(stored) == [("alpha", "8"), ("beta", "8"), ("gamma", "8")]
    with pytest.raises(FileExistsError):
        plans.run_full_analysis(export, base, "f1")
    check_full(plans.run_full_analysis(export, base, "f1", overwrite=True))


def test_full_analysis_reads_dates_or_only_numbers(spark):
    raw = spark.createDataFrame(
        [(1, "a", None, "2019-01-01"), (2, "b", "2020", None)],
        "src_ord int, EID string, Year string, coverDate string",
    )
    loose = plans.full_analysis(raw)["pubs_by_year"]
    assert [r.year for r in loose.collect()] == [2019, 2020]
    assert [r.year for r in plans.full_analysis(raw, strict=True)["pubs_by_year"].collect()] == [2020]


def test_years_are_covered_before_dedup(spark, tmp_path):
    records = spark.createDataFrame([(1, "a", "2001"), (2, "a", "2002")], "src_ord int, eid string, pub_year string")
    landed = plans.run_ingest(records, str(tmp_path), "r", slicing=True, start_year=2000, end_year=2003)
    assert [r.eid for r in landed.collect()] == ["a"]
    metrics = spark.read.json(plans.RunFiles(str(tmp_path), "r").metrics("ingest")).first()
    assert list(metrics.years_covered) == [2001, 2002]
    assert (metrics.n_results_estimated, metrics.n_records_downloaded) == (2, 1)
