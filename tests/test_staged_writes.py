"""Tables replaced while they are read, failed writes, bounded layouts, trimmed headers, word search."""

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from pubmetrics import operators as op, plans
from pubmetrics import sources as src
from pubmetrics.operators.schema import plain_names


def table(spark, n=40):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("a,\n\"b").alias("t"))


@pytest.mark.parametrize("formats", [("csv", "parquet"), ("parquet", "csv"), ("parquet",), ("csv",)])
def test_tables_are_converted_in_place(spark, tmp_path, formats):
    base = f"{tmp_path}/t"
    src.write_records(table(spark), base, formats[-1])
    for fmt in formats:
        path = src.write_records(src.load_records(spark, base), base, fmt, overwrite=True)
        assert path == f"{base}.{fmt}"
        assert set(rows(src.load_records(spark, base))) == set(rows(table(spark)))
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"t.{formats[-1]}"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_failed_write_keeps_the_table(spark, tmp_path, fmt):
    base = f"{tmp_path}/t"
    src.write_records(table(spark), base)
    bad = table(spark).withColumn("t", F.when(F.col("id") == "39", F.raise_error(F.lit("no"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="no"):
        src.write_records(bad, base, fmt, overwrite=True)
    with pytest.raises(Exception, match="no"):
        src.write_csv(bad, f"{tmp_path}/new")
    assert set(rows(src.load_records(spark, base))) == set(rows(table(spark)))
    assert [p.name for p in tmp_path.iterdir()] == ["t.parquet"]


def test_bad_years_share_a_folder(spark, tmp_path):
    years = [2000, 2000, 2001, None, *range(-30, 0), *range(3000, 3030)]
    df = spark.createDataFrame(list(enumerate(years)), "id int, pub_year int")
    path = f"{tmp_path}/s"
    src.write_sliced(df, path)
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("_slice")]) == 3
    for low, high in ((2000, 2001), (-10, 2000), (2001, 3005), (3000, 4000), (5, 1999)):
        wanted = {(i, y) for i, y in enumerate(years) if y is not None and low <= y <= high}
        assert set(rows(src.read_sliced(spark, path, low, high).select("id", "pub_year"))) == wanted
    counted = src.stored_slice_counts(spark, path)
    assert rows(counted) == sorted((y, years.count(y)) for y in set(years) - {None})
    assert "ReadSchema: struct<>" in plan_of(counted)
    with pytest.raises(ValueError, match="taken"):
        src.write_sliced(df.withColumn("_slice", F.lit(1)), path, overwrite=True)


def test_an_empty_store_is_read(spark, tmp_path):
    df = spark.createDataFrame([], "id int, pub_year int")
    src.write_sliced(df, f"{tmp_path}/s")
    got = src.read_sliced(spark, f"{tmp_path}/s", 1990, 2000)
    assert rows(got) == [] and got.columns == ["id", "pub_year"]
    assert rows(src.stored_slice_counts(spark, f"{tmp_path}/s")) == []


def test_ingest_of_padded_and_doubled_headers(spark, tmp_path):
    data = [(1, "a", "x", "2001"), (2, "b", "y", "2002"), (3, "b", "z", "2003")]
    raw = spark.createDataFrame(data, "src_ord int, ` eid ` string, EID string, ` pub_year ` string")
    landed = plans.run_ingest(raw, str(tmp_path), "r", slicing=True, start_year=2001, end_year=2002)
    assert sorted((r.eid, r.EID_2, r.pub_year) for r in landed.collect()) == [("a", "x", "2001"), ("b", "y", "2002")]
    assert plain_names([" Title ", "title", "TITLE", "x"]) == ["Title", "title_2", "TITLE_3", "x"]


def test_full_run_reads_the_export_once(spark, tmp_path):
    """Sixty bad years, a repeated record, an undated one; one job scans the export."""
    years = [2005, 2005, 1500, *range(3000, 3060)]
    data = [(i, f"e{i}", str(y), "10 u, Italy") for i, y in enumerate(years)] + [(98, "e0", "2010", None), (99, "u", None, None)]
    spark.createDataFrame(data, "src_ord int, EID string, Year string, Affiliations string").write.parquet(f"{tmp_path}/raw")
    read = spark.sparkContext.accumulator(0)
    raw = spark.read.parquet(f"{tmp_path}/raw")
    schema = raw.schema

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    out = plans.run_full_analysis(raw.mapInArrow(counted, schema), f"{tmp_path}/runs", "r", 1983, 2025, source="raw")
    assert read.value == len(data)
    assert sorted(r._eid for r in out["dataset_scope"].collect()) == ["e0", "e1"]
    record = spark.read.json(f"{tmp_path}/runs/outputs/methods/full_analysis").first()
    assert (record.rows_input, record.rows_raw, record.rows_deduplicated, record.rows_scoped) == (65, 64, 63, 2)
    assert record.input_path == "raw" and record.output_tables.dataset_scope.endswith("dataset_scope.parquet")
    work = tmp_path / "runs/work/full/r/deduplicated.parquet/_scope=false"
    assert len([p for p in work.iterdir() if p.name.startswith("_slice")]) == 1
    assert rows(out["bubble_regions_over_time"]) == [("2002-2006", "Europe & Central Asia", 2.0)]


def test_clean_record(spark, tmp_path):
    data = [(1, "a", "2001", None), (2, "a", "2002", "N"), (3, None, None, "N")]
    spark.createDataFrame(data, "src_ord int, eid string, pub_year string, author_names string").write.parquet(f"{tmp_path}/raw.parquet")
    plans.run_clean(spark, str(tmp_path), "r", source=f"{tmp_path}/raw")
    record = spark.read.json(plans.RunFiles(str(tmp_path), "r").metrics("clean")).first()
    assert (record.rows_before, record.rows_after, record.duplicates_removed) == (3, 2, 1)
    assert tuple(record.coverage.authors) == (1, 2, 0.5) and record.input_path == f"{tmp_path}/raw"
    assert "no column for journal; its tables are empty" in record.notes
    growth = plans.run_analyze(spark, str(tmp_path), "r")["cagr"].first()
    record = spark.read.json(plans.RunFiles(str(tmp_path), "r").metrics("analyze")).first()
    assert growth.run_id == "r" and growth.timestamp_utc == record.timestamp_utc
    assert (record.period.start_year, record.yoy_pct_units) == (2001, "percent")


TEXTS = ["Unbanked people", "A BANK, indeed", "green\n  bond market", "Green-bonds", "evergreen bond", None, "", "Straße Éa"]


@pytest.mark.parametrize(
    "words,wanted",
    [
        (op.Search.phrase("bank"), {1}),
        (op.Search.phrase("bank*"), {1}),
        (op.Search.phrase("green bond"), {2}),
        (op.Search.phrase("Green Bond*"), {2, 3}),
        (op.Search.any_of("bank", "straße éa"), {1, 7}),
        (op.Search.phrase("green bond*") & ~op.Search.phrase("market"), {3}),
        (~op.Search.any_of("bank", "green", "bond", "people"), {5, 6, 7}),
        (op.Search.phrase("bank", "other") | op.Search.phrase("people", "text"), {0}),
    ],
)
def test_word_search(spark, words, wanted):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "id int, text string, other string")
    got = op.search_records(df, ["text", "other"], words=words)
    assert {r.id for r in got.collect()} == wanted
    assert plan_of(got).count("lower(") == 2


def test_word_search_refuses(spark):
    with pytest.raises(ValueError):
        op.Search.phrase(" -* ")
    with pytest.raises(ValueError):
        op.Search.any_of()
    with pytest.raises(ValueError, match="not searched"):
        op.holds(["a"], op.Search.phrase("x", "b"))
