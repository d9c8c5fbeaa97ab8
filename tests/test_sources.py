import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import plan_of, rows
from pubmetrics import operators as op
from pubmetrics import sources as src
from pubmetrics.sources.ordering import path_order

EXPORT = (
    '﻿Title, Year ,title,Authors,EID\n'
    '"A ""quoted"", title",2001,x,"Li, W.; Xu",e1\n'
    '"line one\nline two",2002,NA,null,e2\n'
    "  padded  ,n.d.,x,,e1\n"
)


@pytest.fixture
def export(tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(EXPORT, encoding="utf-8")
    return str(path)


def test_export_reader(spark, export):
    df = src.read_export(spark, export, ordered=True)
    assert df.columns == ["src_ord", "Title", "Year", "title", "Authors", "EID"]
    records = op.canonicalize(df, op.EXPORT_FIELDS).orderBy("src_ord").collect()
    assert [r.title for r in records] == ['A "quoted", title', "line one\nline two", "  padded  "]
    assert [r.authors for r in records] == ["Li, W.; Xu", None, None]
    assert [r.pub_year for r in records] == ["2001", "2002", "n.d."]


def test_export_null_tokens_can_be_kept(spark, export):
    df = src.read_export(spark, export, null_tokens=())
    assert {r[3] for r in df.collect()} == {"Li, W.; Xu", "null", None}


def test_export_files_of_one_header_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("EID,Title,Year\ne1,T1,2001\n")
    (tmp_path / "b.csv").write_text("eid,title,Year\ne2,T2,2002\n")
    (tmp_path / "c.csv").write_text("Title,EID,Year\nT9,e9,2003\n")
    paths = {f: str(tmp_path / f"{f}.csv") for f in "abc"}
    alike = src.read_export(spark, [paths["a"], paths["b"]], ordered=True)
    assert sorted(r.EID for r in alike.collect()) == ["e1", "e2"]
    for multi_line in (True, False):
        mixed = src.read_export(spark, [paths["a"], paths["c"]], multi_line=multi_line)
        for columns in (["EID", "Title"], ["EID"]):
            with pytest.raises(Exception, match="CSV header does not conform"):
                mixed.select(columns).collect()
    joined = src.union_records(src.read_export(spark, paths[f]) for f in "ac")
    assert {(r.EID, r.Title) for r in joined.collect()} == {("e1", "T1"), ("e9", "T9")}


def test_empty_export_is_an_error(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="header"):
        src.read_export(spark, str(tmp_path / "empty.csv"))


def test_load_by_base_path_prefers_parquet(spark, tmp_path):
    base = str(tmp_path / "table.v1")
    with pytest.raises(FileNotFoundError):
        src.load_records(spark, base)
    src.write_records(spark.createDataFrame([("csv",)], "v string"), base, "csv")
    assert rows(src.load_records(spark, base)) == [("csv",)]
    src.write_records(spark.createDataFrame([("pq",)], "v string"), base, "parquet", overwrite=True)
    # Overwriting takes the other format's table away; one that is written by other means stays.
    spark.createDataFrame([("csv",)], "v string").write.csv(f"{base}.csv", header=True)
    assert rows(src.load_records(spark, base)) == [("pq",)]
    assert rows(src.load_records(spark, f"{base}.csv")) == [("csv",)]
    with pytest.raises(ValueError):
        src.load_records(spark, base, "orc")


@pytest.mark.parametrize("first, second", [("csv", "parquet"), ("parquet", "csv")])
def test_overwrite_guard_checks_both_formats(spark, tmp_path, first, second):
    df = spark.createDataFrame([("x",)], "v string")
    base = str(tmp_path / "out")
    assert src.write_records(df, base, first) == f"{base}.{first}"
    with pytest.raises(FileExistsError):
        src.write_records(df, base, second)
    assert src.write_records(df, f"{base}.{second}", overwrite=True) == f"{base}.{second}"


def test_write_csv_does_not_replace(spark, tmp_path):
    df = spark.createDataFrame([("x",)], "v string")
    src.write_csv(df, str(tmp_path / "t"))
    with pytest.raises(AnalysisException):
        src.write_csv(df, str(tmp_path / "t"))


def test_parquet_order_follows_rows(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(500).repartition(1).sortWithinPartitions(F.desc("id")).write.parquet(path)
    df = src.load_records(spark, path, ordered=True)
    assert [r.id for r in df.orderBy("src_ord").collect()] == list(range(499, -1, -1))
    stored = str(tmp_path / "stored.parquet")
    df.write.parquet(stored)
    assert src.load_records(spark, stored, ordered=True).columns == ["src_ord", "id"]


def test_csv_keeps_record_order_over_many_files(spark, tmp_path):
    df = spark.range(1000).select(
        F.col("id").alias("src_ord"), F.col("id").cast("string").alias("v")
    )
    path = src.write_records(df.repartition(7), str(tmp_path / "t"), "csv")
    back = src.load_records(spark, path, ordered=True)
    assert [r.v for r in back.orderBy("src_ord").collect()] == [str(i) for i in range(1000)]


def test_json_records_take_the_union_of_keys(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"eid": 1, "title": "T"}\n{"eid": "2", "journal": "J"}\n')
    df = src.load_records(spark, str(path), ordered=True).orderBy("src_ord")
    assert [r.asDict() for r in df.select("eid", "title", "journal").collect()] == [
        {"eid": "1", "title": "T", "journal": None},
        {"eid": "2", "title": None, "journal": "J"},
    ]
    typed = src.read_json_records(spark, str(path), "eid string, doi string")
    assert rows(typed) == [("1", None), ("2", None)]


def test_union_records(spark):
    a = spark.createDataFrame([(1, "x")], "eid int, t string")
    b = spark.createDataFrame([("n/a",)], "eid string")
    assert rows(src.union_records([a, b])) == [("1", "x"), ("n/a", None)]
    with pytest.raises(ValueError):
        src.union_records([])


@pytest.mark.parametrize(
    "given, expected",
    [
        ((2000, 2005, None), (2000, 2005)),
        ((2000, 2005, 3), (2000, 2005)),
        ((None, 2005, 3), (2022, 2024)),
        ((2000, None, 10), (2015, 2024)),
    ],
)
def test_slice_bounds(given, expected):
    assert src.slice_bounds(*given, current_year=2024) == expected


def test_slice_bounds_need_something():
    with pytest.raises(ValueError):
        src.slice_bounds(2000, None, None)


def test_sliced_scan_takes_the_earlier_slice(spark):
    df = spark.createDataFrame(
        [(1, "e", 2003), (2, "e", 2001), (3, "e", 1990), (4, "f", 2003), (5, None, 2002), (6, None, 2001)],
        "src_ord long, eid string, pub_year int",
    )
    assert sorted(r.src_ord for r in src.sliced_scan(df, 2000, 2005).collect()) == [2, 4, 6]
    assert src.sliced_scan(df.drop("eid"), 2000, 2005).count() == 5


def test_sliced_store_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "sliced")
    df = spark.range(900).select("id", (F.col("id") % 9 + 2000).cast("int").alias("pub_year"))
    src.write_sliced(df, path)
    got = src.read_sliced(spark, path, 2003, 2004)
    assert got.count() == 200
    files = got.inputFiles()
    scan = plan_of(got.select("id"))
    assert "PartitionFilters: [isnotnull(_slice" in scan and len(files) >= 2
    assert rows(src.covered_years(got)) == [(2003,), (2004,)]
    assert rows(src.slice_counts(got)) == [(2003, 100), (2004, 100)]
    assert rows(src.result_size(got)) == [(200,)]


def test_run_metrics_append(spark, tmp_path):
    path = str(tmp_path / "metrics")
    for run in ("a", "b"):
        src.append_run_metrics(spark.createDataFrame([(run, 1)], "run_id string, n int"), path)
    assert sorted(r.run_id for r in spark.read.json(path).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        src.append_run_metrics(spark.range(1).toDF("n"), path)


def test_shared_folder_follows_the_session(spark):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    one, two = src.shared_folder(spark, "x"), src.shared_folder(spark, "x")
    assert one.startswith(root) and one != two


def test_part_files_order_by_number(spark):
    names = ["/a/part-99999-x-c000.csv", "/a/part-100000-x-c000.csv", "/a/part-00001-x-c000.csv", "/b/part-00000-x-c000.csv"]
    df = spark.createDataFrame([(n,) for n in names], "path string").orderBy(path_order(F.col("path")))
    assert [r.path for r in df.collect()] == [names[2], names[0], names[1], names[3]]
    plain = spark.createDataFrame([("/z/b.csv",), ("/z/aa.csv",)], "path string").orderBy(path_order(F.col("path")))
    assert [r.path for r in plain.collect()] == ["/z/aa.csv", "/z/b.csv"]
