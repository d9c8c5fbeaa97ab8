"""CSV files with quoted newlines in many tasks, and files of differing headers."""

import csv
import random
from contextlib import contextmanager

import pytest
from pyspark.errors import PySparkException

from conftest import plan_of, rows
from pubmetrics import sources as src
from pubmetrics.sources import exports
from pubmetrics.sources.exports import header_names, text_lines


@contextmanager
def small_splits(spark, size):
    conf = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in conf:
            spark.conf.unset(k)


def write(path, header, data, **options):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, **options)
        out.writerow(header)
        out.writerows(data)


def cell(rng):
    parts = ["a", "é", ",", '"', "\n", "\r\n", '""', " ", "x" * 30, "\n\n", ";"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(0, 7)))


def whole(spark, path):
    df = src.read_export(spark, path, ordered=True, null_tokens=())
    return rows(df.orderBy("src_ord").drop("src_ord"))


@pytest.mark.parametrize("size", [150, 5000])
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_split_reading_equals_whole_files(spark, tmp_path, size, ends):
    rng = random.Random(size)
    for i in range(3):
        data = [[f"{i}-{j}", cell(rng), cell(rng)] for j in range(25)]
        if i == 1:
            data[9][1] = "line\n" * 150  # over many splits
        write(f"{tmp_path}/{i}.csv", ["id", "b", "c"], data, lineterminator=ends)
    wanted = whole(spark, str(tmp_path))
    assert len(wanted) == 75
    with small_splits(spark, size):
        lines = text_lines(spark, str(tmp_path))
        assert size > 150 or lines.select("file", "block").distinct().count() > 9
        got = src.read_export(spark, str(tmp_path), ordered=True, multi_line="split", null_tokens=())
        assert rows(got.orderBy("src_ord").drop("src_ord")) == wanted


@pytest.mark.parametrize("bits", [0, 1, 4])
def test_records_over_chunks(spark, tmp_path, monkeypatch, bits):
    rng = random.Random(bits)
    monkeypatch.setattr(exports, "CHUNK_BITS", bits)
    for i in range(2):
        data = [[f"{i}-{j}", cell(rng), cell(rng)] for j in range(25)]
        data[3][1] = "\n" * 40 + '"'
        write(f"{tmp_path}/{i}.csv", ["id", "b", "c"], data, lineterminator="\r\n" if i else "\n")
    wanted = whole(spark, str(tmp_path))
    with small_splits(spark, 150):
        got = src.read_export(spark, str(tmp_path), ordered=True, multi_line="split", null_tokens=())
        assert rows(got.orderBy("src_ord").drop("src_ord")) == wanted


def test_lines_are_neither_sorted_nor_shuffled_one_by_one(spark, tmp_path):
    write(f"{tmp_path}/x.csv", ["a", "b"], [["1\n2", "x"], ["3", "y"]])
    lines = text_lines(spark, str(tmp_path))
    states = exports.split_states(lines)
    assert "SortAggregate" not in plan_of(states)
    records = plan_of(exports.whole_records(lines, states))
    # A chunk is one row before it is shuffled, and no window runs over lines.
    assert "partial_collect_list" in records and "SortAggregate" not in records
    assert not [line for line in records.splitlines() if "Window " in line and "line#" in line]


def test_files_of_differing_headers(spark, tmp_path):
    write(f"{tmp_path}/a.csv", ["a", "", "b"], [["1", "2", "3"], ["x\ny", "NA", ""]])
    write(f"{tmp_path}/b.csv", ["b", "", "a", "new"], [["4", "5", "6", "7"]])
    write(f"{tmp_path}/c.csv", ["﻿ a ", "a", "A"], [["8", "9", "10"]], quoting=csv.QUOTE_ALL)
    for how in (True, "split"):
        got = src.read_export(spark, str(tmp_path), multi_line=how)
        assert got.columns == ["a", "_c1", "b", "new", "a.1", "A"]
        assert set(rows(got)) == {
            ("1", "2", "3", None, None, None),
            ("x\ny", None, None, None, None, None),
            ("6", "5", "4", "7", None, None),
            ("8", None, None, None, "9", "10"),
        }


def test_short_and_empty_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text('\n\r\na,b\n1\n\n\r\n2,3,4\n"",5\n', newline="")
    got = src.read_split_export(spark, f"{tmp_path}/x.csv")
    assert sorted(rows(got), key=repr) == [("1", None), ("2", "3"), (None, "5")]
    (tmp_path / "y.csv").write_text("a,b\n")
    assert src.read_split_export(spark, f"{tmp_path}/y.csv").count() == 0
    (tmp_path / "z.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        src.read_split_export(spark, f"{tmp_path}/z.csv")


@pytest.mark.parametrize("bad", ['5" pipe,x', 'a,b"c"', '"a"b,c', '"open,x'])
def test_stray_quotes_are_refused(spark, tmp_path, bad):
    (tmp_path / "x.csv").write_text(f"a,b\n1,2\n{bad}\n3,4\n")
    with pytest.raises(PySparkException, match="multi_line=True"):
        src.read_split_export(spark, str(tmp_path)).collect()


def test_header_over_lines_is_refused(spark, tmp_path):
    write(f"{tmp_path}/x.csv", ["a\nb", "c"], [["1", "2"]])
    with pytest.raises(ValueError, match="does not end in its line"):
        src.read_split_export(spark, str(tmp_path))


def test_header_names():
    assert header_names(["﻿ x ", None, " ", "x", "x", "X"]) == ["x", "_c1", "_c2", "x.1", "x.2", "X"]
