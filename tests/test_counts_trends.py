import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from pubmetrics import operators as op


def annual(spark, pairs, names="pub_year int, count long"):
    return spark.createDataFrame(pairs, names)


def test_value_counts_order_limit_and_blanks(spark):
    df = spark.createDataFrame(
        [(x,) for x in [" b ", "b", "a", "a", "c", "", None, "  "]], "journal string"
    )
    assert rows(op.value_counts(df, "journal")) == [("a", 2), ("b", 2), ("c", 1)]
    assert rows(op.value_counts(df, "journal", "j", limit=2)) == [("a", 2), ("b", 2)]
    assert rows(op.value_counts(df, "journal", keep_blank=True))[:3] == [("", 2), ("a", 2), ("b", 2)]


def test_item_counts_keep_case_and_repeats(spark):
    df = spark.createDataFrame([("Bo; Al; Bo",), ("al;;",), (None,)], "authors string")
    assert rows(op.item_counts(df, "authors")) == [("Bo", 2), ("Al", 1), ("al", 1)]
    assert rows(op.item_counts(df, "authors", "author", limit=1)) == [("Bo", 2)]


def test_counts_combine_before_the_shuffle_and_take_top_k(spark):
    df = spark.createDataFrame([("x",)], "journal string")
    plan = plan_of(op.value_counts(df, "journal", limit=25))
    assert "partial_count" in plan and "TakeOrderedAndProject" in plan


def test_annual_counts_skip_undated(spark):
    df = spark.createDataFrame([(2001,), (None,), (2000,), (2001,)], "pub_year int")
    assert rows(op.annual_counts(df)) == [(2000, 1), (2001, 2)]
    assert op.annual_counts(df, out_year="year", out_count="n_pubs").columns == ["year", "n_pubs"]


def test_filter_years(spark):
    df = spark.createDataFrame([(y,) for y in [1999, 2000, 2005, None]], "pub_year int")
    assert op.filter_years(df).count() == 3
    assert rows(op.filter_years(df, 2000)) == [(2000,), (2005,)]
    assert rows(op.filter_years(df, 2000, 2000)) == [(2000,)]
    assert rows(op.filter_years(df, max_year=1999)) == [(1999,)]


def test_yoy_is_by_row_not_by_calendar_year(spark):
    series = annual(spark, [(2002, 6), (2000, 4), (2005, 0), (2006, 3)])
    assert rows(op.yoy_growth(series)) == [
        (2000, 4, None, None),
        (2002, 6, 2.0, 50.0),
        (2005, 0, -6.0, -100.0),
        (2006, 3, 3.0, None),
    ]


def test_trend(spark):
    series = annual(spark, [(2000, 2), (2001, 4), (2003, 3)], "year int, n_pubs long")
    assert rows(op.trend(series)) == [
        (2000, 2, None, None), (2001, 4, 100.0, None), (2003, 3, -25.0, 3.0)
    ]


def test_cagr(spark):
    got = op.cagr(annual(spark, [(1999, 0), (2000, 4), (2001, 7), (2002, 9)])).first()
    assert tuple(got)[:4] == (2000, 2002, 4.0, 9.0)
    assert got.cagr == pytest.approx(0.5)


@pytest.mark.parametrize("pairs, start", [([], None), ([(2000, 5)], 2000), ([(2000, 0)], None)])
def test_cagr_is_zero_when_undefined(spark, pairs, start):
    got = op.cagr(annual(spark, pairs)).first()
    assert (got.cagr, got.start_year) == (0.0, start)


def test_recent_growth_needs_ten_rows(spark):
    nine = [(2000 + i, i + 1) for i in range(9)]
    assert rows(op.recent_growth(annual(spark, nine))) == [(None, None, None)]
    ten = nine + [(2020, 10)]
    assert rows(op.recent_growth(annual(spark, ten))) == [(8.0, 3.0, 8.0 / 3.0)]
    flat = [(2000 + i, 0 if i < 5 else 1) for i in range(10)]
    assert rows(op.recent_growth(annual(spark, flat))) == [(1.0, 0.0, None)]


def test_growth_summary_joins_both_in_one_row(spark):
    series = annual(spark, [(2000 + i, i + 1) for i in range(12)])
    got = op.growth_summary(series)
    assert rows(got) == [tuple(op.cagr(series).first()) + tuple(op.recent_growth(series).first())]
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_kpi_interest(spark):
    names = "year int, n_pubs long"
    got = op.kpi_interest(annual(spark, [(2000, 2), (2002, 8)], names), 1983, 2025).first()
    assert tuple(got)[:3] == (10, 1983, 2025) and got.cagr == pytest.approx(1.0)
    # One year: the span is floored at one. No year: null, not zero.
    assert op.kpi_interest(annual(spark, [(2000, 2)], names), 1, 2).first().cagr == 0.0
    assert rows(op.kpi_interest(annual(spark, [], names), 1, 2)) == [(0, 1, 2, None)]


def test_record_counts_are_complete(spark):
    df = spark.range(1000).select((F.col("id") % 7 + 2000).cast("int").alias("pub_year"))
    assert op.annual_counts(df).agg(F.sum("count")).first()[0] == 1000
