import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from pubmetrics import operators as op


def test_first_candidate_wins_and_matching_is_exact(spark):
    df = spark.createDataFrame([("a", "b", "c")], "keywords string, authkeywords string, EID string")
    got = op.canonicalize(df).first()
    assert got.author_keywords == "b"
    assert got.eid is None
    assert op.canonicalize(df, op.EXPORT_FIELDS).first().eid == "c"


def test_headers_differing_in_case_do_not_clash(spark):
    df = spark.createDataFrame([("right", "wrong", 1)], ["Title", "title", "Year"])
    out = op.canonicalize(df, op.EXPORT_FIELDS, keep_other=True)
    got = out.first().asDict()
    assert (got["title"], got["src_title"], got["pub_year"]) == ("right", "wrong", "1")
    assert "doi" in out.columns and got["doi"] is None


def test_headers_are_trimmed(spark):
    df = spark.createDataFrame([("t",)], [" Title "])
    assert op.canonicalize(df, op.EXPORT_FIELDS).first().title == "t"


def test_year_column_is_required(spark):
    df = spark.createDataFrame([("t",)], ["Title"])
    with pytest.raises(ValueError, match="year"):
        op.canonicalize(df, op.EXPORT_FIELDS, require_year=True)


def test_missing_column_gives_an_empty_table(spark):
    df = op.canonicalize(spark.createDataFrame([("t",)], ["Title"]), op.EXPORT_FIELDS)
    out = op.value_counts(df, "journal")
    assert out.columns == ["journal", "count"] and out.count() == 0


def skewed(n=3000, seed=1):
    """A third of the rows without an id, another third under one id."""
    rng = random.Random(seed)
    keys = [None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{rng.randrange(300)}" for i in range(n)]
    order = list(range(n))
    rng.shuffle(order)
    return [(o, k, f"row{o}") for o, k in zip(order, keys)]


def first_rows(data, keep_nulls):
    best = {}
    for ord_, key, val in sorted(data):
        group = (key, ord_) if key is None and keep_nulls else (key, None)
        best.setdefault(group, (ord_, key, val))
    return sorted(best.values(), key=repr)


@pytest.mark.parametrize("nulls", ["collapse", "keep"])
def test_keep_first_under_skew(spark, nulls):
    data = skewed()
    df = spark.createDataFrame(data, "src_ord long, eid string, v string").repartition(8)
    out = op.keep_first(df, "eid", nulls=nulls)
    assert sorted(rows(out), key=repr) == first_rows(data, nulls == "keep")
    # Idempotent.
    assert sorted(rows(op.keep_first(out, "eid", nulls=nulls)), key=repr) == sorted(
        rows(out), key=repr
    )


def test_keep_first_limits_groups_before_the_shuffle(spark):
    df = spark.createDataFrame(skewed(30), "src_ord long, eid string, v string")
    plan = plan_of(op.keep_first(df, "eid"))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_keep_first_accepts_a_struct_order(spark):
    df = spark.createDataFrame(
        [("b", 1, "x"), ("a", 9, "y"), ("a", 2, "z")], "f string, p int, v string"
    ).withColumn("src_ord", F.struct("f", "p")).withColumn("eid", F.lit("1"))
    assert [r.v for r in op.keep_first(df, "eid").collect()] == ["z"]


def test_keep_first_rejects_unknown_null_rule(spark):
    with pytest.raises(ValueError):
        op.keep_first(spark.createDataFrame([(1, "a")], "src_ord int, eid string"), "eid", nulls="x")


def test_scope_after_dedup_hides_a_later_copy(spark):
    df = spark.createDataFrame(
        [(1, "e", 1990), (2, "e", 2010)], "src_ord int, eid string, year int"
    ).withColumns({c: F.lit(None).cast("string") for c in ("doi", "title", "authors")})
    assert op.keep_first_record(df).filter("year between 2000 and 2020").count() == 0


def test_duplicate_stats(spark):
    data = skewed()
    df = spark.createDataFrame(data, "src_ord long, eid string, v string")
    kept = len(first_rows(data, False))
    assert rows(op.duplicate_stats(df, "eid")) == [(len(data), kept, len(data) - kept)]
    assert rows(op.duplicate_stats(df.limit(0), "eid")) == [(0, 0, 0)]
