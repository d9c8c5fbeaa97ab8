import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from pubmetrics import operators as op
from pubmetrics.operators import keywords


def brute_edges(sets, min_docs):
    freq = Counter(k for s in sets for k in set(s))
    edges = Counter()
    for s in sets:
        edges.update(combinations(sorted(k for k in set(s) if freq[k] >= min_docs), 2))
    return {(a, b, n) for (a, b), n in edges.items()}


def keyword_frame(spark, sets):
    data = [(i, sorted(set(s))) for i, s in enumerate(sets)]
    return spark.createDataFrame(data, "src_ord long, keywords array<string>").repartition(4)


@pytest.fixture(scope="module")
def sets():
    """One keyword in every record, a third of all occurrences in one long record."""
    rng = random.Random(3)
    out = [["common", *(f"k{rng.randrange(60)}" for _ in range(rng.randrange(0, 9)))] for _ in range(120)]
    out.append(["common", *(f"k{i}" for i in range(60)), *(f"only{i}" for i in range(200))])
    out.append([])
    return out


@pytest.mark.parametrize("block", [1, 7, 32, 1000])
def test_cooccurrence_matches_brute_force(spark, sets, block):
    df = keyword_frame(spark, sets)
    got = op.keyword_cooccurrence(df, min_docs=5, block=block)
    assert got.columns == ["from", "to", "value"]
    found = rows(got)
    assert len(found) == len(set(found)) and set(found) == brute_edges(sets, 5)


def test_cooccurrence_keeps_every_pair_of_a_long_record(spark):
    sets = [[f"w{i:04d}" for i in range(700)]]
    got = op.keyword_cooccurrence(keyword_frame(spark, sets), min_docs=1, block=64)
    assert got.count() == 700 * 699 // 2
    assert got.agg(F.max("value")).first()[0] == 1
    assert got.filter(F.col("from") >= F.col("to")).count() == 0


def test_cooccurrence_threshold(spark):
    four, five = [["a", "b"]] * 4, [["a", "b"]] * 5
    assert op.keyword_cooccurrence(keyword_frame(spark, four)).count() == 0
    assert rows(op.keyword_cooccurrence(keyword_frame(spark, five))) == [("a", "b", 5)]


def test_cooccurrence_record_can_be_a_struct(spark, sets):
    df = keyword_frame(spark, sets).withColumn("src_ord", F.struct(F.lit("f"), "src_ord"))
    assert set(rows(op.keyword_cooccurrence(df))) == brute_edges(sets, 5)


def test_cooccurrence_same_without_broadcast(spark, sets):
    """Beyond the broadcast threshold the shuffle join gives the same edges."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        got = op.keyword_cooccurrence(keyword_frame(spark, sets))
        assert plan_of(got).count("SortMergeJoin [") == 2  # the names of both ends
        assert set(rows(got)) == brute_edges(sets, 5)
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_codes_follow_frequency(spark):
    rng = random.Random(6)
    data = [(f"k{i}", rng.randrange(1, 40)) for i in range(500)]
    frequency = spark.createDataFrame(data, "keyword string, count long").repartition(7)
    wanted = sorted(((-n, k) for k, n in data if n >= 5))
    got = op.keyword_codes(frequency).select("code", "count", "keyword").orderBy("code")
    assert rows(got) == [(i, -n, k) for i, (n, k) in enumerate(wanted)]
    assert op.keyword_codes(frequency, 99).count() == 0
    # A plain scan, whose size says which side of a join with the records is small.
    assert "Join" not in plan_of(op.keyword_codes(frequency))


@pytest.mark.parametrize("n", [1, 10, 60, 5000])
def test_heaviest_edges_are_those_of_all(spark, sets, n):
    df = keyword_frame(spark, sets)
    codes = op.keyword_codes(op.keyword_frequency(df))
    wanted = sorted(brute_edges(sets, 5), key=lambda e: (-e[2], e[0], e[1]))[:n]
    assert rows(op.heaviest_edges(op.coded_sets(df, codes), codes, n, block=7)) == wanted


def test_heaviest_edges_pair_few_keywords(spark, monkeypatch):
    """With many rare keywords only a small part of all pairs is made."""
    rng = random.Random(8)
    sets = [{f"k{int(rng.paretovariate(0.6)):05d}" for _ in range(14)} for _ in range(500)]
    df = keyword_frame(spark, sets)
    made = []
    plain = keywords._pairs

    def seen(*args):
        made.append(plain(*args).count())
        return plain(*args)

    monkeypatch.setattr(keywords, "_pairs", seen)
    codes = op.keyword_codes(op.keyword_frequency(df), 1)
    stored = op.coded_sets(df, codes)
    top = rows(op.heaviest_edges(stored, codes, 10))
    few = sum(made)
    assert top == sorted(brute_edges(sets, 1), key=lambda e: (-e[2], e[0], e[1]))[:10]
    made.clear()
    assert op.keyword_cooccurrence(df, min_docs=1).count() == len(brute_edges(sets, 1))
    assert 0 < few < sum(made) / 3


def test_edge_weight_is_bounded_by_both_frequencies(spark, sets):
    df = keyword_frame(spark, sets)
    freq = dict(rows(op.keyword_frequency(df)))
    assert all(n <= min(freq[a], freq[b]) for a, b, n in rows(op.keyword_cooccurrence(df)))


def test_keyword_frequency_counts_documents(spark):
    df = spark.createDataFrame(
        [("A; a", "B"), ("a", None), (None, None)], "author_keywords string, index_keywords string"
    )
    assert rows(op.keyword_frequency(op.with_keyword_set(df))) == [("a", 2), ("b", 1)]


def test_top_keywords_and_edges(spark):
    freq = spark.createDataFrame([("a", 3), ("b", 3), ("c", 9), ("d", 1)], "keyword string, count long")
    assert rows(op.top_keywords(freq, 3)) == [("b", 3), ("a", 3), ("c", 9)]
    edges = spark.createDataFrame(
        [("a", "c", 2), ("a", "b", 2), ("b", "c", 5)], "from string, to string, value long"
    )
    assert rows(op.top_edges(edges, 2)) == [("b", "c", 5), ("a", "b", 2)]


def test_keyword_array_is_derived_once(spark):
    df = spark.createDataFrame([("a", "b")], "author_keywords string, index_keywords string")
    plan = plan_of(op.keyword_frequency(op.with_keyword_set(df)))
    assert plan.count("array_distinct") == 1


def geo_frame(spark):
    return spark.createDataFrame(
        [
            (2003, "A, Italy; B, USA; C, US"),
            (2003, "A, France"),
            (2003, "X, Atlantis"),
            (2010, "X, Iran, Islamic Republic of"),
            (2001, "A, Italy"),
            (2026, "A, Italy"),
            (2023, None),
            (None, "A, Italy"),
        ],
        "year int, affiliations string",
    )


def test_regions_over_time(spark):
    got = rows(op.regions_over_time(geo_frame(spark)))
    assert got == [
        ("2002-2006", "Europe & Central Asia", 1.5),
        ("2002-2006", "North America", 0.5),
        ("2002-2006", "Unknown", 1.0),
        ("2007-2011", "Unknown", 1.0),
    ]
    # Each dated in-window record with a country weighs one.
    assert sum(r[2] for r in got) == pytest.approx(4.0)


def test_regions_from_a_callers_table(spark):
    table = spark.createDataFrame([("italy", "South"), ("france", "North")], "country string, region string")
    got = rows(op.regions_over_time(geo_frame(spark), regions=table, bins=[(2000, 2009)]))
    assert ("2000-2009", "South", 1.5) in got and ("2000-2009", "North", 1.0) in got


def test_years_between_periods_are_left_out(spark):
    got = rows(op.regions_over_time(geo_frame(spark), bins=[(2001, 2001), (2010, 2026)]))
    assert got == [
        ("2001-2001", "Europe & Central Asia", 1.0),
        ("2010-2026", "Europe & Central Asia", 1.0),
        ("2010-2026", "Unknown", 1.0),
    ]


def test_a_large_region_lookup_is_a_table(spark):
    lookup = op.region_table(spark, {f"c{i}": f"r{i % 7}" for i in range(20_000)})
    df = spark.createDataFrame([("C19999",), ("Nowhere",)], "country string")
    assert [r.region for r in op.with_region(df, regions=lookup).orderBy("country").collect()] == ["r0", "Unknown"]


def test_bubble_sizes(spark):
    df = spark.createDataFrame([("b", "r", 4.0), ("b", "s", 1.0)], "bin string, region string, N_pub double")
    assert [r.marker_size for r in op.bubble_sizes(df).collect()] == [60.0, 30.0]
    small = df.withColumn("N_pub", F.col("N_pub") / 16)
    assert [r.marker_size for r in op.bubble_sizes(small).collect()] == [30.0, 15.0]


def test_coverage(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (None, None)], "pub_year int, journal string")
    got = {r.field: (r.n_nonnull, r.n_total, r.pct_nonnull) for r in op.coverage(df).collect()}
    assert got["pub_year"] == (1, 3, pytest.approx(1 / 3))
    assert got["journal"] == (2, 3, pytest.approx(2 / 3))
    assert got["keywords"] == (0, 3, 0.0)
    assert {r.pct_nonnull for r in op.coverage(df.limit(0)).collect()} == {0.0}


def test_run_counts(spark):
    df = spark.createDataFrame(
        [(1, "e", 1990), (2, "e", 2010), (3, "f", 2010), (4, None, 2011), (5, "g", None)],
        "src_ord long, eid string, year int",
    ).withColumns({c: F.lit(None).cast("string") for c in ("doi", "title", "authors")})
    assert rows(op.run_counts(df, 2000, 2020)) == [(5, 4, 3, 2)]
    assert rows(op.run_counts(df.limit(0), 2000, 2020)) == [(0, 0, 0, 0)]


def test_report_kpis(spark):
    df = spark.createDataFrame(
        [(2000, "A; B; A", " J "), (2000, "B", "J"), (None, None, None), (2001, "", "K")],
        "pub_year int, authors string, journal string",
    )
    assert rows(op.report_kpis(df)) == [(2, 2, 2, 3)]


def test_search_records(spark):
    df = spark.createDataFrame(
        [
            (1, "Green Bonds in Asia", None, "English", 2001),
            (2, "Water", "green bonds; asia", "English", 2005),
            (3, "Green bonds", "asia", "French", 2005),
            (4, None, None, "English", 2005),
            (5, "green  bonds asia", None, "English", 1990),
        ],
        "id int, title string, keywords string, lang string, pub_year int",
    )
    found = op.search_records(
        df,
        ["title", "keywords"],
        any_of=["GREEN bonds", "sukuk"],
        all_of=["asia"],
        limit_to={"lang": ["English"]},
        min_year=2000,
        max_year=2025,
    )
    assert sorted(r.id for r in found.collect()) == [1, 2]
    assert op.search_records(df, ["title"]).count() == 5
