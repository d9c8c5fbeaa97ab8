"""Column functions on literal values, against plain Python rules."""

import random
import re

import pytest

from pubmetrics import functions as fn
from pyspark.sql import functions as F


def test_coerce_year(col):
    values = ["2020-01-01", " 2021", "20", "", None, "n/a", "20201", "2020", "x2020", "202a"]
    assert col(fn.coerce_year, values) == [
        2020, 2021, None, None, None, None, 2020, 2020, None, None
    ]


def test_numeric_year(col):
    values = ["NaN", "2020d", "2020.7", " 2020 ", "abc", "-5", "2.02e3", "Infinity", "", None, "9e99"]
    assert col(fn.numeric_year, values) == [
        None, None, 2020, 2020, None, -5, 2020, None, None, None, None
    ]
    assert col(fn.numeric_year, [2020.0, None], "double") == [2020, None]


def test_lenient_int(col):
    assert col(fn.lenient_int, ["7", "7.9", "N/A", None, " 12 "]) == [7, 7, 0, 0, 12]


def test_publication_year_fills_row_by_row(spark):
    df = spark.createDataFrame(
        [(None, "2019-05-01"), ("n.d.", "2018"), ("2017", "2001-01-01"), (None, None)],
        "y string, d string",
    )
    got = df.select(fn.publication_year(F.col("y"), F.col("d"))).collect()
    assert [r[0] for r in got] == [2019, 2018, 2017, None]


def test_trim_and_norm_text(col):
    values = ["　 A  b\t\n C\x1c", None, "  ", "x", "a  b", "\x85q"]
    assert col(fn.trim_text, values) == ["A  b\t\n C", None, "", "x", "a  b", "q"]
    assert col(fn.norm_text, values) == ["a b c", "", "", "x", "a b", "q"]


ALPHABET = "aZ\u00e9;, \t\n\x0b\x1c\x1f\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b"


def py_norm(text):
    return re.sub(r"\s+", " ", text.strip().lower())


def test_text_functions_match_python_rules(col):
    rng = random.Random(11)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(16))) for _ in range(3000)]
    expected = {
        fn.norm_text: py_norm,
        fn.trim_text: str.strip,
        fn.split_keywords: lambda t: [py_norm(p) for p in t.split(";") if py_norm(p)],
        fn.split_items: lambda t: [p.strip() for p in t.split(";") if p.strip()],
        fn.first_author: lambda t: py_norm(t.strip().split(";")[0]),
    }
    for function, rule in expected.items():
        wrong = [
            (t, got, rule(t)) for t, got in zip(texts, col(function, texts)) if got != rule(t)
        ]
        assert not wrong[:3], function.__name__


def test_lists(col):
    values = ["Bob; Ann ;;  ;Bob", None, "", "one"]
    assert col(fn.split_items, values) == [["Bob", "Ann", "Bob"], [], [], ["one"]]
    assert col(fn.split_keywords, ["Big  Data; AI ;;big data", None]) == [
        ["big data", "ai", "big data"], []
    ]
    assert col(fn.first_author, ["  Li, W. ; Xu", None, " ; B", ""]) == ["li, w.", "", "", ""]


def test_keyword_set_keeps_one_side_when_the_other_is_null(spark):
    df = spark.createDataFrame([("b; A", None), (None, "c;a;C"), (None, None)], "x string, y string")
    got = [r[0] for r in df.select(fn.keyword_set(F.col("x"), F.col("y"))).collect()]
    assert got == [["a", "b"], ["a", "c"], []]


@pytest.mark.parametrize(
    "eid, doi, title, year, authors, key",
    [
        (" E1 ", "D", "t", 2000, "a", "EID:E1"),
        ("  ", " 10.1/AbC ", "t", 2000, "a", "DOI:10.1/abc"),
        (None, None, " The  Title ", 2000, "Li; Xu", "FALL:the title|2000|li"),
        (None, "", None, 1999, None, "FALL:|1999|"),
    ],
)
def test_record_key(spark, eid, doi, title, year, authors, key):
    df = spark.createDataFrame(
        [(eid, doi, title, year, authors)], "e string, d string, t string, y int, a string"
    )
    got = df.select(fn.record_key(*(F.col(c) for c in "edtya"))).first()[0]
    assert got == key


def test_year_bin(col):
    assert col(fn.year_bin, [2001, 2002, 2006, 2007, 2021, 2022, 2025, 2026, None], "int") == [
        None, "2002-2006", "2002-2006", "2007-2011", "2017-2021", "2022-2025", "2022-2025",
        None, None,
    ]
    own = ((1900, 1999), (2000, 2099))
    assert col(lambda c: fn.year_bin(c, own), [1950, 2050], "int") == ["1900-1999", "2000-2099"]


def test_extract_countries(col):
    values = [
        "Univ A, Rome, Italy; Univ B, USA; Univ C, US",
        "X, Iran, Islamic Republic of",
        "; ;",
        None,
        "Viet Nam",
        "Lab, ; Lab, UK",
    ]
    assert [sorted(v) for v in col(fn.extract_countries, values)] == [
        ["italy", "united states"],
        ["islamic republic of"],
        [],
        [],
        ["vietnam"],
        ["united kingdom"],
    ]
    assert col(lambda c: fn.extract_countries(c, {}), ["A, UK"]) == [["uk"]]


def test_fixed_values_of_the_checks():
    """What the SQL of the checks takes from the package, pinned."""
    from collections import Counter

    from pubmetrics.functions import COUNTRY_ALIASES, COUNTRY_REGIONS, YEAR_BINS

    assert COUNTRY_ALIASES == {
        "usa": "united states",
        "us": "united states",
        "uk": "united kingdom",
        "uae": "united arab emirates",
        "viet nam": "vietnam",
    }
    assert YEAR_BINS == ((2002, 2006), (2007, 2011), (2012, 2016), (2017, 2021), (2022, 2025))
    assert len(COUNTRY_REGIONS) == 27 and len(set(COUNTRY_REGIONS.values())) == 7
    some = {"canada": "North America", "turkey": "Europe & Central Asia", "egypt": "Middle East & North Africa"}
    assert some.items() <= COUNTRY_REGIONS.items() and "vietnam" not in COUNTRY_REGIONS
    assert max(Counter(COUNTRY_REGIONS.values()).values()) <= 10
