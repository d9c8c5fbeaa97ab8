"""Keyword sets, document frequency and co-occurrence (PRJ13, AGG6, FLT6, AGG8, LIM2, LIM3)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pubmetrics.functions import keyword_set
from pubmetrics.operators.counts import explode_items, explode_nonempty, ranked, tally
from pubmetrics.operators.schema import ORDER_COLUMN
from pubmetrics.sources.shared import stored

MIN_DOCS = 5
TOP_KEYWORDS = 20
TOP_EDGES = 400
# Codes of one record that are paired in one piece.
BLOCK = 256


def with_keyword_set(
    df: DataFrame,
    *columns: str,
    out: str = "keywords",
) -> DataFrame:
    """PRJ13: sorted distinct normalised keywords of a record."""
    columns = columns or ("author_keywords", "index_keywords")
    return df.withColumn(out, keyword_set(*(F.col(c) for c in columns)))


def keyword_frequency(df: DataFrame, keywords: str = "keywords") -> DataFrame:
    """AGG6: number of records holding each keyword, most frequent first."""
    return ranked(_frequency(df, keywords), "keyword")


def _frequency(df: DataFrame, keywords: str) -> DataFrame:
    return tally(explode_items(df, F.col(keywords), "keyword"), "keyword")


def top_keywords(frequency: DataFrame, n: int = TOP_KEYWORDS) -> DataFrame:
    """LIM2: the n most frequent keywords, least frequent of them first."""
    return ranked(frequency, "keyword", limit=n).orderBy("count", F.col("keyword").desc())


def keyword_vocabulary(frequency: DataFrame, min_docs: int | Column = MIN_DOCS) -> DataFrame:
    """FLT6: keywords held by at least `min_docs` records, a number or a scalar column."""
    return frequency.filter(F.col("count") >= min_docs).select("keyword")


def keyword_codes(frequency: DataFrame, min_docs: int | Column = MIN_DOCS) -> DataFrame:
    """FLT6 as a dictionary: keyword, count and `code`, 0 for the most frequent, ties by keyword.

    The sorted vocabulary is stored once with its place in its partition; a code is that place
    after the sizes of the partitions before it. Only those sizes, one row per partition, meet in
    one task and are broadcast. Codes are 32-bit numbers.
    """
    vocabulary = frequency.filter(F.col("count") >= min_docs).select("keyword", "count")
    placed = vocabulary.orderBy(F.col("count").desc(), "keyword").select(
        "keyword",
        "count",
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
    )
    placed = stored(placed, "keyword-codes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    code = (F.col("start") + F.col("place")).cast("int").alias("code")
    # Stored, as the size of a join is no measure of a dictionary: joins would broadcast the records instead.
    return stored(placed.join(F.broadcast(starts), "part").select("keyword", "count", code), "keyword-codes")


def coded_sets(
    df: DataFrame, codes: DataFrame, *, keywords: str = "keywords", record: str = ORDER_COLUMN
) -> DataFrame:
    """The frequent keywords of each record that has two or more, as its ascending `codes`, stored.

    The only join of records with the vocabulary: whatever counts pairs reads integers from here.
    The dictionary carries no hint: it is broadcast if its measured size allows, else a hot
    keyword's rows are split by adaptive skew handling.
    """
    held = df.select(
        F.col(record).alias("record"), explode_nonempty(F.col(keywords)).alias("keyword")
    )
    held = held.join(codes.select("keyword", "code"), "keyword")
    # One group is one record's own keywords: a part of a single input row.
    sets = held.groupBy("record").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    return stored(sets.filter(F.size("codes") > 1), "keyword-sets")


def keyword_cooccurrence(
    df: DataFrame,
    *,
    keywords: str = "keywords",
    record: str = ORDER_COLUMN,
    min_docs: int | Column = MIN_DOCS,
    frequency: DataFrame | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """AGG8: records in which two frequent keywords occur together, as `from < to, value`.

    `keywords` is sorted and free of repeats, as `with_keyword_set` leaves it, and `record`
    identifies a row. Rare keywords leave a record before it is paired, and pairs are counted
    as 8-byte numbers. Pass a stored `frequency` table (keyword, count) to spare a second pass
    over the records.
    """
    codes = keyword_codes(_frequency(df, keywords) if frequency is None else frequency, min_docs)
    sets = coded_sets(df, codes, keywords=keywords, record=record)
    return named_edges(count_pairs(sets, block=block), codes)


def heaviest_edges(
    sets: DataFrame, codes: DataFrame, n: int = TOP_EDGES, *, block: int = BLOCK
) -> DataFrame:
    """LIM3: the n heaviest edges of `coded_sets`, the same as `top_edges` of all edges.

    An edge weighs no more than the rarer of its keywords occurs. So the most frequent keywords
    are paired first; the n-th weight found is a bound, and no keyword below it is paired
    at all. Each further round adds up to three times as many keywords, with a better bound.
    """
    head = math.ceil(math.sqrt(8 * n)) + 1
    # A round leaves n edges; the rounds are as many as the vocabulary has powers of four.
    low, high, bound, rounds = 0, head, 0, []
    while True:
        counted = count_pairs(sets, low, high, block).filter(F.col("value") >= bound)
        rounds.append(stored(top_edges(named_edges(counted, codes), n), "keyword-edges"))
        best = top_edges(reduce(DataFrame.unionByName, rounds), n)
        found = best.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least")).first()
        bound = found["least"] if found["n"] == n else 0
        reach = codes.filter(F.col("count") >= bound).count()
        if reach <= high:
            return best
        low, high = high, min(reach, 4 * high)


def count_pairs(
    sets: DataFrame, low: int = 0, high: int | None = None, block: int = BLOCK
) -> DataFrame:
    """Records per `pair` of codes below `high`, the larger one at least `low`.

    The smaller code stands in the upper half of the number, the larger one in the lower half.
    """
    codes = F.col("codes")
    if high is not None:
        codes = F.filter(codes, lambda c: c < high)
    pairs = _pairs(sets.select("record", codes.alias("codes")), low, block)
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("value"))


def _pairs(sets: DataFrame, low: int, block: int) -> DataFrame:
    """Every pair of each ascending set whose larger code is at least `low`.

    A set over `block` codes is cut into blocks, and every pair of its blocks goes to a
    task of its own, so no task pairs a very long set alone and no pair is left out.
    """
    size = F.size("codes")
    short = sets.filter(size <= block).select(
        F.col("codes").alias("ours"), F.lit(None).cast("array<int>").alias("theirs")
    )
    i, j = F.col("i"), F.col("j")
    last = F.ceil(size / block).cast("int") - 1
    long = (
        sets.filter(size > block)
        .select("*", F.explode(F.sequence(F.lit(0), last)).alias("j"))
        .select("*", F.slice("codes", j * block + 1, F.lit(block)).alias("theirs"))
        .filter(F.array_max("theirs") >= low)
        .select("*", F.explode(F.sequence(F.lit(0), j)).alias("i"))
        .select(
            "record",
            "i",
            "j",
            F.slice("codes", i * block + 1, F.lit(block)).alias("ours"),
            F.when(j > i, F.col("theirs")).alias("theirs"),
        )
        .repartition("record", "i", "j")
        .select("ours", "theirs")
    )
    ours = F.col("ours")
    late = F.coalesce("theirs", "ours")
    if low:
        late = F.filter(late, lambda c: c >= low)
    # Of one block, the larger codes are its end, and each is paired with what stands before it.
    rows = short.unionByName(long).select(
        "ours", F.col("theirs").isNull().alias("within"), late.alias("late")
    )
    lasts = F.posexplode(F.when(F.size("late") > 0, F.col("late"))).alias("pos", "b")
    rows = rows.select("ours", "within", F.size("late").alias("n_late"), lasts)
    before = F.slice(ours, F.lit(1), F.size(ours) - F.col("n_late") + F.col("pos"))
    rows = rows.select("b", F.explode(F.when(F.col("within"), before).otherwise(ours)).alias("a"))
    pair = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    return rows.select(pair.alias("pair"))


def named_edges(counted: DataFrame, codes: DataFrame) -> DataFrame:
    """`from < to, value` of counted pairs of codes."""
    one, two = (codes.select(F.col("code").alias(c), F.col("keyword").alias(f"_{c}")) for c in "ab")
    a = F.shiftright("pair", 32).cast("int").alias("a")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b")
    named = counted.select(a, b, "value").join(one, "a").join(two, "b")
    return named.select(
        F.least("_a", "_b").alias("from"), F.greatest("_a", "_b").alias("to"), "value"
    )


def top_edges(edges: DataFrame, n: int = TOP_EDGES) -> DataFrame:
    """LIM3: the heaviest edges, ties by keyword."""
    return edges.orderBy(F.col("value").desc(), "from", "to").limit(n)
