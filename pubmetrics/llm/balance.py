"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pubmetrics.llm.store import stored

#: Words as the package counts them: runs of anything but 0x20 and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that are rounded together, about; a source with more is dealt over several buckets.
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_targets(sizes: DataFrame, group: str, size: str, weights: Sequence[float], most: float) -> DataFrame:
    """Rows (group, group_size, target) from one row per group and its size.

    Groups in code point order, null last, get the weights in turn and share the sum of all sizes by
    them. A target stops at ``most`` times its group's size and what is left over is shared again among
    the others by weight, until none is above: groups are met in the order of most * size / weight, and
    one is full as long as its share of what those before it leave is above that bound.
    """
    order = Window.orderBy(F.col(group).asc_nulls_last())
    n = F.row_number().over(order) - 1
    rows = sizes.select(F.col(group), F.col(size).cast("double").alias("s")).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int")))
    # One row per group here, never per document.
    filling = Window.orderBy(F.col("s") / F.col("w"), F.col(group).asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"total": F.sum("s").over(everything), "weight": F.sum("w").over(everything)})
    left = F.col("total") - most * F.coalesce(F.sum("s").over(before), F.lit(0.0))
    share = left / (F.col("weight") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumns({"share": share, "place": F.row_number().over(filling)})
    room = F.col("share") * F.col("w") <= most * F.col("s")
    rows = rows.withColumn("open", F.min(F.when(room, F.col("place"))).over(everything))
    level = F.max(F.when(F.col("place") == F.col("open"), F.col("share"))).over(everything)
    target = F.when(F.col("place") >= F.col("open"), level * F.col("w")).otherwise(most * F.col("s"))
    return rows.select(group, F.col("s").cast("long").alias("group_size"), target.alias("target"))


def tilts(cells: DataFrame, targets: dict[str, DataFrame], most: float = 3.0, steps: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """Cells (one column per constraint, ``size``) with ``rate``: exp of the sum of their dual variables.

    Minimises the relative entropy of size * rate against size under one constraint per value of each
    column, sum(size * rate) = target. Each value has a dual variable; a Newton step takes it by
    (target - reached) / reached, from sums that tasks combine over all cells, with steps held to 2 so
    that they go downhill. Columns take turns. One number, the largest miss, reaches the driver each
    round; ArithmeticError after ``steps`` rounds if that is above 1e-6. A target of 0 gives rate 0; a value without a target keeps 0 as its dual variable.
    """
    duals = {c: stored(t.select(c, F.col("target").cast("double"), F.lit(0.0).alias("dual")), "tilt") for c, t in targets.items()}

    def tilted() -> DataFrame:
        out = cells
        for c, d in duals.items():
            out = out.join(d.select(F.col(c).alias("_v"), F.col("dual").alias(f"_{c}_dual")), F.col(c).eqNullSafe(F.col("_v")), "left").drop("_v")
        total = sum((F.coalesce(F.col(f"_{c}_dual"), F.lit(0.0)) for c in duals), F.lit(0.0))
        return out.withColumn("rate", F.exp(total)).drop(*[f"_{c}_dual" for c in duals])

    worst = 0.0
    for _ in range(steps):
        worst = 0.0
        for c in duals:
            reached = tilted().groupBy(F.col(c).alias("_v")).agg(F.sum(F.col("size") * F.col("rate")).alias("reached"))
            step = F.when(F.col("target") <= 0, F.lit(float("-inf"))).otherwise(F.least(F.greatest((F.col("target") - F.col("reached")) / F.col("reached"), F.lit(-2.0)), F.lit(2.0)))
            miss = F.when((F.col("target") > 0) & (F.col("reached") > 0), F.abs(F.col("reached") / F.col("target") - 1)).otherwise(F.lit(0.0))
            moved = duals[c].join(reached, F.col(c).eqNullSafe(F.col("_v")), "left")
            moved = stored(moved.select(c, "target", F.when(F.col("reached") > 0, F.col("dual") + step).otherwise(F.col("dual")).alias("dual"), miss.alias("miss")), "tilt")
            worst = max(worst, moved.agg(F.max("miss")).first()[0] or 0.0)
            duals[c] = moved.drop("miss")
        if worst <= tolerance:
            break
    if worst > 1e-6:
        raise ArithmeticError(f"after {steps} rounds a target is still missed by a share of {worst}")
    # Rates leave the last digits of the iteration behind, so that reruns round alike.
    return tilted().withColumn("rate", F.round(F.least("rate", F.lit(float(most))), 9))


def copies(docs: DataFrame, cells: DataFrame, columns: Sequence[str], order: Sequence[str], mark: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Whole copies of each document, near its cell's rate.

    A cell's documents are dealt by hash of ``order``, size and ``mark``, a column that tells rows apart, over buckets of about
    ``bucket_rows``, so rows of one key spread too; in a bucket, from large to small,
    copies are the steps of the rounded running sum of rates, so the copied size stays within about one document
    of the wanted one. Equal rows (in size and ``order``) may trade places without changing a result.
    """
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in columns]
    joined = docs.alias("d").join(cells.alias("c"), same, "left").select("d.*", F.coalesce("c.rate", F.lit(0.0)).alias("rate"), F.coalesce("c.n", F.lit(1)).alias("n"))
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(o).cast("string"), F.lit("")) for o in (*order, "size", mark)])
    spread = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    rows = joined.withColumn("bucket", spread % F.ceil(F.col("n") / bucket_rows))
    place = F.row_number().over(Window.partitionBy(*columns, "bucket").orderBy(F.col("size").desc(), *order, mark))
    rows = rows.withColumn("place", place)
    steps = F.floor(F.col("place") * F.col("rate") + 0.5) - F.floor((F.col("place") - 1) * F.col("rate") + 0.5)
    return rows.withColumn("copies", steps.cast("long")).drop("n")


def mend(counted: DataFrame, targets: DataFrame, column: str, most: int) -> DataFrame:
    """One more or one less copy of one document per value, where that brings its copied size nearer to the target.

    The document is the one whose size is nearest to the miss, found by a combined minimum; ties go to
    the first bucket and place.
    """
    got = counted.groupBy(F.col(column).alias("_v")).agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
    miss = got.join(targets.select(F.col(column).alias("_t"), "target"), F.col("_v").eqNullSafe(F.col("_t"))).select("_v", (F.col("target") - F.col("got")).alias("miss"))
    near = F.abs(F.abs("miss") - F.col("size"))
    can = ((F.col("miss") > 0) & (F.col("copies") < most)) | ((F.col("miss") < 0) & (F.col("copies") > 0))
    options = counted.join(miss, F.col(column).eqNullSafe(F.col("_v"))).where(can & (near < F.abs("miss")))
    chosen = options.groupBy("_v", "miss").agg(F.min(F.struct(near.alias("near"), "bucket", "place")).alias("best"))
    chosen = chosen.select("_v", F.col("best.bucket").alias("_b"), F.col("best.place").alias("_p"), F.signum("miss").cast("long").alias("_more"))
    same = F.col(column).eqNullSafe(F.col("_v")) & (F.col("bucket") == F.col("_b")) & (F.col("place") == F.col("_p"))
    return counted.join(chosen, same, "left").withColumn("copies", F.col("copies") + F.coalesce("_more", F.lit(0))).drop("_v", "_b", "_p", "_more")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: Sequence[float] = (5, 2, 1), most: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """Per document: key, the columns of ``carry``, size (words), source, source_size, target (of its source), rate, copies, taken.

    Sources share the sum of all sizes by their weights, no source above ``most`` times its size
    (``cycled_targets``); entropy balancing tilts documents to those targets and rates are rounded into
    0 to ``most`` copies. A null text has size 0 and gets copies that add nothing, a null source is a source,
    repeated rows are documents of their own, an empty table gives no row.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *carry)
    # Texts are read once; what follows is narrow.
    rows = stored(rows.withColumn("_mark", F.monotonically_increasing_id()), "mix-sizes")
    cells = stored(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix-cells")
    targets = stored(cycled_targets(cells, "source", "size", weights, float(most)), "mix-targets")
    rates = tilts(cells, {"source": targets.select("source", "target")}, float(most))
    counted = stored(copies(rows, rates.select("source", "rate", "n"), ["source"], ["key"], "_mark"), "mix-copies")
    for _ in range(2):
        counted = stored(mend(counted, targets, "source", most), "mix-copies")
    goal = targets.select(F.col("source").alias("_s"), F.col("group_size").alias("source_size"), "target")
    out = counted.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_mark", "bucket", "place")
    return out.withColumn("taken", F.col("copies") * F.col("size"))
