"""Publication records derived from the order tables, for checks and benchmarks.

The given tables hold no publications. An order becomes one; its line items give the authors,
keywords and affiliations. `FIXTURES.md` section 3 states the rules.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Country of each nation key.
COUNTRIES = (
    "USA", "Canada", "UK", "Italy", "France", "Germany", "Spain", "Turkey", "Saudi Arabia",
    "UAE", "Qatar", "Iran", "Egypt", "Pakistan", "India", "Bangladesh", "China", "Japan",
    "Malaysia", "Indonesia", "Singapore", "Australia", "Nigeria", "Brazil", "Viet Nam",
)

COLUMNS = (
    "src_ord", "eid", "doi", "title", "cover_date", "pub_year", "creator", "authors", "journal",
    "doc_type", "author_keywords", "index_keywords", "affiliations",
)

# Columns that records in order have besides the chosen ones: sorting by them gives the order of src_ord and moves no row.
ORDER_KEYS = ("o_orderkey", "cp")

_FROM_CUSTOMER = {"title", "journal"}
_FROM_PART = {"author_keywords", "index_keywords"}
_FROM_SUPPLIER = {"creator", "authors", "affiliations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def publications(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] = COLUMNS, *, in_order: bool = False
) -> DataFrame:
    """The chosen columns of the raw record table; only the tables they need are read.

    With `in_order` the rows lie in ranges of their order keys, and the columns ORDER_KEYS are added.
    """
    wanted = set(columns)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    if wanted & _FROM_CUSTOMER:
        customer = table(spark, sf_dir, "customer").select(
            "c_custkey", "c_mktsegment", "c_nationkey"
        )
        orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    if wanted & (_FROM_PART | _FROM_SUPPLIER):
        if in_order:
            orders = _listed_in_order(spark, sf_dir, wanted, orders.drop("o_custkey", "c_custkey"))
        else:
            orders = orders.join(_line_lists(spark, sf_dir, wanted), k == F.col("l_orderkey"), "left")
    elif in_order:
        orders = orders.repartitionByRange("o_orderkey")

    copies = F.when(k % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    cp = F.col("cp")
    year = (F.year("o_orderdate") + k % 24).cast("string")
    month_day = F.substring(F.to_date("o_orderdate").cast("string"), 5, 6)
    title = F.concat(F.lit("  Study  Of "), "c_mktsegment", F.lit(" "), (k % 97).cast("string"))
    journal = F.concat(
        F.lit(" "), "c_mktsegment", F.lit(" Review "), (F.col("c_nationkey") % 8).cast("string")
    )
    rules = {
        "src_ord": lambda: (k * 2 + cp).cast("bigint"),
        "eid": lambda: F.when(k % 13 != 0, F.concat(F.lit("2-s2.0-"), k.cast("string"))),
        "doi": lambda: F.when(
            k % 5 != 0, F.concat(F.lit(" 10.1000/X"), k.cast("string"), F.lit(" "))
        ),
        "title": lambda: F.when(cp == 1, F.upper(title)).otherwise(title),
        "cover_date": lambda: F.when(k % 19 == 0, "n/a").otherwise(F.concat(year, month_day)),
        "pub_year": lambda: F.when(k % 3 == 0, year).when(k % 17 == 0, "n.d."),
        "creator": lambda: F.substring_index("line_authors", ";", 1),
        "authors": lambda: F.when(k % 7 != 0, F.col("line_authors")),
        "journal": lambda: F.when((k % 23 != 0) & (cp == 0), journal),
        "doc_type": lambda: F.col("o_orderpriority"),
        "author_keywords": lambda: F.col("line_names"),
        "index_keywords": lambda: F.col("line_types"),
        "affiliations": lambda: F.col("line_places"),
    }
    return orders.withColumn("cp", F.explode(copies)).select(
        *(rules[c]().alias(c) for c in columns), *(ORDER_KEYS if in_order else ())
    )


def _broadcast(lookup: DataFrame) -> bool:
    """Whether Spark takes the table for small enough to broadcast it."""
    size = lookup._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    most = lookup.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(size)) <= most


def _named_lines(
    spark: SparkSession,
    sf_dir: str,
    wanted: set[str],
    place: Callable[[DataFrame], DataFrame],
    kept: Column | None = None,
) -> DataFrame:
    """Lines where `place` puts them, with the names of their suppliers and parts; rows that `kept` holds for need none.

    Lines move as numbers: a lookup table that can be broadcast joins them where they are then. One too large
    for that moves the lines by its own key, so it joins before they are placed; its names move once.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"
    )
    lookups = []
    if wanted & _FROM_SUPPLIER:
        suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        lookups.append(("l_suppkey", "s_suppkey", suppliers))
    if wanted & _FROM_PART:
        parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
        lookups.append(("l_partkey", "p_partkey", parts))
    small = [_broadcast(lookup) for _, _, lookup in lookups]
    for (key, of, lookup), later in zip(lookups, small):
        if not later:
            lines = lines.join(lookup, F.col(key) == F.col(of)).drop(of)
    lines = place(lines)
    for (key, of, lookup), later in zip(lookups, small):
        if later and kept is None:
            lines = lines.join(lookup, F.col(key) == F.col(of)).drop(of)
        elif later:
            lines = lines.join(lookup, F.col(key) == F.col(of), "left").filter(kept | F.col(of).isNotNull()).drop(of)
    return lines


def _entries(wanted: set[str]) -> tuple[Column, dict[str, str]]:
    """A line as an entry of its order's lists, and the delimiter of each list."""
    values = {}
    if wanted & _FROM_SUPPLIER:
        countries = F.array(*(F.lit(c) for c in COUNTRIES))
        # Spark takes the item for never null, as none in the array is.
        country = F.when(F.col("s_nationkey").isNotNull(), F.element_at(countries, F.col("s_nationkey") + 1))
        values["line_authors"] = (F.col("s_name"), "; ")
        values["line_places"] = (F.concat("s_name", F.lit(", City, "), country), "; ")
    if wanted & _FROM_PART:
        types = F.concat("p_type", F.lit(" ; "), F.upper("p_brand"))
        values["line_names"] = (F.col("p_name"), "; ")
        values["line_types"] = (types, ";")
    entry = F.struct(
        "l_linenumber",
        "l_suppkey",
        "l_partkey",
        *(value.alias(name) for name, (value, _) in values.items()),
    )
    return entry, {name: sep for name, (_, sep) in values.items()}


def _line_lists(spark: SparkSession, sf_dir: str, wanted: set[str]) -> DataFrame:
    """Delimited lists per order, in line order.

    A list is one field of one record, so an order's lines end in one row by definition of the
    record table; orders have about four lines, thirteen at most.
    """
    # Lists gain nothing from being begun in the map tasks: an order's lines are shuffled as they are.
    lines = _named_lines(spark, sf_dir, wanted, lambda lines: lines.repartition("l_orderkey"))
    entry, lists = _entries(wanted)
    ordered = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("lines"))
    return ordered.select(
        "l_orderkey",
        *(F.array_join(F.col(f"lines.{name}"), sep).alias(name) for name, sep in lists.items()),
    )


def _listed_in_order(
    spark: SparkSession, sf_dir: str, wanted: set[str], orders: DataFrame
) -> DataFrame:
    """Orders with their delimited lists, as a join with `_line_lists` gives them, in ranges of their keys.

    Orders and lines move together, once; a sort of the records by order key then finds them in place.
    """
    is_order = F.col("is_order")

    def place(lines: DataFrame) -> DataFrame:
        lines = lines.filter(F.col("l_orderkey").isNotNull()).withColumnRenamed("l_orderkey", "o_orderkey")
        rows = orders.withColumn("is_order", F.lit(True)).unionByName(
            lines.withColumn("is_order", F.lit(False)), allowMissingColumns=True
        )
        return rows.repartitionByRange("o_orderkey")

    rows = _named_lines(spark, sf_dir, wanted, place, is_order)
    entry, lists = _entries(wanted)
    lines = F.collect_list(F.when(~is_order, entry)).over(Window.partitionBy("o_orderkey"))
    rows = rows.withColumn("lines", lines).filter(is_order).withColumn("lines", F.sort_array("lines"))
    return rows.select(
        *orders.columns,
        *(
            F.when(F.size("lines") > 0, F.array_join(F.col(f"lines.{name}"), sep)).alias(name)
            for name, sep in lists.items()
        ),
    )
