"""What queries leave on disk and move over it: shuffles of writes, lookups too large to broadcast, sorted exports."""

from contextlib import contextmanager
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from pubmetrics import sources as src
from pubmetrics.views import COLUMNS, ORDER_KEYS, publications


@contextmanager
def broadcast_to(spark, size):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(size))
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Order tables with null and repeated keys, orders without lines and lines without names."""
    folder = str(tmp_path_factory.mktemp("odd"))
    day = datetime(2001, 2, 3)
    keys = [*range(1, 60), 22, 33, 33, None, None]
    orders = [(k, None if k == 5 else (k or 0) % 4, None if k == 7 else day, f"{(k or 0) % 3}-X") for k in keys]
    lines = [(k, (k or 9) * n % 7, None if n == 3 else (k or 9) % 5, n) for k in [*range(0, 50), 33, None] for n in range((k or 3) % 5)]
    lines += [(2, 1, 1, None), (2, None, 1, 1)]
    parts = [(i, None if i == 2 else f"name {i}", f"B#{i}", f"TYPE {i}") for i in [0, 1, 1, 2, 3, 4, 5, None]]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
        "part": (parts, "p_partkey long, p_name string, p_brand string, p_type string"),
        "supplier": ([*((i, f"S{i}", i) for i in (0, 1, 2, 2, 3)), (4, "S4", None), (3, None, 3)], "s_suppkey long, s_name string, s_nationkey int"),
        "customer": ([(i, f"SEG{i}", i) for i in range(4)], "c_custkey long, c_mktsegment string, c_nationkey int"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("size", [-1, 10 << 20])
@pytest.mark.parametrize("columns", [COLUMNS, ("src_ord", "authors"), ("src_ord", "index_keywords"), ("src_ord", "journal"), ("eid",)])
def test_records_in_order_are_the_records(spark, odd, size, columns):
    wanted = sorted(rows(publications(spark, odd, columns)), key=repr)
    assert len(wanted) > 50
    with broadcast_to(spark, size):
        got = publications(spark, odd, columns, in_order=True)
        assert got.columns == [*columns, *ORDER_KEYS]
        assert sorted(rows(got.drop(*ORDER_KEYS)), key=repr) == wanted
        assert sorted(rows(publications(spark, odd, columns)), key=repr) == wanted


@pytest.mark.parametrize("size", [-1, 10 << 20])
def test_records_in_order_are_sorted_in_place(spark, odd, tmp_path, size):
    with broadcast_to(spark, size):
        got = publications(spark, odd, in_order=True)
        # One exchange by ranges, of orders and lines, and none for the sort.
        assert plan_of(got.orderBy(*ORDER_KEYS)).count("rangepartitioning") == 1
        path = src.write_records(got.withColumn("n", F.col("src_ord")), f"{tmp_path}/t", "csv", order=ORDER_KEYS)
    back = src.load_records(spark, path, ordered=True)
    assert back.columns == ["src_ord", *(c for c in COLUMNS if c != "src_ord"), "n"]
    found = [r.n and int(r.n) for r in back.orderBy("src_ord").select("n").collect()]
    assert found == sorted(found, key=lambda n: -1 if n is None else n) and len(found) == got.count()


def test_lines_move_by_order_once(spark, odd):
    for size in (-1, 10 << 20):
        with broadcast_to(spark, size):
            assert plan_of(publications(spark, odd)).count("Exchange hashpartitioning(l_orderkey") == 1


def test_names_that_are_broadcast_do_not_move(spark, odd, tmp_path):
    """Parts are too large here, suppliers are not: names of suppliers join after the lines moved by order."""
    for name in ("orders", "supplier", "customer"):
        spark.read.parquet(f"{odd}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    text = F.sha2(F.col("id").cast("string"), 256)
    parts = spark.range(9000).select(F.col("id").alias("p_partkey"), text.alias("p_name"), text.alias("p_brand"), text.alias("p_type"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    number = F.lit(1).cast("int").alias("l_linenumber")
    lines = spark.range(50_000).select(F.xxhash64("id").alias("l_orderkey"), F.col("id").alias("l_partkey"), F.lit(2).cast("long").alias("l_suppkey"), number)
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    with broadcast_to(spark, 100_000):
        plan = plan_of(publications(spark, str(tmp_path))).split("Exchange hashpartitioning(l_orderkey")
    assert len(plan) == 2 and "SortMergeJoin [l_partkey" in plan[1]
    moved = plan[1].splitlines()[1]
    assert "p_name" in moved and "s_name" not in moved


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (found.apply(i).getName() for i in range(found.size()))
        return {n for n in names if n.startswith("shuffle_")}

    df = spark.range(1000).select((F.col("id") % 7).alias("src_ord"), F.col("id").cast("string").alias("t"))
    before = files()
    src.write_records(df, f"{tmp_path}/a", "csv")
    src.write_csv(df.repartition("t"), f"{tmp_path}/b")
    found = src.stored(df.groupBy("t").count(), "counts")
    assert files() <= before
    assert found.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
