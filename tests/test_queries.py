"""Every registered query against its SQL on the given tables, and plan rules for all."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from conftest import SF_DIR, plan_of
from pubmetrics.checks import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
WRITES = {"sliced_store", "export_round_trip", "converted_in_place", "clean_run_record", "full_run_record"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def by_name(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    result = db.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert by_name(df.columns, df.collect()) == by_name(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_plan_has_no_python_and_no_unkeyed_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for node in ("Python", "Pandas", "BatchEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_lines_are_shuffled_before_their_names_join(spark):
    plan = plan_of(QUERIES["canonicalize_all"](spark, SF_DIR)).splitlines()
    at = next(i for i, line in enumerate(plan) if "Exchange hashpartitioning(l_orderkey" in line)
    assert "l_partkey" in plan[at + 1] and "p_name" not in plan[at + 1] and "s_name" not in plan[at + 1]
