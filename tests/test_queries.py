"""Every registered query beside its SQL twin."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import DATA, difference, duck

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_its_twin(spark, con, name):
    df = queries()[name](spark, FOLDER)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, sql) is None


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize(
    "name,tables", [("memory_replaced", ["lineitem", "orders"]), ("quiz_history_rows", ["lineitem", "orders"])]
)
def test_each_table_is_read_once(spark, name, tables):
    plan = queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == len(tables)
    assert ("l_orderkey" in plan) and ("o_orderkey" in plan)
