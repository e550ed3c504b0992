"""Every registered query against its SQL on the smallest tables, and the plan it ran with."""

import pytest

from tablesight.catalog import check, load_all
from tablesight.catalog.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def con():
    return check.duck(FOLDER)


def assert_distributed(df):
    """No cross product and no Python on the row path."""
    text = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert_distributed(df)
    ok, note = check.compare(spark, con, lambda *_: df, ORACLES[name], FOLDER)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert_distributed(df)
    assert df.count() > 0


def test_the_comparison_notices_a_wrong_answer(spark, con):
    ok, note = check.compare(spark, con, QUERIES["m_reference_extract"],
                             "select c_custkey as c_nationkey, 'x' as n_name, 'y' as r_name from customer", FOLDER)
    assert not ok and "rows" in note
