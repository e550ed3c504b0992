"""Physical plans: top-k cut before shuffles, one scan per table, only the needed columns."""

import pytest

from tablesight.catalog import load_all
from tablesight.catalog.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
load_all()


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a2_top_levels", "a2_samples", "prune_limits", "prune_reviewer_focus", "a6_best_grain_topk"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    assert "Partial" in plan(spark, name).split("WindowGroupLimit", 1)[1]


def test_grain_tests_read_the_table_once(spark):
    assert plan(spark, "a6_grain_tests").count("FileScan") == 1


def test_scans_read_only_the_columns_they_need(spark):
    text = plan(spark, "a5_pair_keys")
    assert "l_extendedprice" not in text and "l_shipdate" not in text


def test_retention_filter_reaches_the_scan(spark):
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan(spark, "s_retention")
