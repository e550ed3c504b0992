"""Joins with few keys, and where intermediate tables go."""

import pytest
from pyspark.sql import functions as F

from tablesight.plans import shared


@pytest.mark.parametrize("bounds", [{}, {"max_rows": 1}, {"max_bytes": 10}])
def test_lookup_join_is_the_same_within_and_beyond_its_bounds(frame, bounds):
    rows = frame("k int, x string", *[(1, "same")] * 200, (2, "b"), (3, "c"), (None, "d"))
    lookup = frame("k int, name string", (1, "one"), (2, "two"))
    got = shared.left_join_lookup(rows, lookup, ["k"], salts=8, **bounds).groupBy("k", "x", "name").count().collect()
    assert {tuple(r) for r in got} == {(1, "same", "one", 200), (2, "b", "two", 1), (3, "c", None, 1), (None, "d", None, 1)}


def test_equal_rows_of_a_hot_key_take_many_salts(frame):
    rows = frame("k int, x string", *[(1, "same")] * 400)
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(8)))
    assert salted.select("salt").distinct().count() == 8
    plan = shared.left_join_lookup(rows, frame("k int, y int", (1, 1)), ["k"], max_rows=0, salts=8)._jdf.queryExecution().toString()
    assert "monotonically_increasing_id" in plan


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.scratch_folder(Session, "x")
