"""Frames dealt by run: what is done with them moves no rows, and gives what it gave elsewhere."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesight.catalog import load_all
from tablesight.catalog.registry import QUERIES
from tablesight.operators import patch
from tablesight.plans import shared

CO = "spark.sql.requireAllClusterKeysForCoPartition"


@pytest.fixture
def lines(spark, tmp_path):
    """Line items of 60 orders, some lines twice and some with nulls."""
    n = F.col("id")
    df = spark.range(0, 420, 1, 3).select(
        (n % 60).alias("l_orderkey"), F.when(n % 41 != 0, n * 37 % 900).alias("l_partkey"), F.when(n % 43 != 0, n * 11 % 70).alias("l_suppkey"),
        F.when(n % 47 != 0, (n / 60).cast("int") + 1).alias("l_linenumber"), F.when(n % 37 != 0, (n * 7 % 50).cast("double")).alias("l_quantity"))
    df.unionByName(df.filter("l_orderkey = 7")).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_dealt_alike_meet_where_they_lie(spark, frame):
    rows = frame("k int, c string, v int", *[(i % 5 if i else None, "ab"[i % 2], i) for i in range(20)])
    a = shared.dealt(rows, "k", 3)
    b = shared.dealt(rows.select("k", "c", (F.col("v") * 2).alias("w")), "k", 3)
    was = spark.conf.get(CO)
    joined = a.hint("merge").join(b, ["k", "c"])
    with shared._co_located(spark):
        text = plan(joined)
    assert "Exchange" not in text and spark.conf.get(CO) == was
    key = lambda df: sorted(tuple(r) for r in df.collect())
    kept = shared.dealt(joined, "k", 3)
    assert key(kept) == key(rows.join(rows.select("k", "c", (F.col("v") * 2).alias("w")), ["k", "c"]))
    both = a.select("k", "v").unionByName(b.groupBy("k", "c").agg(F.max("w").alias("v")).select("k", "v")).groupBy("k").agg(F.sum("v").alias("s"))
    assert "Exchange" not in plan(both)
    assert {r.k: r.s for r in both.collect()} == {r.k: r.s for r in rows.select("k", "v").unionByName(
        rows.groupBy("k", "c").agg((F.max("v") * 2).alias("v")).select("k", "v")).groupBy("k").agg(F.sum("v").alias("s")).collect()}


def test_numbering_moves_no_rows_and_keeps_its_names(frame):
    given = [(1, 0, "a"), (1, 1, "a_1"), (1, 2, "a"), (1, 3, "b"), (1, 4, "b"), (1, None, "b"), (1, None, "a"), (None, 1, "a"), (2, 1, None), (2, 5, "a"), (2, 6, "a_2"), (2, 6, "a")]
    rows = frame("run_id int, position int, change_id string", *given)
    want = sorted([(1, 0, "a_1"), (1, 1, "a_1_1"), (1, 2, "a_2"), (2, 5, "a"), (2, 6, "a_1"), (2, 6, "a_2"), (2, 6, "a_1"), (2, 6, "a_2"),
                   (1, -1, "b"), (1, 3, "b_1"), (1, 4, "b_2")])
    for df in (rows, shared.dealt(rows, "run_id", 3)):
        got = patch.unique_ids(df)
        assert got.columns == ["run_id", "position", "change_id", "unique_id"]
        assert sorted((r.run_id, -1 if r.position is None else r.position, r.unique_id) for r in got.collect()) == want
    assert "Exchange" not in plan(patch.unique_ids(shared.dealt(rows, "run_id", 3)).groupBy("run_id").count())


def moves_nothing(spark, monkeypatch, lines, name):
    load_all()

    def refused(self, eager=True):
        raise AssertionError("rows are kept as whole, uncompressed rows")

    monkeypatch.setattr(DataFrame, "checkpoint", refused)
    return "Exchange hashpartitioning" not in plan(QUERIES[name](spark, lines))


def test_envelopes_move_the_lines_once(spark, monkeypatch, lines):
    assert moves_nothing(spark, monkeypatch, lines, "c_review_envelope")


def test_summaries_of_reviews_move_the_lines_once(spark, monkeypatch, lines):
    assert moves_nothing(spark, monkeypatch, lines, "c_review_summary")


def test_change_logs_move_the_lines_once(spark, monkeypatch, lines):
    assert moves_nothing(spark, monkeypatch, lines, "c_change_log")
