"""Drift, roles, scales and stress on small tables with gaps, ties and overflow."""

from tablesight.operators import keys, profile, scale, structure


def test_drift_without_times_or_columns(spark):
    df = spark.createDataFrame([(1, "a")], "n long, c string")
    assert profile.all_drift(df, "r", [], ["c"], ["n"]).count() == 0
    assert profile.all_drift(df.selectExpr("*", "timestamp '2020-01-01' as t"), "r", ["t"], [], []).count() == 0


def test_drift_along_the_second_time_only(spark):
    rows = [(i, i * 7919 % 500, None if i % 50 == 0 else i, "late" if i > 250 else "early", "same") for i in range(500)]
    df = spark.createDataFrame(rows, "i long, j long, n long, c string, d string").selectExpr(
        "timestamp_seconds(j) as first", "timestamp_seconds(i) as second", "n", "c", "d", "case when i % 2 = 0 then timestamp_seconds(i) end as gappy")
    found = {(r.time_column, r.column): (r.method, r.drift_distance, r.drift_detected) for r in profile.all_drift(df, "r", ["first", "second", "gappy"], ["c", "d"], ["n"]).collect()}
    assert len(found) == 9
    assert found["second", "n"][0] == "ranks" and found["second", "n"][2] and found["second", "c"][2] and found["gappy", "n"][2]
    assert not found["first", "n"][2] and not found["first", "c"][2]
    assert all(found[t, "d"][1] == 0 for t in ("first", "second", "gappy"))


def test_repeat_indexes_bear_nulls_ties_and_a_hot_key(spark):
    rows = [("hot", i + 1, i % 3) for i in range(400)] + [("b", 0, 1), ("b", 1, 1), ("c", 1, 9), (None, 5, 5), ("d", 1, None), ("d", 2, None)]
    df = spark.createDataFrame(rows, "k string, line long, other long")
    found = structure.repeat_indexes(df, "r", ["k"], ["line", "other"]).collect()
    assert [(r["column"], r["checked"], r["held_share"]) for r in found] == [("line", 3, 1.0)]
    assert structure.repeat_indexes(df, "r", [], ["line"]).count() == 0


def test_levels_are_complete_or_marked(spark):
    rows = [(f" {i % 5} ", str(i), None) for i in range(200)] + [("n/a", "", None)]
    hist = profile.cell_histogram(spark.createDataFrame(rows, "few string, many string, none string"), "r")
    levels = scale.complete_levels(hist, most=100).collect()
    assert sorted(r["value"] for r in levels if r["column"] == "few") == list("01234")
    assert [(r["value"], r["too_many"]) for r in levels if r["column"] == "many"] == [(None, True)]
    assert not [r for r in levels if r["column"] == "none"]
    edge = scale.complete_levels(hist, most=5).collect()
    assert sum(r["column"] == "few" and not r["too_many"] for r in edge) == 5


def test_stress_examples_come_in_order_and_nest(spark):
    rows = [("b", 1, "x"), ("b", 2, "x"), ("a", 5, "x"), ("a", 4, "y"), (None, 1, "z"), (None, 2, None)]
    df = spark.createDataFrame(rows, "k string, n long, v string")
    stress, found = keys.key_stress(df, "r", [["k"]], ["n", "v"]), keys.stress_examples(df, "r", [["k"]], ["n", "v"], examples=2)
    (row,) = keys.nested_stress(stress, found).collect()
    assert (row.key, row.repeated_groups, row.drifted_attributes) == ("k", 3, 2)
    top = row.top_drifted_attributes
    assert [a.attribute for a in top] == ["n", "v"] and [e.key_value for e in top[0].example_conflicts] == ["", "a"]
    assert tuple(top[0].example_conflicts[1]) == ("a", "4", "5")


def test_screening_correlations_without_variance(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, None)], "s string, x long")
    found = {r.level: r.correlation for r in keys.all_screening_correlations(df, "r", ["s"], {"f": ["x"]}).collect()}
    assert found == {"a": None, "b": None}
