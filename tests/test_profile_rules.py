"""Cases in which columns, nulls or names lie where short-cuts would miss them."""

from pyspark.sql import functions as F

from tablesight.functions import cells
from tablesight.operators import families, keys, structure
from tablesight.plans.dataset_profile import profile_dataset
from tablesight.sources import tables


def survey(spark, rows=400):
    """A gate after ten answers that empties three columns; only three key columns together identify a row."""
    base = spark.range(rows)
    answers = [((F.col("id") * (k + 3)) % 5).cast("string").alias(f"Q{k}_answer_x") for k in range(10)]
    asked = F.col("id") % 3 == 0
    gated = [F.when(asked, ((F.col("id") + k) % 4).cast("string")).alias(c) for k, c in enumerate(("Side", "Dose", "Again"))]
    parts = [(F.floor(F.col("id") / d) % 8).cast("string").alias(c) for c, d in (("Part A", 1), ("Part B", 8), ("Part C", 64))]
    return base.select(*parts, F.when(F.col("id") % 2 == 0, "f").otherwise("m").alias("Gender"), *answers,
                       F.when(asked, "yes").otherwise("no").alias("Gate"), *gated)


def test_bundle_finds_late_gates_and_wide_keys(spark):
    bundle = profile_dataset(survey(spark), "survey")
    found = {(r.trigger_column, r.affected_column) for r in bundle["A16.detected_skip_logic"].collect()}
    assert {("Gate", c) for c in ("Side", "Dose", "Again")} <= found
    protected = {r.column for r in bundle["A17.columns"].where("skip_logic_protected").collect()}
    assert protected == {"Side", "Dose", "Again"}
    assert bundle["A6.tests"].where("grain_rank = 1").first().keys_tested == "Part A,Part B,Part C"
    assert bundle["A14.columns"].where("drift_detected is not null").count() == 0  # no time column, so nothing is tested


def test_columns_of_one_gap_pattern_are_tested_once(spark):
    df = survey(spark)
    assert structure.gap_groups(df, ["Side", "Gate", "Dose", "Again"]) == [["Side", "Dose", "Again"], ["Gate"]]
    all_at_once = structure.all_skip_logic(df, "s", ["Gate", "Side"], ["Side", "Dose", "Again"])
    one_by_one = structure.skip_logic(df, "s", ["Gate", "Side"], ["Side", "Dose", "Again"])
    assert sorted(map(tuple, all_at_once.collect())) == sorted(map(tuple, one_by_one.collect()))


def test_fingerprints_see_where_nulls_stand(frame):
    df = frame("k int, a int, b int", (1, None, 5), (1, 5, None), (2, None, None), (2, None, None))
    got = {r.k: r.conflict for r in keys.key_collisions(df, "r", ["k"]).collect()}
    assert got == {1: True, 2: False}
    assert keys.grain_tests(df, "r", [["k"]]).first().non_key_conflict_group_pct == 50
    swapped = frame("k int, a int, b int", (1, 5, None), (1, 5, None), (2, None, None), (2, None, None))
    assert tables.manifest(df, "r", "").first().content_checksum != tables.manifest(swapped, "r", "").first().content_checksum


def test_commas_group_thousands_only(frame):
    texts = ["1,234", "-1,234,567.5", "$1,000", " 12 ", "€ 7.5", "1,3", "1,2,3", "12 34", "1,23,456", ",5", "12,3456"]
    got = [r[0] for r in frame("c string", *[(t,) for t in texts]).select(cells.as_double(F.col("c"))).collect()]
    assert got == [1234.0, -1234567.5, 1000.0, 12.0, 7.5, None, None, None, None, None, None]


def test_family_ids_are_unique_in_a_run(spark):
    names = ["A1_Q1", "A1_Q2", "A1_1", "A1_2", "a1 1", "a1 2", "B_1", "B_2"]
    catalog = spark.createDataFrame([("r", i, c) for i, c in enumerate(names)], "run_id string, ordinal int, column string")
    found = {r.family_id: r["columns"] for r in families.families(catalog).collect()}
    assert len(found) == 4 and sorted(c for cs in found.values() for c in cs) == sorted(names)
    assert found["a_1_q"] == ["A1_Q1", "A1_Q2"] and found["b"] == ["B_1", "B_2"]


def test_wide_sets_are_pruned_by_counts():
    assert keys.worthwhile_sets(["a", "b", "c", "id"], {"a": 10, "b": 5, "c": 3, "id": 100}, 100, 3) == [("a", "b", "c")]
    assert keys.worthwhile_sets(["a", "b"], {"a": 10, "b": 5}, 100) == []


def test_near_duplicate_columns_are_found_without_equal_histograms(spark):
    from tablesight.operators import profile

    df = spark.range(200).selectExpr("cast(id % 7 as string) as a", "case when id = 5 then 'typo' else cast(id % 7 as string) end as b",
                                     "cast((id + 1) % 7 as string) as c", "cast(null as string) as d")
    pairs = keys.candidate_column_pairs(profile.cell_histogram(df, "r"), ["a", "b", "c", "d"])
    assert ("a", "b") in pairs and not any("d" in p for p in pairs)
    found = {(r.left_column, r.right_column): r.agreement for r in keys.near_duplicate_columns(df, "r", pairs).collect()}
    assert found["a", "b"] == 0.995 and found["a", "c"] == 0
