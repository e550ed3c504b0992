"""What keeps larger tables within time and shuffle: results as before, and the work that no longer grows."""

from itertools import combinations

from pyspark.sql import functions as F

from tablesight.functions import cells
from tablesight.operators import keys, lattice, patch, profile, rules, scale
from tablesight.plans import validate


def test_bins_count_cut_points_below_without_a_loop_per_point(spark):
    points = [-1.5, 0.0, 2.0, 2.5, 7.0]
    df = spark.createDataFrame([(v,) for v in (None, -2.0, -1.5, 0.0, 0.1, 2.0, 2.4, 2.5, 6.9, 7.0, 8.0, float("nan"), float("inf"))], "v double")
    for upto in range(len(points) + 1):
        part = points[:upto]
        got = {str(r.v): r.b for r in df.select("v", profile._bin(F.col("v"), part).alias("b")).collect() if r.v is not None}
        assert got == {str(v): sum(v > p or v != v for p in part) for v in map(float, got)}
    plan = df.select(profile._bin(F.col("v"), points).alias("b"))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan


def _lines(spark):
    """Orders of four lines, one order and one part null, one line written twice, and every hundredth line differing."""
    n = F.col("id")
    rows = spark.range(0, 8000, 1, 4).select(
        F.when(n >= 4, F.floor(n / 4)).alias("o"), (n % 4).cast("int").alias("l"), F.when(n != 77, n * 7919 % 3001).alias("p"),
        F.when(n % 100 == 0, n).otherwise(F.floor(n / 4)).cast("string").alias("v"))
    return rows.unionByName(rows.where("o = 9 and l = 1"))


def test_sets_with_a_shared_column_are_grouped_after_one_shuffle(spark):
    df, sets = _lines(spark), [["o"], ["o", "l"], ["o", "p", "l"], ["p", "l"]]
    got = {r.keys_tested: (r.n_rows, r.n_groups, r.non_key_conflict_group_pct) for r in keys.grain_tests(df, "r", sets).collect()}
    rows = [tuple(r) for r in df.collect()]
    for s in sets:
        groups = {}
        for row in rows:
            groups.setdefault(tuple(row["olpv".index(k)] for k in s), []).append(row)
        many = [g for g in groups.values() if len(g) > 1]
        assert got[",".join(s)] == (len(rows), len(groups), round(100 * sum(len(set(g)) > 1 for g in many) / max(len(many), 1), 6))
    assert list(keys._shared_columns(df, sets)[0]) == ["o"]
    plan = keys._grouped(df, sets[:3], [F.count(F.lit(1)).alias("n")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" not in plan


def test_a_hot_column_is_not_dealt_by(spark):
    df = _lines(spark).withColumn("o", F.when(F.col("o") % 3 == 0, 0).otherwise(F.col("o")))
    sets = [["o"], ["o", "l"]]
    assert keys._shared_columns(df, sets) == ({}, 8001)
    got = {r.keys_tested: r.n_groups for r in keys.grain_tests(df, "r", sets).collect()}
    assert got == {"o": df.select("o").distinct().count(), "o,l": df.select("o", "l").distinct().count()}


def test_stress_and_its_examples_read_the_same_shuffle(spark):
    df, sets = _lines(spark), [["o"], ["o", "l"]]
    got = {(r.key, r.attribute): (r.repeated_groups, r.drift_pct) for r in keys.key_stress(df, "r", sets, ["v", "l"]).collect()}
    assert got == {("o", "v"): (2000, 3.95), ("o", "l"): (2000, 100.0), ("o,l", "v"): (1, 0.0)}
    found = keys.stress_examples(df, "r", sets, ["v"]).collect()
    assert [(r.key, r.key_value) for r in sorted(found, key=lambda r: r.key_value)] == [("o", "100"), ("o", "1000"), ("o", "1025")]


def test_ladders_are_inferred_from_one_row_per_column_and_text(spark):
    texts = {"good": ["Low 1", "High 2 ", "High 2"], "one": ["Low 1"], "same_score": ["Low 1", "High 1"], "signed_zero": ["Low 0", "High -0"],
             "plain": ["1", "2"], "word": ["Low 1", "Never"]}
    levels = spark.createDataFrame([("r", c, v) for c, vs in texts.items() for v in vs], "run_id string, column string, value string")
    none = spark.createDataFrame([], "run_id string, column string, family_id string, primary_role string")
    out = scale.infer_textual(levels, none, none)
    assert {r.target_id: r.ordered_labels for r in out.collect()} == {"good": ["Low 1", "High 2"]}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_back_from_a_histogram_made_once(spark, monkeypatch):
    made = []
    keep = profile.stored
    monkeypatch.setattr(profile, "stored", lambda df, name="table": made.append(name) or keep(df, name))
    df = spark.range(200).select(F.concat(F.lit("a long text that ends in its number " * 3), F.col("id") % 50).alias("t"), F.col("id").alias("n"))
    hist = profile.with_texts(profile.digest_histogram(df, "r"), df, "r", 3, 2)
    assert made[0] == "narrow-histogram"
    plain = profile.cell_histogram(df, "r")
    for got, want in ((profile.top_levels(hist, 3), profile.top_levels(plain, 3)), (profile.column_stats(hist), profile.column_stats(plain))):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_most_column_sets_never_meet_all_rows(spark, monkeypatch):
    monkeypatch.setattr(lattice, "ROWS_SEEN", 50, raising=False)
    n = F.col("id")
    df = spark.range(0, 6000, 1, 4).select((n % 60).alias("a"), F.floor(n / 60).alias("b"), (n % 77).alias("c"), (n * 7919 % 83).alias("d"),
                                           F.when(n % 5 > 0, n * 31 % 89).alias("e"), (n % 97 * n % 91).alias("f"))
    levels = {c: df.select(c).distinct().count() for c in df.columns}
    seen, unique = [], lattice._unique
    monkeypatch.setattr(lattice, "_unique", lambda f, sets, modulus: seen.append((modulus, len(sets))) or unique(f, sets, modulus))
    monkeypatch.setattr(lattice, "PATTERNS", 1)  # hardly any witness, so that passes have to tell
    got = lattice.minimal_keys(df, df.columns, levels, 6000, lattice.Witnesses(df.columns), largest=2)
    assert got == [s for s in combinations(df.columns, 2) if df.select(*s).distinct().count() == 6000]
    assert ("a", "b") in got and seen[0][0] == 64 and sum(k for m, k in seen if m == 1) <= len(got) + 2


def test_dependents_of_a_side_are_judged_together_then_one_by_one(spark, monkeypatch):
    n = F.col("id")
    df = spark.range(0, 4000, 1, 4).select((n % 400).alias("x"), (n % 400 % 7).alias("good"), F.when(n % 400 > 3, n % 400 % 9).alias("gap"),
                                           F.when(n != 3999, n % 400 % 5).alias("one_off"))
    claims = {("x",): ["good", "gap", "one_off"], ("good", "gap"): ["x"]}
    asked, counted = [], lattice._counted
    monkeypatch.setattr(lattice, "_counted", lambda f, c: asked.append([tuple(ys) for _, ys in c]) or counted(f, c))
    assert lattice._held(df, claims) == {("x",): (["good", "gap"], 400)}
    assert asked == [[("good", "gap", "one_off"), ("x",)], [("good",), ("gap",), ("one_off",)]]


def test_a_log_entry_writes_one_field_as_text_not_all(spark):
    kinds = "run_id long, column string, ordinal int, canonical_modeling_status string, type_decision_source string, missingness_decision_source string"
    before = spark.createDataFrame([(1, "a", 0, "unresolved", "a17_baseline", "a17_baseline", "iden\"tifier", 0.25, ["x", "y"], True, None)],
                                   f"{kinds}, recommended_logical_type string, confidence double, interpretation_hints array<string>, needs_human_review boolean, semantic_meaning string")
    given = [("recommended_logical_type", '"free_text"', '"iden\\"tifier"'), ("confidence", "0.5", "0.25"), ("interpretation_hints", '["z"]', '["x","y"]'),
             ("needs_human_review", "false", "true"), ("semantic_meaning", '"m"', "null"), ("type_decision_source", '"other"', None)]
    patches = spark.createDataFrame([(1, i, "c", "a", f, v, "r", "j", 0.9, False) for i, (f, v, _) in enumerate(given)],
                                    "run_id long, position long, change_id string, column string, field string, after_value string, reasoning string, justification string, confidence double, needs_human_review boolean")
    log = patch.change_log(patches, before, patch.apply(before, patches)).orderBy("position").collect()
    assert [(r.before_value, r.after_value) for r in log] == [(old, new if old else None) for _, new, old in given]
    assert [r.change_id for r in log] == ["c", *[f"c_{i}" for i in range(1, 6)]]
    plan = patch.change_log(patches, before, patch.apply(before, patches))._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan and "map(" not in plan  # the log is written once; numbering reads it without making values again


def test_rules_of_one_kind_stay_out_of_one_generated_method(spark):
    row = {"run_id": 1, "position": 3, "table_name": " ", "kind": "cube", "source_basis_kind": "primary_grain", "parent_table_name": None, "repeat_index_name": "", "build_strategy": "direct_select",
           "confidence": 2.0, "reasoning": "r", "needs_human_review": False, "source_family_id": "f", "included_column_count": 1, "parent_key": ["id"], "grain_columns": [],
           "excluded_columns": [], "included_columns": [], "included_columns_preview": []}
    texts = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'boolean' if v is False else 'double' if v == 2.0 else 'int' if isinstance(v, int) else 'string'}" for k, v in row.items())
    df = spark.createDataFrame([tuple(row.values())], texts)
    errors = rules.layout_table_rules().errors(df)
    path = "table_suggestions[3]"
    assert [(r.rule, r.message) for r in errors.orderBy("rule").collect()] == list(enumerate([
        f"{path}.parent_table_name is required.", f"{path}.table_name must not be blank.", f"{path}.kind is invalid.", f"{path}.grain_columns must not be empty.",
        f"{path}.confidence must be between 0 and 1.", f"{path}.source_family_id must be omitted or blank for non-family tables."]))
    parts = errors._jdf.queryExecution().debug().codegenToSeq().iterator()
    longest = 0
    while parts.hasNext():
        longest = max(longest, parts.next()._3().maxMethodCodeSize())
    assert longest < 8000  # the JVM runs longer methods without compiling them


def test_a_document_is_parsed_once_for_its_fault_and_a_field_typed_once(spark):
    texts = ['{"a": 1}', ' \n{"a": [1, {"b": 2}]}', "[1]", '"x"', "3", '{"a": 1} x', '{"a": 1}, 2', "", " \t", None, "{", "null", '{"a": 1}\x0b']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "run_id int, raw string")
    got = [r.e for r in df.select("run_id", cells.json_error(F.col("raw"), "x").alias("e")).orderBy("run_id").collect()]
    root, bad, empty = "x root must be an object.", "x is not valid JSON", "x is empty."
    assert got == [None, None, root, root, root, bad, bad, empty, empty, "x must be a string.", bad, root, bad]
    plan = df.select(cells.json_error(F.col("raw"), "x").alias("e"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson(") + plan.count("parse_json(") <= 1 and "schema" not in plan
    values = ["1", "1.5", "true", '"s"', "null", "[]", '[{"a": 1}]', "{}", '{"a": [1]}']
    v = F.try_parse_json("raw")
    kinds = spark.createDataFrame([(i, t) for i, t in enumerate([*values, "{"])], "i int, raw string").select("i", validate._kind(v).alias("k"))
    assert [r.k for r in kinds.orderBy("i").collect()] == ["NUMBER", "NUMBER", "BOOLEAN", "STRING", "VOID", "ARRAY", "ARRAY", "OBJECT", "OBJECT", None]
