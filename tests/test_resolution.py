"""Scales, patches, normaliser, pages, pruning and storage on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from tablesight.functions import cells, transforms
from tablesight.operators import contract, pages, patch, profile, prune, rules, scale, structure
from tablesight.plans import worker_views
from tablesight.plans.shared import left_join_lookup
from tablesight.sources import sheets, tables

SCALE = ("run_id string, target_kind string, target_id string, mapping_status string, response_scale_kind string, ordered_labels array<string>, "
         "label_to_ordinal_position map<string,double>, label_to_numeric_score map<string,double>, numeric_score_semantics_confirmed boolean, "
         "source string, notes string, confidence double")


def mapping(target, labels, status="codebook_confirmed", scores=None):
    scores = scores or {label: float(i + 1) for i, label in enumerate(labels)}
    return ("r", "column", target, status, "likert", labels, {label: float(i + 1) for i, label in enumerate(labels)}, scores, True, "book", "Book.", 0.9)


def observed(frame, target, values):
    levels = frame("run_id string, column string, value string", *[("r", target, v) for v in values])
    return scale.observed_values(levels, frame("run_id string, column string, family_id string"))


HYBRID = ["No anxiety 1", "2", "3", "4", "Strong anxiety 5"]


def test_hybrid_labels_become_observed_numbers(frame):
    out = scale.reconcile(frame(SCALE, mapping("x", HYBRID)), observed(frame, "x", [" 1 ", "2", " 3", "4 ", "5"])).first()
    assert out.ordered_labels == ["1", "2", "3", "4", "5"] and not out.mismatch
    assert out.label_to_numeric_score == {"1": 1, "2": 2, "3": 3, "4": 4, "5": 5}
    assert "Codebook meaning: 1 = No anxiety; 5 = Strong anxiety." in out.notes


def test_textual_labels_stay(frame):
    labels = ["No anxiety", "Low", "Moderate", "High", "Strong anxiety"]
    out = scale.reconcile(frame(SCALE, mapping("x", labels)), observed(frame, "x", labels)).first()
    assert out.ordered_labels == labels and not out.mismatch


def test_ambiguous_mapping_is_left_and_flagged(frame):
    labels = ["No anxiety 1", "2", "3", "Strong anxiety 5"]
    out = scale.reconcile(frame(SCALE, mapping("x", labels)), observed(frame, "x", ["1", "2", "4", "5"]))
    assert out.first().ordered_labels == labels
    flag = scale.mismatch_flags(out).first()
    assert (flag.item, flag.issue) == ("column:x", "scale_mapping_source_value_mismatch")


def test_human_rows_win_and_placeholders_drop(frame):
    sheet = frame("run_id string, target_kind string, target_id string, response_scale_kind string, ordered_labels_low_to_high string, "
                  "numeric_scores_low_to_high string, notes string",
                  ("r", "column", "x", "k", "Never Heard of It 0|Somewhat Familiar 3|Very Familiar 6", "", ""), ("r", "family", "y", "", "", "", ""))
    rows = scale.handoff(sheet)
    assert [r.ordered_labels[0] for r in rows.collect()] == ["Never Heard of It 0"]
    out = scale.resolve(scale.human_mappings(rows), frame(SCALE, mapping("x", HYBRID)), frame(SCALE, mapping("x", ["a 1", "b 2"], "deterministic_inferred")))
    assert [(r.target_id, r.mapping_status) for r in out.collect()] == [("x", "human_confirmed")]


def test_inference_wants_textual_ladders(frame):
    ladder = ["Strongly disagree 1", "Disagree 2", "Neutral 3", "Agree 4", "Strongly agree 5"]
    data = {"ID": ["1", "2"], "Age": ["18", "19"], "GPA": ["2.7", "3.0"], "Overall": ladder, "Member1": ["Low 1", "High 2"]}
    levels = frame("run_id string, column string, value string", *[("r", c, v) for c, vs in data.items() for v in vs])
    members = frame("run_id string, column string, family_id string", ("r", "Member1", "member"))
    roles = frame("run_id string, column string, primary_role string", ("r", "ID", "id_key"))
    out = scale.infer_textual(levels, members, roles).collect()
    assert [(r.target_id, r.ordered_labels) for r in out] == [("Overall", ladder)]


def first_free(ids):
    seen, out = set(), []
    for base in ids:
        name, n = base, 1
        while name in seen:
            name, n = f"{base}_{n}", n + 1
        seen.add(name)
        out.append(name)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_change_ids_match_brute_force(frame, seed):
    rng = random.Random(seed)
    pool = ["a", "a_1", "a_1_1", "a_2", "b", "c_9", "d"]
    runs = {f"r{i}": [rng.choice(pool) for _ in range(rng.randint(1, 12))] for i in range(6)}
    rows = frame("run_id string, position int, change_id string", *[(r, i, c) for r, ids in runs.items() for i, c in enumerate(ids)])
    got = {(r.run_id, r.position): r.unique_id for r in patch.unique_ids(rows).collect()}
    for run, ids in runs.items():
        assert [got[run, i] for i in range(len(ids))] == first_free(ids)


def test_patch_can_set_null_and_later_patch_wins(frame):
    base = frame("run_id string, column string, ordinal int, semantic_meaning string, confidence double", ("r", "x", 0, "old", 0.5), ("r", "y", 1, "keep", 0.5))
    patches = frame("run_id string, position int, column string, field string, after_value string",
                    ("r", 0, "x", "confidence", "0.7"), ("r", 1, "x", "confidence", "0.9"), ("r", 2, "x", "semantic_meaning", "null"))
    out = {r.column: r for r in patch.apply(base, patches).collect()}
    assert out["x"].confidence == 0.9 and out["x"].semantic_meaning is None
    assert (out["y"].confidence, out["y"].semantic_meaning) == (0.5, "keep")


def test_stale_summary_count_is_logged_once_with_blank_column(frame):
    from tablesight import vocab

    schema = "run_id string, " + ", ".join(f"{c} bigint" for c in vocab.SUMMARY_COUNTS)
    new = [3, 3, 0, 0, 1, 0, 2, 1, 2]
    old = [3, 3, 0, 0, 9, 0, 2, 1, 2]
    rows = patch.summary_corrections(frame(schema, ("r", *old)), frame(schema, ("r", *new))).collect()
    assert [(r.column, r.change_id, r.before_value, r.after_value) for r in rows] == [("", "sys_summary_reviewed_override_count", "9", "1")]


def test_normaliser_steps_see_each_other(frame):
    base = "struct<missingness_disposition:string,missingness_handling:string,missingness_decision_source:string,skip_logic_protected:boolean>"
    rows = frame(f"column string, missingness_disposition string, missingness_handling string, missingness_decision_source string, skip_logic_protected boolean, base {base}, token_flag boolean",
                 ("revert", "token_missingness_present", "retain_with_caution", "family_default", True, ("no_material_missingness", "retain_with_caution", "a17_baseline", True), None),
                 ("protect", "structurally_valid_missingness", "protect_from_null_penalty", "reviewed_missingness_worker", False, None, None))
    out = {r.column: r for r in contract.normalize_missingness(rows).collect()}
    assert out["revert"].normalization_notes_list == [
        "reverted_invalid_family_default_missingness", "coerced_missingness_handling_to_single_allowed_value",
        "cleared_skip_logic_for_no_material_missingness"]
    assert (out["revert"].missingness_handling, out["revert"].skip_logic_protected) == ("no_action_needed", False)
    assert out["protect"].skip_logic_protected is True


def test_page_selection_and_fallback(frame):
    schema = "run_id string, page_number int, text string, char_count int"
    hit = frame(schema, ("r", 1, "introduction page", 150), ("r", 2, "Q9Main_cell_group Never Heard of It", 120), ("r", 3, "", 0), ("r", 4, "", 0), ("r", 5, "", 0))
    out = pages.select_pages(pages.mark_pages(hit, ["q9main_cell_group"])).orderBy("page_number").collect()
    assert [r.page_number for r in out] == [1, 2, 3, 4, 5] and not out[0].used_fallback
    miss = frame(schema, *[("r", i, "overview", 120) for i in range(1, 6)])
    out = pages.select_pages(pages.mark_pages(miss, ["nothing"])).orderBy("page_number").collect()
    assert [r.page_number for r in out] == [1, 2, 3, 4] and out[0].used_fallback


def test_transform_actions(frame):
    cases = {
        "trim_whitespace": ("\n\n\n\nClub \n", "Club"), "normalize_missing_tokens": ("N/A", None), "normalize_boolean_tokens": ("Yes", True),
        "cast_to_integer": ("4.5", None), "strip_numeric_formatting": ("$1,234.50", "1234.50"), "normalize_decimal_separator": ("1.234,50", "1234.50"),
        "normalize_category_tokens": (" Pay_Pal ", "pay pal"), "extract_numeric_component": ("about 12.5 kg", "12.5"), "titlecase_values": ("a-b cD", "A-b Cd"),
        "cast_to_date": ("2025-02-30", None), "lowercase_values": ("AbC", "abc"),
    }
    for action, (given, want) in cases.items():
        row = frame("c string", (given,)).select(transforms.ACTIONS[action](F.col("c")).alias("v")).first()
        assert row.v == want, action
    units = {"72kg": "72", "€560K": "560000", "€103.5M": "103500000", "4 ★": "4"}
    for given, want in units.items():
        assert frame("c string", (given,)).select(transforms.strip_unit_suffix(F.col("c")).alias("v")).first().v == want
    date = frame("c string", ("Jul 1, 2004",)).select(cells.as_date(F.col("c")).alias("v")).first().v
    assert date.isoformat() == "2004-07-01"


def test_csv_cells_keep_their_text(spark, tmp_path):
    (tmp_path / "f.csv").write_text('ID,Club,Value\n1,"\n\n\n\nFC ""One""","$1,234.50"\n002, padded ,2025-02-30\n')
    rows = tables.ingest_delimited(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("1", '\n\n\n\nFC "One"', "$1,234.50"), ("002", " padded ", "2025-02-30")]


def test_artifacts_are_immutable(spark, frame, tmp_path):
    df = frame("run_id string, v int", ("a", 1), ("b", 2))
    folder = str(tmp_path / "store")
    tables.write_artifacts({"A2": df}, folder)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tables.write_artifacts({"A2": df}, folder)
    with pytest.raises(ValueError):
        tables.append_run(frame("run_id string, v int", ("b", 3)), folder, "A2")
    tables.append_run(frame("run_id string, v int", ("c", 3)), folder, "A2")
    assert tables.catalog({"A2": tables.read_artifact(spark, folder, "A2")}).count() == 3
    tables.write_artifacts({"A4": df}, folder, buckets=3)
    one = tables.read_run(spark, folder, "A4", "b", buckets=3)
    assert [(r.run_id, r.v) for r in one.collect()] == [("b", 2)]
    assert "run_bucket" not in tables.read_artifact(spark, folder, "A4").columns
    with pytest.raises(ValueError, match="bucketed"):
        tables.append_run(frame("run_id string, v int", ("z", 3)), folder, "A4")
    runs = spark.sql("select 'a' as run_id, timestamp_ntz '2024-01-20' as run_ts union all select 'b', timestamp_ntz '2024-01-01'")
    left = tables.drop_expired(df, runs, F.lit("2024-01-31").cast("timestamp_ntz"))
    assert [r.run_id for r in left.collect()] == ["a"]
    built = tables.read_or_build(spark, folder, "A17", lambda: df)
    assert built.count() == 2


def test_lookup_join_is_the_same_with_and_without_broadcast(spark, frame):
    left = frame("k int, v int", *[(1 if i % 3 else i, i) for i in range(300)])
    right = frame("k int, w string", *[(i, f"w{i}") for i in range(50)])
    small = left_join_lookup(left, right, ["k"])
    spread = left_join_lookup(left, right, ["k"], max_rows=10, salts=4)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, spread.collect()), key=str)


def test_skip_logic_finds_the_gate(frame):
    rows = frame("gate string, a string, b string", *[("Yes", "1", None) if i % 2 else ("No", None, "x") for i in range(40)])
    found = {(r.trigger_test, r.trigger_value, r.affected_column, r.directionality) for r in structure.skip_logic(rows, "r", ["gate"], ["a", "b"]).collect()}
    assert ("=", "No", "a", "bidirectional") in found and ("=", "Yes", "b", "bidirectional") in found


def test_high_missingness_cut(frame):
    rows = frame("a string, b string", *[("x", None if i < 4 else "y") for i in range(10)])
    out = {r.column: (r.missing_pct, r.high_missingness) for r in profile.column_stats(profile.cell_histogram(rows, "r")).collect()}
    assert out == {"a": (0.0, False), "b": (40.0, True)}


def test_worker_profiles_apply(frame, spark):
    a2 = frame("run_id string, ordinal int, column string, unique_count int, missing_pct double, high_missingness boolean, missing_tokens_observed map<string,int>, "
               "top_levels array<string>, a2_samples map<string,array<string>>, numeric_profile string",
               *[("r", i, f"Q{i}", i, 50.0, i % 2 == 0, {}, ["a", "b"], {"random": ["x" * 100, "y", "z", "w"]}, "p") for i in range(20)])
    for name in worker_views.PROFILES:
        views = worker_views.worker_view(name, {"A2": a2})
        for part, view in views.items():
            assert "numeric_profile" not in view.columns and view.count() <= 20, (name, part)
    view = worker_views.worker_view("type_transform_worker", {"A2": a2})["A2"]
    assert view.count() == 4  # one family, capped at four columns
    row = view.first()
    assert row.missing_tokens_observed is None and [len(s) for s in row.a2_samples["random"]] == [80, 1, 1]


def test_guarded_drop_needs_both_guards(frame):
    rows = frame("run_id string, row_samples struct<panels:array<struct<rows:array<struct<a:int>>,kind:string>>>, counts struct<rows:int>", ("r", ([([(1,)], "head")],), (7,)))
    out = prune.drop_guarded(rows, "rows", worker_views.ROW_HINTS, list_of_objects=True)
    row = out.first().asDict(recursive=True)
    assert row["row_samples"]["panels"] == [{"kind": "head"}] and row["counts"] == {"rows": 7}


def test_row_set_shapes(frame):
    docs = frame("run_id string, raw string", ("o", '[{"b":1,"a":"x"},{"a":null,"z":2}]'), ("t", '{"columns":["c"],"rows":[[1],[2]]}'),
                 ("h", '[["n","m"],[1,2]]'), ("g", "[[1,2]]"), ("bad", "5"))
    cells_of = {}
    for r in sheets.normalize_rows(docs).orderBy("run_id", "row_index", "column_index").collect():
        cells_of.setdefault(r.run_id, []).append((r.header, r.value))
    assert cells_of == {"o": [("b", "1"), ("a", "x"), ("z", ""), ("b", ""), ("a", None), ("z", "2")], "t": [("c", "1"), ("c", "2")],
                        "h": [("n", "1"), ("m", "2")], "g": [("Col1", "1"), ("Col2", "2")]}


def test_json_documents_must_be_one_object(frame):
    docs = frame("run_id string, raw string", ("ok", '{"a":1}'), ("tail", '{"a":1}x'), ("two", '{"a":1} {"b":2}'), ("list", "[1]"), ("blank", " "), ("none", None))
    bad = {r.run_id: r.message for r in rules.document_errors(docs, "raw", "doc").collect()}
    assert bad == {"tail": "doc is not valid JSON", "two": "doc is not valid JSON", "list": "doc root must be an object.",
                   "blank": "doc is empty.", "none": "doc must be a string."}


def test_rule_report_orders_messages(frame):
    runs = frame("run_id string", ("good",), ("bad",))
    errors = frame("run_id string, place int, message string", ("bad", 2, "second"), ("bad", 1, "first"), ("bad", 3, "second"))
    out = {r.run_id: (r.validation_ok, r.validation_error, r.n_errors) for r in rules.report(runs, errors).collect()}
    assert out == {"good": (True, "", 0), "bad": (False, "first", 2)}
