"""Contract synthesis on a ten-column survey with known outcomes."""

import pytest
from pyspark.sql import functions as F

from tablesight.operators import contract, families, structure

RUN = "r"
COLUMNS = ["Unnamed: 0", "RespondentId", "StatusCode", "Q12", "Q13_Reason", "FreeTextComment", "Q1FreeText",
           "Q6Main_cell_groupRow1", "Q18Main_cell_groupRow1", "Q18Main_cell_groupRow2"]
FAMILY = {"Q6Main_cell_groupRow1": "q_6_main_cell_group", "Q18Main_cell_groupRow1": "q_18_main_cell_group",
          "Q18Main_cell_groupRow2": "q_18_main_cell_group"}


@pytest.fixture(scope="module")
def rows(spark):
    return lambda schema, *data: spark.createDataFrame(list(data), schema)


@pytest.fixture(scope="module")
def baseline(rows):
    kinds = {"Unnamed: 0": "numeric", "RespondentId": "numeric", "StatusCode": "numeric", "Q12": "categorical", "Q13_Reason": "text",
             "FreeTextComment": "text", "Q1FreeText": "numeric", "Q6Main_cell_groupRow1": "categorical",
             "Q18Main_cell_groupRow1": "numeric", "Q18Main_cell_groupRow2": "numeric"}
    pct = {"Q13_Reason": 70.0, "Q18Main_cell_groupRow1": 52.0, "Q18Main_cell_groupRow2": 55.0}
    prose = {"FreeTextComment": 1.0, "Q1FreeText": 1.0, "Q13_Reason": 1.0}
    role = {"RespondentId": "id_key", "StatusCode": "coded_categorical", "Q1FreeText": "measure", **dict.fromkeys(FAMILY, "measure_item")}
    a2 = rows("run_id string, column string, top_candidate struct<type:string,confidence:double>, confidence double, missing_pct double, "
              "integral_share double, time_of_day_share double, prose_share double",
              *[(RUN, c, (kinds[c], 0.9), 0.9, pct.get(c, 0.0), 1.0, 0.0, prose.get(c, 0.0)) for c in COLUMNS])
    key = "run_id string, column string, "
    return structure.baseline_resolution(
        a2, rows(key + "primary_role string, review_required boolean", *[(RUN, c, role.get(c, "invariant_attr"), False) for c in COLUMNS[1:]]),
        rows(key + "missing_pct double, token_na_count bigint", *[(RUN, c, p, 0) for c, p in pct.items()]),
        rows(key + "detected_anchors array<struct<anchor:string>>", (RUN, "FreeTextComment", [("EMAIL",)])),
        rows(key + "global_quality_score double", *[(RUN, c, 0.9) for c in COLUMNS[1:]]),
        rows(key + "drift_detected boolean", *[(RUN, c, False) for c in COLUMNS[1:]]),
        rows("run_id string, affected_column string, missing_explained_pct double, directionality string",
             (RUN, "Q18Main_cell_groupRow1", 97.0, "forward"), (RUN, "Q18Main_cell_groupRow2", 97.0, "forward")),
        rows(key + "reason string"), rows(key + "best_type string"))


TYPE = ("run_id string, column string, recommended_logical_type string, recommended_storage_type string, transform_actions array<string>, "
        "structural_transform_hints array<string>, interpretation_hints array<string>, normalization_notes string, confidence double, needs_human_review boolean")
DEFAULTS = ("run_id string, family_id string, recommended_logical_type string, recommended_storage_type string, transform_actions array<string>, "
            "structural_transform_hints array<string>, interpretation_hints array<string>, missingness_disposition string, missingness_handling string, "
            "skip_logic_protected boolean, confidence double, needs_human_review boolean")


def build(rows, baseline, disposition="structurally_valid_missingness", handling="protect_from_null_penalty", skip=True, semantics=True, scales=None):
    q6, q18 = "q_6_main_cell_group", "q_18_main_cell_group"
    table = {q6: "q6_rows", q18: "q18_rows"}
    a2 = rows("run_id string, column string, ordinal int", *[(RUN, c, i) for i, c in enumerate(COLUMNS)])
    layout = []
    for c in COLUMNS:
        if c == "Unnamed: 0":
            layout.append((RUN, c, "", "exclude_from_outputs", ""))
        elif c in FAMILY:
            layout.append((RUN, c, table[FAMILY[c]], "melt_member", FAMILY[c]))
        else:
            layout.append((RUN, c, "base_respondents", "base_key" if c == "RespondentId" else "base_attribute", ""))
    clean = ["trim_whitespace"]
    typed = [
        (RUN, "RespondentId", "identifier", "string", clean, [], ["identifier_not_measure"], "Keep as text.", 0.98, False),
        (RUN, "Q6Main_cell_groupRow1", "ordinal_category", "string", clean, ["requires_child_table_review"], [], "Ordinal.", 0.9, False),
        (RUN, "Q18Main_cell_groupRow1", "ordinal_category", "string", clean, [], ["skip_logic_protected"], "Gated.", 0.91, False),
        (RUN, "GhostCol", "mixed_or_ambiguous", "string", [], [], ["mixed_content_high_risk"], "", 0.7, True),
    ]
    gaps = [(RUN, "Q13_Reason", "structurally_valid_missingness", "protect_from_null_penalty", False, False),
            (RUN, "Q18Main_cell_groupRow1", "structurally_valid_missingness", "protect_from_null_penalty", True, False)]
    out = contract.synthesize(
        a2, baseline,
        layout=rows("run_id string, column string, assigned_table string, assignment_role string, source_family_id string", *layout),
        tables=rows("run_id string, table_name string, kind string", (RUN, "base_respondents", "base_entity"), (RUN, "q6_rows", "child_repeat")),
        members=rows("run_id string, column string, family_id string", *[(RUN, c, f) for c, f in FAMILY.items()]),
        family_defaults=rows(DEFAULTS, (RUN, q18, "ordinal_category", "string", clean, [], ["skip_logic_protected"], disposition, handling, skip, 0.88, False)),
        type_decisions=rows(TYPE, *typed),
        missingness_decisions=rows("run_id string, column string, missingness_disposition string, recommended_handling string, "
                                   "skip_logic_protected boolean, needs_human_review boolean", *gaps),
        token_flags=rows("run_id string, token_missing_placeholders_detected boolean", (RUN, False)),
        variables=rows("run_id string, column string, meaning string", *([(RUN, "Q12", "Gate.")] if semantics else [])),
        codebook=rows("run_id string, column string, codes_or_labels_note string, meaning string",
                      *([(RUN, "StatusCode", "1 = active, 2 = paused", "Status.")] if semantics else [])),
        scales=scales)
    return out, {r["column"]: r for r in out.collect()}


@pytest.fixture(scope="module")
def built(rows, baseline):
    return build(rows, baseline)


def test_reviewed_type_wins(built):
    row = built[1]["RespondentId"]
    assert (row.type_decision_source, row.recommended_logical_type) == ("reviewed_type_worker", "identifier")
    assert "type_transform_worker" in row.applied_sources


def test_code_role_and_codebook_note(built):
    row = built[1]["StatusCode"]
    assert row.recommended_logical_type == "categorical_code"
    assert (row.semantic_decision_source, row.codebook_note) == ("semantic_context_worker", "1 = active, 2 = paused")


def test_export_index_is_excluded(built):
    row = built[1]["Unnamed: 0"]
    assert (row.canonical_modeling_status, row.canonical_table_name) == ("excluded_from_outputs", "")


def test_child_placement_strips_planning_hints(built):
    row = built[1]["Q6Main_cell_groupRow1"]
    assert row.canonical_modeling_status == "child_repeat_member"
    assert "requires_child_table_review" not in row.structural_transform_hints


def test_protection_forces_flag_and_hint(built):
    row = built[1]["Q13_Reason"]
    assert row.skip_logic_protected is True and "skip_logic_protected" in row.interpretation_hints
    assert row.missingness_decision_source == "reviewed_missingness_worker" and "missingness_worker" in row.applied_sources


def test_baseline_rows(built):
    comment, prose = built[1]["FreeTextComment"], built[1]["Q1FreeText"]
    assert comment.type_decision_source == "a17_baseline" and "A17" in comment.applied_sources
    assert (comment.semantic_meaning, comment.semantic_decision_source) == ("", "unknown")
    assert (prose.recommended_logical_type, prose.recommended_storage_type) == ("free_text", "string")


def test_family_default_reaches_only_the_unreviewed_sibling(built):
    first, second = built[1]["Q18Main_cell_groupRow1"], built[1]["Q18Main_cell_groupRow2"]
    assert first.type_decision_source == "reviewed_type_worker" and first.missingness_decision_source == "reviewed_missingness_worker"
    assert second.type_decision_source == second.missingness_decision_source == "family_default"
    assert second.recommended_logical_type == "ordinal_category" and second.skip_logic_protected is True
    assert "family_worker.member_defaults" in second.applied_sources


def test_ghost_column_is_kept_and_flagged(built):
    frame, found = built
    ghost = found["GhostCol"]
    assert (ghost.canonical_modeling_status, ghost.missingness_decision_source) == ("unresolved", "unresolved_no_a2_evidence")
    flags = {(r.item, r.issue) for r in contract.review_flags(frame).collect()}
    assert ("GhostCol", "reviewed_column_not_in_a2") in flags
    assert "high_deterministic_baseline_share" in {i for _, i in flags}


def test_summary_counts(built):
    row = contract.summary_counts(built[0]).first()
    assert (row.reviewed_override_count, row.family_default_count, row.deterministic_baseline_count) == (5, 1, 5)
    assert (row.total_source_columns, row.excluded_column_count, row.unresolved_column_count) == (11, 1, 1)


def test_synthesised_rows_break_no_invariant(built):
    errors = built[0].select(F.explode(contract.row_invariant_errors(F.lit("row"), F.lit(False))))
    assert errors.count() == 0


def test_non_structural_family_default_does_not_leak(rows, baseline):
    found = build(rows, baseline, "token_missingness_present", "retain_with_caution", False)[1]
    row = found["Q18Main_cell_groupRow2"]
    assert row.missingness_decision_source != "family_default" and row.missingness_disposition != "token_missingness_present"


def test_skipped_semantics_leave_blanks(rows, baseline):
    row = build(rows, baseline, semantics=False)[1]["FreeTextComment"]
    assert (row.semantic_meaning, row.codebook_note, row.semantic_decision_source) == ("", "", "unknown")
    skipped = rows("run_id string, reason string", (RUN, "light_contract_accepted"))
    assert [r.assumption for r in contract.assumptions(skipped).collect()] == ["semantic_context_skipped"]


def test_confirmed_scale_refines_baseline_rows(rows, baseline):
    schema = "run_id string, target_kind string, target_id string, mapping_status string, response_scale_kind string, ordered_labels array<string>"
    scales = rows(schema, (RUN, "column", "StatusCode", "human_confirmed", "ladder", ["1", "2"]),
                  (RUN, "column", "Q12", "deterministic_inferred", "ladder", ["No", "Yes"]))
    found = build(rows, baseline, scales=scales)[1]
    code = found["StatusCode"]
    assert (code.recommended_logical_type, code.recommended_storage_type, code.type_decision_source) == (
        "ordinal_category", "string", "scale_mapping_resolver")
    assert "Confirmed scale mapping" in code.codebook_note and "Ordered labels: 1 | 2." in code.codebook_note
    assert found["Q12"].type_decision_source == "a17_baseline"


@pytest.mark.parametrize("change, message", [
    ({"skip_logic_protected": "false"}, "skip_logic_protected must be true when missingness_handling is protect_from_null_penalty"),
    ({"missingness_disposition": "'no_material_missingness'"},
     "missingness_handling must be one of ['no_action_needed'] when missingness_disposition is no_material_missingness"),
    ({"missingness_decision_source": "'family_default'", "missingness_disposition": "'token_missingness_present'"},
     "missingness_decision_source may not be family_default for non-structural missingness_disposition token_missingness_present"),
])
def test_invalid_rows_are_reported(built, change, message):
    row = built[0].filter("column = 'Q13_Reason'").withColumns({k: F.expr(v) for k, v in change.items()})
    assert any(message in r[0] for r in row.select(F.explode(contract.row_invariant_errors(F.lit("row")))).collect())


def test_family_ids_from_names(rows):
    names = ["A1_Q1", "A1_Q2", "A2_Q1", "A2_Q2", "M1_Q1", "M1_Q2", "Q1", "Q2", "Q9Main_cell_groupRow1", "Q9Main_cell_groupRow2", "↓OVA", "W/F", "Unnamed: 0"]
    catalog = rows("run_id string, ordinal int, column string", *[(RUN, i, n) for i, n in enumerate(names)])
    found = families.families(catalog)
    assert {r.family_id for r in found.collect()} == {"a_1", "a_2", "m_1", "q", "q_9_main_cell_group"}
    signed = families.with_signature(families.families_index(found), found)
    hits = {(r.column, r.family_id) for r in families.members_by_signature(catalog, signed).collect()}
    assert ("Q9Main_cell_groupRow2", "q_9_main_cell_group") in hits and ("A1_Q2", "a_1") in hits and not any(c == "W/F" for c, _ in hits)
