"""Whole-document validation with the messages a reviewer would see."""

import json

import pytest

from tablesight.plans.validate import WORKERS, validate


def doc(name, **over):
    note = {"summary": {"overview": "ok"}}
    base = {
        "type_transform_worker": {"worker": "type_value_specialist", **note, "column_decisions": [
            {"column": "a", "recommended_logical_type": "identifier", "recommended_storage_type": "string", "normalization_notes": "n",
             "reasoning": "r", "confidence": 0.5, "skip_logic_protected": False, "needs_human_review": False}]},
        "missingness_worker": {"worker": "missingness_structural_validity_specialist", **note, "column_decisions": [
            {"column": "a", "missingness_disposition": "no_material_missingness", "structural_validity": "not_applicable",
             "recommended_handling": "no_action_needed", "normalization_notes": "n", "reasoning": "r", "confidence": 1,
             "skip_logic_protected": False, "needs_human_review": False}], "global_contract": {"token_missing_placeholders_detected": False}},
        "table_layout_worker": {"worker": "table_layout_specialist", "summary": {"overview": "o", "recommended_model_shape": "single_base_table"},
                                "table_suggestions": [{"table_name": "t", "kind": "base_entity", "source_basis": {"kind": "primary_grain"},
                                                       "grain_columns": ["a"], "build_strategy": "direct_select", "confidence": 0.9, "reasoning": "r",
                                                       "needs_human_review": False}],
                                "column_table_assignments": [{"column": "a", "assigned_table": "t", "assignment_role": "base_key", "why": "w"}]},
        "analysis_layout_worker": {"worker": "analysis_layout_specialist", **note, "analysis_table_suggestions": [
            {"table_name": "t", "kind": "score_table", "source_canonical_tables": ["b"], "grain_columns": ["a"], "build_strategy": "pass_through",
             "value_columns": ["v"], "confidence": 0.9, "reasoning": "r", "needs_human_review": False}]},
        "family_worker": {"worker": "family_specialist", "family_id": "f", "family_result": {
            "family_id": "f", "recommended_table_name": "t", "recommended_parent_key": "id", "recommended_repeat_index_name": "row",
            "recommended_family_role": "event_sequence", "recommended_handling": "retain_as_child_table", "member_semantics_notes": "m",
            "reasoning": "r", "confidence": 0.5, "needs_human_review": False}},
        "grain_worker": {"recommended_primary_grain": {"description": "d", "grain_type": "single_column", "keys": ["a"], "confidence_score": 0.9,
                                                       "justification": "j"},
                         "review_questions": {q: {"prompt": "p", "recommended_answer": "a", "why_it_matters": "w", "answer_type": "enum"}
                                              for q in ("grain_confirmation", "family_confirmation", "index_drop_confirmation")},
                         "user_inputs_requested": {u: {"input_type": "free_text", "required": False, "purpose": "p"} for u in (
                             "global_renaming_instructions", "missed_family_information", "free_text_override_instructions")},
                         "diagnostics": {"encoding_hint": "unknown", "encoding_justification": "e", "recommended_next_action": "n",
                                         "rejected_primary_candidates": [{"keys": ["b"], "reason": "r"}]}, "reasoning": "r"},
        "scale_mapping_worker": {"worker": "scale_mapping_extractor", **note, "mappings": [
            {"target_kind": "column", "target_id": "a", "mapping_status": "unresolved", "response_scale_kind": "", "ordered_labels": [],
             "label_to_ordinal_position": {}, "label_to_numeric_score": {"x": 1}, "numeric_score_semantics_confirmed": True, "source": "",
             "notes": "", "confidence": 0.1}]},
        "semantic_context_worker": {"worker": "semantic_context_interpreter", **note, "dataset_context": {"dataset_purpose": "", "row_meaning_notes": ""},
                                    "important_variables": [{"column_or_family": "a", "kind": "other", "meaning": "m", "downstream_importance": "d", "confidence": 0.5}]},
        "canonical_contract": {"worker": "canonical_column_contract_builder", **note, "column_contracts": [
            {"column": "a", "canonical_modeling_status": "base_field", "canonical_table_name": "t", "canonical_assignment_role": "base_key",
             "recommended_logical_type": "identifier", "recommended_storage_type": "string", "missingness_disposition": "no_material_missingness",
             "missingness_handling": "no_action_needed", "skip_logic_protected": False, "confidence": 0.5, "needs_human_review": False,
             "type_decision_source": "a17_baseline", "structure_decision_source": "unresolved", "missingness_decision_source": "a17_baseline",
             "semantic_decision_source": "unknown"}]},
    }[name]
    return {**json.loads(json.dumps(base)), **over}


def run(frame, name, docs, expected=None):
    rows = frame("run_id string, raw string", *[(k, json.dumps(v) if not isinstance(v, str) else v) for k, v in docs.items()])
    wanted = None if expected is None else frame("run_id string, column string", *expected)
    out = validate(name, rows, wanted)
    errors = {}
    for e in out["errors"].collect():
        errors.setdefault(e.run_id, set()).add(e.message)
    return {r.run_id: r for r in out["report"].collect()}, errors, out


@pytest.mark.parametrize("name", sorted(WORKERS))
def test_complete_documents_pass_and_defaults_are_logged(frame, name):
    report, errors, out = run(frame, name, {"good": doc(name)})
    assert report["good"].validation_ok, errors
    logged = {r.path for r in out["defaults_log"].collect()}
    assert "assumptions" in logged


def test_type_documents(frame):
    bad = doc("type_transform_worker")
    item = bad["column_decisions"][0]
    item.update(recommended_storage_type="integer", confidence="high", transform_actions=["explode"], skip_logic_protected="no")
    del item["reasoning"]
    bad["column_decisions"].append(dict(item, column="a"))
    bad["worker"] = "someone"
    del bad["summary"]["overview"]
    report, errors, _ = run(frame, "type_transform_worker", {"bad": bad, "junk": "{", "ok": doc("type_transform_worker")},
                            [("bad", "a"), ("bad", "b"), ("ok", "a")])
    assert report["ok"].validation_ok and not report["junk"].validation_ok
    want = {
        "worker must be 'type_value_specialist'.", "summary.overview is required.",
        "column_decisions[0] has inconsistent type/storage pair: identifier must use storage type string",
        "column_decisions[0].confidence must be numeric.", "column_decisions[0].skip_logic_protected must be a boolean.",
        "column_decisions[0].reasoning is required.", "Duplicate column_decisions entry for column: a",
        "column_decisions is missing reviewed columns: b",
    }
    assert want <= errors["bad"]
    assert any(m.startswith("column_decisions[0].transform_actions[0] must be one of: cast_to_date") for m in errors["bad"])
    assert report["bad"].validation_error == "worker must be 'type_value_specialist'."


def test_skip_sentinels(frame):
    report, errors, _ = run(frame, "semantic_context_worker", {
        "ok": {"status": "skipped", "reason": "light_contract_accepted"}, "odd": {"status": "skipped", "reason": "tired"}})
    assert report["ok"].validation_ok
    assert errors["odd"] == {"reason must be one of: blank_semantic_input, light_contract_accepted"}


def test_layout_documents(frame):
    bad = doc("table_layout_worker")
    bad["table_suggestions"][0].update(kind="cube", parent_key=["", 3])
    bad["column_table_assignments"][0].update(assigned_table="nowhere")
    bad["summary"]["recommended_model_shape"] = "star"
    _, errors, _ = run(frame, "table_layout_worker", {"bad": bad, "none": doc("table_layout_worker", table_suggestions=[])})
    assert {"summary.recommended_model_shape is invalid.", "table_suggestions[0].kind is invalid.",
            "table_suggestions[0].parent_key[0] must not be blank.", "table_suggestions[0].parent_key[1] must be a string.",
            "column_table_assignments[0].assigned_table must match a table_name in table_suggestions."} <= errors["bad"]
    assert "table_suggestions must not be empty." in errors["none"]


def test_grain_documents_are_closed(frame):
    bad = doc("grain_worker", surprise=1)
    bad["recommended_primary_grain"].update(grain_type="no_clear_key", keys=[])
    del bad["diagnostics"], bad["review_questions"]["family_confirmation"]
    bad["review_questions"]["grain_confirmation"]["answer_type"] = "maybe"
    bad["user_inputs_requested"]["missed_family_information"] = {"input_type": "choice", "purpose": " "}
    odd = doc("grain_worker")
    odd["diagnostics"].update(encoding_hint="odd", rejected_primary_candidates=[{"keys": [], "reason": "r"}])
    _, errors, _ = run(frame, "grain_worker", {"bad": bad, "odd": odd})
    assert errors["odd"] == {"Invalid diagnostics.encoding_hint: odd", "diagnostics.rejected_primary_candidates[0].keys must be a non-empty array"}
    assert {"Missing required review question: review_questions.family_confirmation", "Invalid review_questions.grain_confirmation.answer_type: maybe",
            "user_inputs_requested.missed_family_information.input_type must be 'free_text'",
            "user_inputs_requested.missed_family_information.required must be a boolean",
            "user_inputs_requested.missed_family_information.purpose must be a non-empty string"} <= errors["bad"]
    assert {"Unexpected top-level key(s): surprise", "Missing required top-level key(s): diagnostics",
            "recommended_primary_grain.keys must still be non-empty for no_clear_key"} <= errors["bad"]


def test_contract_documents(frame):
    bad = doc("canonical_contract")
    bad["column_contracts"][0].update(canonical_modeling_status="odd", missingness_handling="retain_with_caution", canonical_table_name="")
    _, errors, _ = run(frame, "canonical_contract", {"bad": bad}, [("bad", "a"), ("bad", "z")])
    assert {"column_contracts[0].canonical_modeling_status is invalid",
            "column_contracts[0].canonical_table_name must be non-blank for resolved assignments",
            "column_contracts[0].missingness_handling must be one of ['no_action_needed'] when missingness_disposition is no_material_missingness",
            "column_contracts is missing A2 source columns: z"} == errors["bad"]


def test_a_document_is_parsed_once(frame):
    docs = frame("run_id string, raw string", ("a", "{\"worker\": 1}"), ("b", "no json"))
    out = validate("type_transform_worker", docs)
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in out.values()]
    assert not any("parse_json" in p.lower() or "parsejson" in p.lower() for p in plans)
    assert {r.run_id for r in out["errors"].collect()} == {"a", "b"}
