"""Patch documents against contract documents, end to end."""

import json

import pytest

from tablesight.plans.review import review_contracts


def row(column, **over):
    base = {"column": column, "canonical_modeling_status": "base_field", "canonical_table_name": "t", "canonical_assignment_role": "base_attribute",
            "source_family_id": "", "a9_primary_role": "measure", "recommended_logical_type": "numeric_measure", "recommended_storage_type": "integer",
            "transform_actions": ["trim_whitespace"], "structural_transform_hints": [], "interpretation_hints": [],
            "missingness_disposition": "no_material_missingness", "missingness_handling": "no_action_needed", "skip_logic_protected": False,
            "semantic_meaning": "", "codebook_note": "", "normalization_notes": "", "confidence": 0.5, "needs_human_review": False,
            "type_decision_source": "a17_baseline", "structure_decision_source": "table_layout_worker", "missingness_decision_source": "a17_baseline",
            "semantic_decision_source": "unknown", "applied_sources": ["A17"]}
    return {**base, **over}


def contract_doc(*rows):
    n = len(rows)
    counts = {"total_source_columns": n, "included_column_count": n, "excluded_column_count": 0, "unresolved_column_count": 0,
              "reviewed_override_count": 9, "family_default_count": 0, "deterministic_baseline_count": n, "reviewed_type_count": 0,
              "fallback_type_count": n}
    return {"worker": "canonical_column_contract_builder", "summary": {"overview": "o", **counts}, "column_contracts": list(rows)}


def change(i, column, field, value, **over):
    return {"change_id": f"c{i}", "column": column, "field": field, "after_value": value, "reasoning": "r", "justification": "j",
            "confidence": 0.9, "needs_human_review": False, **over}


def patch_doc(*changes, **over):
    return {"worker": "canonical_contract_reviewer", "review_summary": {"overview": "Looked.", "review_principles": ["p"]}, "change_set": list(changes), **over}


@pytest.fixture(scope="module")
def reviewed(spark):
    good = contract_doc(row("a"), row("b"), row("gated", missingness_disposition="structurally_valid_missingness",
                                                  missingness_handling="retain_with_caution", skip_logic_protected=True, interpretation_hints=["skip_logic_protected"]))
    cases = {
        "ok": (good, patch_doc(change(1, "a", "semantic_meaning", "Height"), change(2, "b", "canonical_modeling_status", "excluded_from_outputs"),
                               change(3, "b", "canonical_assignment_role", "exclude_from_outputs"), change(4, "b", "canonical_table_name", ""),
                               change(5, "a", "confidence", 0.5))),
        "frozen": (good, patch_doc(change(1, "a", "type_decision_source", "reviewed_type_worker"))),
        "unknown": (good, patch_doc(change(1, "zzz", "confidence", 0.7))),
        "smuggle": (good, patch_doc(change(1, "gated", "interpretation_hints", []))),
        "incoherent": (good, patch_doc(change(1, "a", "missingness_handling", "review_before_drop"))),
        "badtype": (good, patch_doc(change(1, "a", "confidence", "high"), change(2, "a", "recommended_logical_type", "odd"))),
        "dupes": (good, patch_doc(change(1, "a", "confidence", 0.7), change(1, "a", "confidence", 0.8))),
        "extra": (good, patch_doc(change(1, "a", "confidence", 0.7, target_path="/x"), surprise=1)),
        "source": (contract_doc(row("a", canonical_modeling_status="odd")), patch_doc(change(1, "a", "confidence", 0.7))),
    }
    frame = lambda i: spark.createDataFrame([(k, json.dumps(v[i])) for k, v in cases.items()], "run_id string, raw string")
    out = review_contracts(frame(0), frame(1))
    errors = {}
    for e in out["errors"].collect():
        errors.setdefault(e.run_id, set()).add(e.message)
    return out, errors


def test_rejections_name_their_reason(reviewed):
    errors = reviewed[1]
    assert "ok" not in errors
    assert "change_set[0].field points to a forbidden field: type_decision_source" in errors["frozen"]
    assert "change_set[0].column does not exist in canon_contract_json: zzz" in errors["unknown"]
    assert any("code-owned" in m for m in errors["smuggle"])
    assert ("preview_contract.column_contracts[0].missingness_handling must be one of ['no_action_needed'] when missingness_disposition "
            "is no_material_missingness.") in errors["incoherent"]
    assert {"change_set[0].after_value must be numeric.", "change_set[1].after_value is invalid."} <= errors["badtype"]
    assert {"Duplicate change_set.change_id: c1", "Duplicate change_set column/field pair: a.confidence"} <= errors["dupes"]
    assert {"change_set[0] has unexpected key(s): target_path", "Unexpected top-level key(s): surprise"} <= errors["extra"]
    assert "column_contracts[0].canonical_modeling_status is invalid" in errors["source"]


def test_only_the_clean_run_is_applied(reviewed):
    rows = reviewed[0]["contract"].collect()
    assert {r.run_id for r in rows} == {"ok"}
    by = {r.column: r for r in rows}
    assert by["a"].semantic_meaning == "Height" and by["b"].canonical_modeling_status == "excluded_from_outputs"
    assert [r.column for r in sorted(rows, key=lambda r: r.ordinal)] == ["a", "b", "gated"]


def test_noop_is_removed_and_logged(reviewed):
    assert [(r.run_id, r.path) for r in reviewed[0]["noop_log"].filter("run_id = 'ok'").collect()] == [("ok", "change_set[4]")]


def test_change_log_and_envelope(reviewed):
    doc = json.loads(reviewed[0]["envelope"].filter("run_id = 'ok'").first().canon_review_json)
    log = doc["change_log"]
    assert [e["change_id"] for e in log] == ["c1", "c2", "c3", "c4", "sys_summary_included_column_count", "sys_summary_excluded_column_count",
                                             "sys_summary_reviewed_override_count"]
    assert log[0]["target_path"] == "/reviewed_contract/column_contracts/0/semantic_meaning"
    assert log[-1]["column"] == "" and log[-1]["before_value"] == "9" and log[-1]["after_value"] == "0"  # a stale count
    assert doc["review_summary"]["change_count"] == 7 and doc["review_summary"]["changed_column_count"] == 2
    summary = doc["reviewed_contract"]["summary"]
    assert summary["review_applied"] is True and summary["excluded_column_count"] == 1
    assert summary["overview"].startswith("Post-review canonical column contract for 3 columns.")
    assert doc["review_flags"] == doc["reviewer_flags"] == []
