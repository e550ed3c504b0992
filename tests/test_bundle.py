"""Profile one messy survey, then serve every reviewer from the same bundle."""

import pytest
from pyspark.sql import functions as F

from tablesight.operators import prune
from tablesight.plans.dataset_profile import Options, profile_dataset
from tablesight.plans.worker_views import PROFILES, worker_view


@pytest.fixture(scope="module")
def bundle(spark):
    rows = []
    for i in range(60):
        gate = "Yes" if i % 3 else "No"
        answers = [None if gate == "No" else str((i * k) % 5 + 1) for k in (1, 2, 3)]
        rows.append((str(i), f"R{i:03d}", gate, *answers, f"20{10 + i % 10}-01-{i % 28 + 1:02d}", str(i % 2), f"Person {i} wrote a long comment",
                     f"{60 + i % 30}kg", "N/A" if i % 10 == 0 else f"${i},{100 + i}.50", "RW, ST" if i % 2 else "CF"))
    names = ["Unnamed: 0", "RespondentId", "Gate", "Q9 grp_Row1", "Q9 grp_Row2", "Q9 grp_Row3", "Joined", "Flag", "Comment", "Weight", "Paid", "Positions"]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    return profile_dataset(df, "survey", "made", Options(preferred_grain=["RespondentId"]))


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_grain_family_and_gate_are_found(bundle):
    best = bundle["A6.tests"].filter("grain_rank = 1").first()
    assert best.keys_tested.split(",")[0] in ("RespondentId", "Comment") and best.pivot_safety
    assert [r.family_id for r in bundle["A8.families"].collect()] == ["q_9_grp"]
    rules = bundle["A16.detected_skip_logic"].filter("trigger_column = 'Gate' and trigger_value = 'No' and trigger_test = '='").collect()
    assert {r.affected_column for r in rules} == {"Q9 grp_Row1", "Q9 grp_Row2", "Q9 grp_Row3"}
    assert {r.directionality for r in rules} == {"bidirectional"}


def test_a_table_of_family_columns_only(spark):
    rows = [(str(i % 4), str(i % 3), None if i % 5 else "x") for i in range(30)]
    out = profile_dataset(spark.createDataFrame(rows, "Q1 string, Q2 string, Q3 string"), "family")
    assert out["A6.tests"].count() == out["A5.candidate_key_stress_tests"].count() == out["A6.minimal_keys"].count() == 0
    assert out["A8.families"].count() == 1 and out["A17.columns"].count() == 3


def test_a_wide_key_with_nulls_wins(spark):
    """Among flags; one part of the key is null on some rows."""
    rows = []
    for i in range(240):
        parts = (None if i % 4 == 0 else f"s{i % 4}", f"v{i // 4 % 3}", f"w{i // 12 % 4}", f"x{i // 48}")
        rows.append((*parts, *(str((i * (k + 3)) % 7 % (2 + k % 2)) for k in range(6)), f"z{i // 4 % 3}", f"c{i // 4 % 3 % 2}"))
    names = ["site", "visit", "wave", "arm", *(f"m{chr(97 + k)}" for k in range(6)), "zip", "city"]
    out = profile_dataset(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), "visits")
    keys = {frozenset(r["keys"].split(",")) for r in out["A6.minimal_keys"].collect()}
    assert frozenset({"site", "visit", "wave", "arm"}) in keys
    tests = out["A6.tests"].collect()
    assert {frozenset(r.keys_tested.split(",")) for r in tests if r.pivot_safety} == keys
    assert next(r for r in tests if r.grain_rank == 1).pivot_safety
    found = {(r.determinant, r.dependent) for r in out["A10.functional_dependencies"].collect()}
    assert ("zip", "city") in found


def test_baseline_of_each_column(bundle):
    rows = by_column(bundle["A17.columns"])
    kind = {c: (r.recommended_logical_type, r.missingness_disposition) for c, r in rows.items()}
    assert kind["RespondentId"] == ("identifier", "no_material_missingness")
    assert kind["Comment"][0] == "free_text" and kind["Joined"][0] == "date" and kind["Weight"][0] == "numeric_measure"
    assert kind["Paid"] == ("numeric_measure", "token_missingness_present")
    assert kind["Q9 grp_Row1"][1] == "structurally_valid_missingness" and rows["Q9 grp_Row1"].skip_logic_protected
    assert "split_multiselect_tokens" in rows["Positions"].structural_transform_hints


@pytest.mark.parametrize("name", sorted(PROFILES))
def test_every_profile_serves_the_bundle(bundle, name):
    views = worker_view(name, bundle)
    assert views
    sizes = prune.accounting({k: v for k, v in views.items() if len(v.columns) > 1}).collect()
    assert all(r.n_bytes > 0 for r in sizes)
    for key, view in views.items():
        assert not {"inputs", "role_candidates", "numeric_profile"} & set(view.columns), key
    if name == "grain_worker":
        assert {r.primary_role for r in views["A9.columns"].collect()} <= {"id_key", "time_index", "repeat_index", "invariant_attr", "coded_categorical"}
        assert views["A8.families_index"].first().family_signature.member_regex == "^Q9 grp_(Row|row)[_-]?[0-9]+$"
    if name == "table_layout_worker":
        stress = [r for r in views["A5.candidate_key_stress_tests"].collect() if r.drifted_attributes]
        assert stress and all(len(r.top_drifted_attributes) <= 2 for r in stress)
        assert all(len(a.example_conflicts) == 1 and a.example_conflicts[0].low_value <= a.example_conflicts[0].high_value for r in stress for a in r.top_drifted_attributes)
        assert views["A12.layout_candidates"].filter("rank = 1").first().grain == "RespondentId"
