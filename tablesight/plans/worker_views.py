"""Which artifacts each reviewer sees, and how each is narrowed.

A profile is plain data. ``worker_view`` turns a profile and a set of artifact frames into the
pruned frames, all lazy; nothing runs until one of them is written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesight.operators import families, prune
from tablesight.operators.prune import RoleBuckets, Scope

# Keys and caps below must equal the published profiles for views to agree.
ROW_HINTS = ("row_samples.panels[].rows", "example_conflicts[].rows", "F_subset.rows")
A2_DROP = ("artifact_inputs", "profiler_samples", "numeric_profile", "datetime_profile")
A9_DROP = ("inputs", "uses", "evidence_primitives", "role_scores", "role_candidates", "role_decision", "audit",
           "evidence_used", "evidence_not_used", "features")
A8_DROP = ("inputs", "uses", "families", "near_misses", "rejected_candidates", "coverage", "debug_trace")
A10_DROP = ("inputs", "near_duplicate_candidates", "one_hot_blocks", "coded_categorical_flags",
            "audit_trail_signals", "deterministic_constraints")
SEEDS = ("review_priority_columns", "reviewer_focus_columns", "review_columns")
SKIP_LISTS = ("structural_columns", "skip_trigger_columns", "skip_affected_preview_columns")


@dataclass(frozen=True)
class View:
    """How one artifact array is narrowed. Transforms and selections run before keys are dropped."""

    drop: tuple[str, ...] = ()
    drop_rows: bool = False
    scope: Scope | None = None
    name: str = "column"
    severity: str | None = None
    roles: RoleBuckets | None = None
    compact: tuple[str, int, int] | None = None
    omit_empty: tuple[str, ...] = ()
    limit: int | None = None
    nested_limits: tuple[tuple[str, int], ...] = ()
    preview_roles: bool = False
    grounding: tuple[int, int, int] | None = None
    priority: tuple[str, ...] = ()
    layouts: tuple[int, int, int] | None = None
    signature: bool = False
    grain_topk: int | None = None


def _a2(lists, per_group, total, items, true=("high_missingness",)) -> View:
    return View(drop=A2_DROP, scope=Scope(lists=lists, true=true, nonempty=("missing_tokens_observed",),
                                          per_group=per_group, total=total),
                compact=("a2_samples", items, 80), omit_empty=("missing_tokens_observed",))


def _reviewed(total, severity, **kw) -> View:
    return View(drop=("inputs",), severity=severity, scope=Scope(
        lists=SKIP_LISTS, seeds=SEEDS, seeds_per_group=6, standalone_per_group=4, sample_extremes=True, total=total, **kw))


def _grounded(levels, preview, shown, priority) -> View:
    return View(drop=A2_DROP, grounding=(levels, preview, shown), priority=priority)


def _skip(rules: int | None, switches: int | None) -> dict[str, View]:
    drop = ("inputs", "target_columns_scanned", "trigger_columns_scanned")
    return {"A16.detected_skip_logic": View(drop=drop, limit=rules),
            "A16.master_switch_candidates": View(drop=drop, limit=switches)}


FORCE, REVIEW, STRUCT = "force_include_columns", "review_columns", "structural_columns"
TRIGGER, AFFECTED, FAMILY_IDS = "skip_trigger_columns", "skip_affected_preview_columns", "force_include_family_ids"
_QUALITY = {"global_quality_score": 0.85}
_KEY_ROLES = {"id_key": 20, "time_index": 20, "repeat_index": 20}

PROFILES: dict[str, dict[str, View]] = {
    "grain_worker": {
        "A5.single_column_key_seed_candidates": View(
            drop=("inputs", "uses", "candidate_key_stress_tests", "handoff_to_A6", "invariant_candidates_checked", "not_final_key"),
            drop_rows=True, limit=12),
        "A6.tests": View(drop=("inputs", "uses", "runner_ups", "non_key_conflict_summary", "base_key", "added_qualifiers"),
                         drop_rows=True, grain_topk=15),
        "A7.key_collisions": View(drop=("inputs", "uses", "exact_duplicate_clusters", "actions", "grain_context_ref", "grain_ref"),
                                  drop_rows=True),
        "A8.families_index": View(drop=("inputs", "uses", "families", "near_misses"), drop_rows=True, limit=30, signature=True,
                                  name="family_id"),
        "A8.rejected_candidates": View(drop=("inputs", "uses"), drop_rows=True, limit=50),
        "A9.columns": View(drop=tuple(k for k in A9_DROP if k != "role_decision"), drop_rows=True, roles=RoleBuckets(
            all_of={"id_key": 50}, top={"time_index": 10, "repeat_index": 10, "invariant_attr": 25, "coded_categorical": 25},
            review_top=25, exclude=("measure", "measure_numeric", "measure_item"), total=120, overflow_role="id_key")),
        "A10.dependency_candidates": View(drop=("inputs", "uses"), drop_rows=True),
    },
    "type_transform_worker": {
        "A2": _a2((FORCE, REVIEW, STRUCT), 4, 100, 3, true=("is_one_hot_like", "high_missingness")),
        "A3-T.items": View(drop=("inputs",), limit=60, compact=("evidence_snippets", 2, 120)),
        "A3-V.items": View(drop=("inputs",), limit=60),
        "A4.per_column": View(drop=("inputs", "global_tokens", "token_classification"), omit_empty=("token_breakdown",),
                              scope=Scope(lists=(FORCE, REVIEW), at_least={"missing_pct": 40}, per_group=8, total=80)),
        "A9.columns": View(drop=A9_DROP, drop_rows=True, preview_roles=True, roles=RoleBuckets(
            all_of={**_KEY_ROLES, "invariant_attr": 12}, review_top=40, total=60)),
        "A13.columns": View(drop=("inputs",), scope=Scope(lists=(FORCE, REVIEW), nonempty=("detected_anchors",), total=30)),
        "A14.columns": View(drop=("inputs", "segments"), scope=Scope(
            lists=(FORCE, REVIEW), true=("drift_detected",), at_most=_QUALITY, total=80)),
        **_skip(None, None),
    },
    "missingness_worker": {
        "A2": _a2((FORCE, REVIEW, STRUCT, TRIGGER, AFFECTED), 8, 120, 2),
        "A4.per_column": View(drop=("inputs", "global_tokens", "token_classification"), omit_empty=("token_breakdown",),
                              scope=Scope(lists=(FORCE, REVIEW, STRUCT, TRIGGER, AFFECTED), at_least={"missing_pct": 20},
                                          nonempty=("token_breakdown",), per_group=12, total=140)),
        "A13.columns": View(drop=("inputs",), scope=Scope(lists=(FORCE, REVIEW, TRIGGER, AFFECTED),
                                                          nonempty=("detected_anchors",), total=40)),
        "A14.columns": View(drop=("inputs", "segments"), scope=Scope(
            lists=(FORCE, REVIEW, TRIGGER, AFFECTED), true=("drift_detected",), at_most=_QUALITY, total=100)),
        **_skip(50, 15),
    },
    "semantic_context_worker": {
        "A2": _grounded(12, 150, 6, (FORCE, REVIEW, STRUCT, TRIGGER)),
        "A8.families_index": View(drop=A8_DROP, drop_rows=True, limit=60, signature=True, name="family_id"),
        "A9.columns": View(drop=A9_DROP, drop_rows=True, preview_roles=True, roles=RoleBuckets(
            all_of={**_KEY_ROLES, "invariant_attr": 20}, review_top=40, total=80)),
        **_skip(40, 12),
    },
    "scale_mapping_worker": {"A2": _grounded(16, 120, 8, (FORCE,))},
    "family_worker": {
        "A8.families_index": View(drop=A8_DROP, drop_rows=True, signature=True, name="family_id",
                                  scope=Scope(lists=(FAMILY_IDS,), total=40)),
        "B1": View(drop=("inputs", "B_subset", "F_subset"), drop_rows=True, name="family_id",
                   scope=Scope(lists=(FAMILY_IDS,), total=40)),
    },
    "table_layout_worker": {
        "A2": _grounded(12, 20, 4, (FORCE, TRIGGER)),
        "A5.single_column_key_seed_candidates": View(drop=("inputs", "pair_key_seed_candidates", "audit_trace"), limit=8),
        "A5.candidate_key_stress_tests": View(
            drop=("inputs", "candidate_key_overlap_groups"), drop_rows=True, limit=8,
            nested_limits=(("top_drifted_attributes", 2), ("top_drifted_attributes[].example_conflicts", 1))),
        "A9.columns": View(drop=A9_DROP, drop_rows=True, preview_roles=True, roles=RoleBuckets(
            all_of={"id_key": 12, "time_index": 8, "repeat_index": 8, "invariant_attr": 12, "coded_categorical": 10,
                    "measure": 8, "measure_numeric": 6, "measure_item": 6}, review_top=16, total=64)),
        "A10.dependency_candidates": View(drop=A10_DROP, limit=20),
        "A10.time_column_candidates": View(drop=A10_DROP, limit=10),
        "A10.family_screening_correlations": View(drop=A10_DROP, limit=10),
        "A12.layout_candidates": View(drop=("inputs", "evidence_primitives", "debug"), layouts=(2, 12, 8)),
        "A14.columns": View(drop=("inputs", "segments"), scope=Scope(
            lists=(FORCE, REVIEW, STRUCT), true=("drift_detected",), at_most=_QUALITY, total=60)),
    },
    "analysis_layout_worker": {
        "A2": _a2((FORCE, REVIEW, STRUCT, TRIGGER), 8, 140, 2),
        "A8.families_index": View(drop=A8_DROP, drop_rows=True, signature=True, name="family_id",
                                  scope=Scope(lists=(FAMILY_IDS,), total=60)),
        "A10.dependency_candidates": View(drop=A10_DROP, limit=20),
        "A10.time_column_candidates": View(drop=A10_DROP, limit=10),
        "A10.family_screening_correlations": View(drop=A10_DROP, limit=12),
        "A14.columns": View(drop=("inputs", "segments"), scope=Scope(
            lists=(FORCE, REVIEW, STRUCT), true=("drift_detected",), at_most=_QUALITY, total=100)),
        **_skip(40, 12),
        "B1": View(drop=("inputs", "B_subset", "F_subset"), drop_rows=True, name="family_id",
                   scope=Scope(lists=(FAMILY_IDS,), total=60)),
    },
    "canonical_contract_reviewer": {
        "A2": View(drop=A2_DROP, compact=("a2_samples", 2, 80), omit_empty=("missing_tokens_observed",), severity="missing_pct",
                   scope=Scope(lists=SKIP_LISTS, seeds=SEEDS, true=("high_missingness",), nonempty=("missing_tokens_observed",),
                               seeds_per_group=6, standalone_per_group=4, sample_extremes=True, total=120)),
        "A3-T.items": View(drop=("inputs",), limit=80, compact=("evidence_snippets", 2, 120)),
        "A3-V.items": View(drop=("inputs",), limit=80),
        "A4.per_column": View(drop=("inputs", "global_tokens", "token_classification"), omit_empty=("token_breakdown",),
                              severity="missing_pct", scope=Scope(
            lists=SKIP_LISTS, seeds=SEEDS, at_least={"missing_pct": 20}, nonempty=("token_breakdown",),
            seeds_per_group=6, standalone_per_group=4, sample_extremes=True, total=120)),
        "A9.columns": View(drop=A9_DROP, drop_rows=True, preview_roles=True, roles=RoleBuckets(
            all_of={**_KEY_ROLES, "invariant_attr": 20, "coded_categorical": 16, "measure": 16, "measure_item": 16},
            review_top=40, per_group=6, total=100)),
        "A13.columns": View(drop=("inputs",), scope=Scope(nonempty=("detected_anchors",), total=40)),
        "A14.columns": _reviewed(96, "global_quality_score", true=("drift_detected",), at_most={"global_quality_score": 0.7}),
        **_skip(50, 15),
        "A17.columns": _reviewed(120, "quality_score", true=("skip_logic_protected", "drift_detected"),
                                 at_most={"confidence": 0.65, "quality_score": 0.7}),
    },
}


def _only_present(spec: Scope, df: DataFrame) -> Scope:
    """The part of a scope whose fields the artifact frame carries."""
    have = set(df.columns)
    keep = lambda names: tuple(n for n in names if n in have)
    return Scope(**{**spec.__dict__, "true": keep(spec.true), "nonempty": keep(spec.nonempty),
                    "at_least": {k: v for k, v in spec.at_least.items() if k in have},
                    "at_most": {k: v for k, v in spec.at_most.items() if k in have}})


#: Fields that rank an artifact's rows, best first, and those whose larger absolute value comes first.
RANKS = ("seed_rank", "time_rank", "grain_rank", "rank")
STRENGTHS = ("strength", "correlation", "score", "drift_pct", "missing_explained_pct", "governed_columns", "held_share")


def in_order(df: DataFrame) -> DataFrame:
    """``df`` with ``ordinal``, its place in its run by rank, strength and then every plain field.

    Artifact frames have a row per column or per pair of columns, so a run is never longer than that.
    """
    kinds = dict(df.dtypes)
    plain = [c for c in df.columns if c != "run_id" and not kinds[c].startswith(("array", "map", "struct"))]
    order = [F.col(c) for c in RANKS if c in kinds] + [F.abs(F.col(c)).desc_nulls_last() for c in STRENGTHS if c in kinds]
    order += [F.col(f"`{c}`") for c in plain] + [F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))]
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)) - 1)


def scope_buckets(artifacts: dict[str, DataFrame], best_grain: DataFrame | None) -> DataFrame | None:
    """The scope lists that the artifacts themselves give, or None where the evidence for them is not there."""
    sources = ("A3-T.items", "A3-V.items", "A9.columns", "A16.detected_skip_logic", "A17.columns")
    if any(s not in artifacts for s in sources):
        return None
    parts = [prune.auto_scope(*[artifacts[s] for s in sources[:4]], prune.reviewer_focus(artifacts["A17.columns"]))]
    zero = F.lit(0).cast("long").alias("rank")
    if best_grain is not None:
        a17 = artifacts["A17.columns"]
        none = best_grain.where("false")
        forced = prune.force_include(best_grain, none, none.select("run_id", F.lit("").alias("parent_key")), a17)
        parts.append(forced.select("run_id", F.lit(FORCE).alias("bucket"), F.col("column").alias("name"), zero))
    if "A8.families" in artifacts:
        parts.append(artifacts["A8.families"].select("run_id", F.lit(FAMILY_IDS).alias("bucket"), F.col("family_id").alias("name"), zero))
    return reduce(DataFrame.unionByName, parts)


def apply_view(df: DataFrame, view: View, buckets: DataFrame | None = None, found: DataFrame | None = None,
               preferred: DataFrame | None = None, best_grain: DataFrame | None = None) -> dict[str, DataFrame]:
    """One artifact through its view; a grounding view yields two frames, any other yields one."""
    out = df if "ordinal" in df.columns else in_order(df)
    if view.compact and view.compact[0] in out.columns:
        out = prune.compact_keyed_arrays(out, *view.compact)
    if view.preview_roles and "role_candidates" in out.columns:
        out = prune.role_preview(out)
    if view.signature and found is not None:
        out = families.with_signature(out, found)
    if view.grounding is not None:
        wanted = buckets.filter(F.col("bucket").isin(*view.priority)) if buckets is not None else None
        return prune.a2_grounding(out, *view.grounding, priority=wanted)
    if view.layouts is not None and preferred is not None:
        out = prune.a12_grounding(out, preferred, *view.layouts)
    if view.grain_topk is not None and best_grain is not None:
        out = prune.best_safe_topk(out, best_grain, view.grain_topk)
    if view.scope is not None:
        out = prune.scope_select(out, _only_present(view.scope, out), buckets, view.name, severity=view.severity)
    if view.roles is not None:
        out = prune.role_buckets(out, view.roles)
    if view.omit_empty:
        out = prune.drop_when_empty(out, [c for c in view.omit_empty if c in out.columns])
    if view.limit is not None:
        out = prune.first_k(out, view.limit)
    for path, k in view.nested_limits:
        if path.split("[].")[0] in out.columns:
            out = prune.slice_nested(out, path, k)
    out = prune.drop_keys(out, view.drop)
    if view.drop_rows:
        out = prune.drop_guarded(out, "rows", ROW_HINTS, list_of_objects=True)
    return {"": out if "ordinal" in df.columns else out.drop("ordinal")}


def worker_view(profile: str, artifacts: dict[str, DataFrame], buckets: DataFrame | None = None,
                found: DataFrame | None = None, preferred: DataFrame | None = None,
                best_grain: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every artifact of a profile that is present, pruned. Stored artifacts are not changed.

    What is not given is read off the artifacts: the best grain from A6, the
    preferred one from A12 or else the best, the families from A8, the scope buckets from A3, A9, A16, A17 and both of these.
    """
    if best_grain is None and "A6.tests" in artifacts:
        best_grain = artifacts["A6.tests"].where("grain_rank = 1").select("run_id", F.split("keys_tested", ",").alias("keys"))
    if preferred is None and best_grain is not None:
        preferred = best_grain
        if "A12.layout_candidates" in artifacts:
            chosen = artifacts["A12.layout_candidates"].where("preferred_grain_match").select("run_id", F.col("grain_keys").alias("keys"))
            preferred = chosen.unionByName(best_grain.join(chosen, "run_id", "left_anti"))
    found = artifacts.get("A8.families") if found is None else found
    buckets = scope_buckets(artifacts, best_grain) if buckets is None else buckets
    out: dict[str, DataFrame] = {}
    for artifact, view in PROFILES[profile].items():
        if artifact in artifacts:
            for part, frame in apply_view(artifacts[artifact], view, buckets, found, preferred, best_grain).items():
                out[f"{artifact}.{part}".rstrip(".")] = frame
    return out
