"""Resolving reviewed decisions into one contract row per column, over many runs at once.

Frames are keyed by (run_id, column). Family-level inputs are first brought to column grain on a
narrow frame, so the wide frame is only ever joined on that one key and keeps its partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesight import vocab

KEY = ["run_id", "column"]
_NO_TEXT = "array<string>"
MISSINGNESS = ("missingness_disposition", "missingness_handling", "missingness_decision_source", "skip_logic_protected")


def _empty() -> Column:
    return F.array().cast(_NO_TEXT)


def _py_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"


# ---------------------------------------------------------------- invariants


def row_invariant_errors(prefix: Column, token_flag: Column | None = None, end: str = "") -> Column:
    """Messages for every rule a contract row breaks, in rule order."""
    disposition, handling = F.col("missingness_disposition"), F.col("missingness_handling")
    protected = F.coalesce(F.col("skip_logic_protected"), F.lit(False))
    structural = F.coalesce(disposition.isin(*vocab.STRUCTURAL_DISPOSITIONS), F.lit(False))
    shown = F.coalesce(disposition, F.lit("None"))
    hints = F.transform(
        F.filter(F.coalesce("structural_transform_hints", _empty()), lambda h: h.isin(*vocab.CHILD_FORBIDDEN_HINTS)),
        lambda h: F.concat(prefix, F.lit(".structural_transform_hints must not contain "), h,
                           F.lit(f" when canonical_modeling_status is child_repeat_member{end}")))
    child = F.coalesce(F.col("canonical_modeling_status") == "child_repeat_member", F.lit(False))
    bad_pair, allowed_text = F.lit(False), F.lit("")
    for d, allowed in vocab.HANDLING_FOR_DISPOSITION.items():
        bad_pair = F.when(disposition == d, ~F.coalesce(handling.isin(*allowed), F.lit(False))).otherwise(bad_pair)
        allowed_text = F.when(disposition == d, _py_list(allowed)).otherwise(allowed_text)
    rules = [
        F.when(bad_pair, F.concat(prefix, F.lit(".missingness_handling must be one of "), allowed_text,
                                  F.lit(" when missingness_disposition is "), shown, F.lit(end))),
        F.when((handling == "protect_from_null_penalty") & ~protected, F.concat(
            prefix, F.lit(f".skip_logic_protected must be true when missingness_handling is protect_from_null_penalty{end}"))),
        F.when(protected & ~structural, F.concat(
            prefix, F.lit(".skip_logic_protected can only be true for structurally_valid_missingness or "
                          f"partially_structural_missingness{end}"))),
    ]
    if token_flag is not None:
        rules.append(F.when((~token_flag) & (disposition == "token_missingness_present"), F.concat(
            prefix, F.lit(".missingness_disposition must not be token_missingness_present when "
                          f"global_contract.token_missing_placeholders_detected is false{end}"))))
    rules.append(F.when((F.col("missingness_decision_source") == "family_default") & ~structural, F.concat(
        prefix, F.lit(".missingness_decision_source may not be family_default for non-structural missingness_disposition "),
        shown, F.lit(end))))
    return F.concat(F.when(child, hints).otherwise(_empty()), F.array_compact(F.array(*rules)))


def normalize_missingness(df: DataFrame, base: str = "base", flag: str = "token_flag") -> DataFrame:
    """Reconcile the missingness fields of each row; adds ``normalization_notes_list``.

    ``base`` is a nullable struct of the baseline's fields. Steps run in order and each one reads
    what the step before it left behind.
    """
    d, h, s, k = (F.col(c) for c in MISSINGNESS)
    has_base = F.col(base).isNotNull()

    def revert(frame: DataFrame, mark: str, cond: Column) -> DataFrame:
        frame = frame.withColumn(mark, F.coalesce(cond, F.lit(False)))
        return frame.withColumns({c: F.when(F.col(mark), F.col(f"{base}.{c}")).otherwise(F.col(c)) for c in MISSINGNESS})

    structural = F.coalesce(d.isin(*vocab.STRUCTURAL_DISPOSITIONS), F.lit(False))
    out = revert(df, "note_1", (s == "family_default") & ~structural & has_base)
    out = revert(out, "note_2", (s == "family_default") & ~F.col(flag) & (d == "token_missingness_present") & has_base
                 & ~F.coalesce(F.col(f"{base}.missingness_disposition") == "token_missingness_present", F.lit(False)))
    nothing_missing = F.coalesce(d == "no_material_missingness", F.lit(False))
    out = out.withColumn("note_3", nothing_missing & ~F.coalesce(h == "no_action_needed", F.lit(False)))
    out = out.withColumn("missingness_handling", F.when(F.col("note_3"), "no_action_needed").otherwise(h))
    out = out.withColumn("note_4", nothing_missing & ~F.coalesce(~k, F.lit(False)))
    out = out.withColumn("skip_logic_protected", F.when(F.col("note_4"), False).otherwise(k))
    out = out.withColumn("note_5", F.coalesce(h == "protect_from_null_penalty", F.lit(False)) & ~F.coalesce(k, F.lit(False)))
    out = out.withColumn("skip_logic_protected", F.when(F.col("note_5"), True).otherwise(k))
    names = ("reverted_invalid_family_default_missingness", "reverted_token_missingness_without_global_support",
             "coerced_missingness_handling_to_single_allowed_value", "cleared_skip_logic_for_no_material_missingness",
             "forced_skip_logic_for_protect_from_null_penalty")
    notes = F.array_compact(F.array(*[F.when(F.col(f"note_{i}"), n) for i, n in enumerate(names, 1)]))
    return out.withColumn("normalization_notes_list", notes).drop(*[f"note_{i}" for i in range(1, 6)])


# ---------------------------------------------------------------- synthesis


def _packed(df: DataFrame | None, like: DataFrame, keys: list[str], name: str) -> DataFrame | None:
    if df is None:
        return None
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.struct(*rest).alias(name)) if rest else df.select(*keys, F.struct(F.lit(1).alias("here")).alias(name))


def synthesize(a2: DataFrame, a17: DataFrame, *, layout: DataFrame, tables: DataFrame | None = None,
               members: DataFrame | None = None, family_decisions: DataFrame | None = None,
               family_results: DataFrame | None = None, family_defaults: DataFrame | None = None,
               grain_keys: DataFrame | None = None, type_decisions: DataFrame | None = None,
               missingness_decisions: DataFrame | None = None, token_flags: DataFrame | None = None,
               variables: DataFrame | None = None, codebook: DataFrame | None = None,
               scales: DataFrame | None = None) -> DataFrame:
    """One contract row per A2 column, plus unresolved rows for reviewed columns A2 does not know."""
    spark = a2.sparkSession

    rid = a2.schema["run_id"].dataType.simpleString()

    def none(schema: str) -> DataFrame:
        return spark.createDataFrame([], schema.replace("run_id string", f"run_id {rid}"))

    type_decisions = type_decisions if type_decisions is not None else none(
        "run_id string, column string, recommended_logical_type string, recommended_storage_type string, "
        "transform_actions array<string>, structural_transform_hints array<string>, interpretation_hints array<string>, "
        "normalization_notes string, confidence double, needs_human_review boolean")
    missingness_decisions = missingness_decisions if missingness_decisions is not None else none(
        "run_id string, column string, missingness_disposition string, recommended_handling string, "
        "skip_logic_protected boolean, needs_human_review boolean")
    members = members if members is not None else none("run_id string, column string, family_id string")
    defaults_schema = ("run_id string, family_id string, recommended_logical_type string, recommended_storage_type string, "
                       "transform_actions array<string>, structural_transform_hints array<string>, "
                       "interpretation_hints array<string>, missingness_disposition string, missingness_handling string, "
                       "skip_logic_protected boolean, confidence double, needs_human_review boolean")
    family_defaults = family_defaults if family_defaults is not None else none(defaults_schema)
    family_decisions = family_decisions if family_decisions is not None else none(
        "run_id string, family_id string, status string, table_name string")
    family_results = family_results if family_results is not None else none(
        "run_id string, family_id string, member_semantics_notes string")
    grain_keys = grain_keys if grain_keys is not None else none("run_id string, column string")
    token_flags = token_flags if token_flags is not None else none(
        "run_id string, token_missing_placeholders_detected boolean")
    variables = variables if variables is not None else none("run_id string, column string, meaning string")
    codebook = codebook if codebook is not None else none(
        "run_id string, column string, codes_or_labels_note string, meaning string")
    scales = scales if scales is not None else none(
        "run_id string, target_kind string, target_id string, mapping_status string, response_scale_kind string, ordered_labels array<string>")
    tables = tables if tables is not None else none("run_id string, table_name string, kind string")

    # Layout first says which family a column belongs to; detected membership fills the rest.
    lay = layout.join(tables.select("run_id", F.col("table_name").alias("assigned_table"), "kind"),
                      ["run_id", "assigned_table"], "left")
    family = members.select(*KEY, F.col("family_id").alias("member_family")).join(
        layout.select(*KEY, F.col("source_family_id").alias("layout_family")), KEY, "full").select(
        *KEY, F.coalesce(F.when(F.col("layout_family") != "", F.col("layout_family")), "member_family").alias("family_id")
    ).filter(F.col("family_id").isNotNull())
    confirmed = scales.filter(F.col("mapping_status").isin("human_confirmed", "codebook_confirmed"))
    scale_row = F.struct("mapping_status", "response_scale_kind", "ordered_labels")
    by_family = confirmed.filter("target_kind = 'family'").select("run_id", F.col("target_id").alias("family_id"), scale_row.alias("fam_scale"))
    by_column = confirmed.filter("target_kind = 'column'").select("run_id", F.col("target_id").alias("column"), scale_row.alias("col_scale"))
    fam_keys = ["run_id", "family_id"]
    for part, name in ((family_decisions, "fam_decision"), (family_results, "fam_result"), (family_defaults, "fam_default")):
        family = family.join(_packed(part, family, fam_keys, name), fam_keys, "left")
    family = family.join(by_family, fam_keys, "left")

    # The row universe is a narrow union, so every wide input below is a left join on one key and the
    # growing side is never moved again.
    rows = a2.select(*KEY, "ordinal", F.lit(True).alias("in_a2"))
    for reviewed in (type_decisions, missingness_decisions):
        rows = rows.unionByName(reviewed.select(*KEY), allowMissingColumns=True)
    rows = rows.groupBy(*KEY).agg(F.max("ordinal").alias("ordinal"), F.bool_or("in_a2").alias("in_a2"))
    rows = rows.join(token_flags.select("run_id", F.col("token_missing_placeholders_detected").alias("token_flag")), "run_id", "left")
    for part in (_packed(type_decisions, rows, KEY, "typed"), _packed(missingness_decisions, rows, KEY, "missed"),
                 _packed(a17, rows, KEY, "a17"), _packed(lay, rows, KEY, "lay"), _packed(codebook, rows, KEY, "code"),
                 _packed(variables, rows, KEY, "var"),
                 grain_keys.select(*KEY, F.lit(True).alias("is_grain_key")).distinct(), by_column, family):
        rows = rows.join(part, KEY, "left")

    # --- structure
    accepted_child = (F.col("fam_decision.status") == "accept") & (F.col("fam_decision.table_name") != "")
    has_layout = F.col("lay").isNotNull()
    role = (
        F.when(has_layout, F.col("lay.assignment_role"))
        .when(F.coalesce("is_grain_key", F.lit(False)) & F.coalesce("in_a2", F.lit(False)), "base_key")
        .when(accepted_child, "melt_member").otherwise("unresolved")
    )
    table = (
        F.when(has_layout, F.when(F.col("lay.assignment_role").isin(*vocab.TABLELESS_ROLES), "").otherwise(F.col("lay.assigned_table")))
        .when(role == "base_key", "base_table").when(role == "melt_member", F.col("fam_decision.table_name")).otherwise("")
    )
    status = (
        F.when(F.col("canonical_assignment_role") == "exclude_from_outputs", "excluded_from_outputs")
        .when(F.col("canonical_assignment_role") == "unresolved", "unresolved")
        .when(F.col("canonical_assignment_role").isin("melt_member", "repeat_index"), "child_repeat_member")
        .when(F.col("canonical_assignment_role").startswith("reference_"), "reference_field")
        .when(F.col("lay.kind") == "event_table", "event_field").otherwise("base_field")
    )
    rows = rows.withColumns({
        "canonical_assignment_role": role, "canonical_table_name": table,
        "structure_decision_source": F.when(has_layout, "table_layout_worker")
        .when(role != "unresolved", "light_contract_fallback").otherwise("unresolved"),
        "scale": F.coalesce("col_scale", "fam_scale"),
    }).withColumn("canonical_modeling_status", status)

    # --- type: reviewed, then confirmed scale, then family default, then baseline
    type_source = (
        F.when(F.col("typed").isNotNull(), "reviewed_type_worker")
        .when(F.col("scale").isNotNull(), "scale_mapping_resolver")
        .when(F.col("fam_default.recommended_logical_type").isNotNull(), "family_default")
        .when(F.col("a17").isNotNull(), "a17_baseline").otherwise("unresolved_no_a2_evidence")
    )
    rows = rows.withColumn("type_decision_source", type_source)

    def by_type(field: str, scaled: Column, fallback: Column) -> Column:
        src = F.col("type_decision_source")
        return F.coalesce(
            F.when(src == "reviewed_type_worker", F.col(f"typed.{field}"))
            .when(src == "scale_mapping_resolver", scaled)
            .when(src == "family_default", F.col(f"fam_default.{field}"))
            .when(src == "a17_baseline", F.col(f"a17.{field}")), fallback)

    codebook_hint = "requires_codebook_or_label_mapping_review"
    rows = rows.withColumns({
        "recommended_logical_type": by_type("recommended_logical_type", F.lit("ordinal_category"), F.lit("mixed_or_ambiguous")),
        "recommended_storage_type": by_type("recommended_storage_type", F.lit("string"), F.lit("string")),
        "transform_actions": by_type("transform_actions", F.array(F.lit("trim_whitespace"), F.lit("normalize_category_tokens")), _empty()),
        "hints_raw": by_type("structural_transform_hints", F.coalesce("a17.structural_transform_hints", _empty()), _empty()),
        "notes_raw": by_type("interpretation_hints", F.coalesce("a17.interpretation_hints", _empty()), _empty()),
        "confidence": by_type("confidence", F.lit(0.9), F.lit(0.5)),
    })
    hints = F.when(F.col("scale").isNotNull(), F.array_remove("hints_raw", codebook_hint)).otherwise(F.col("hints_raw"))
    child_banned = F.array(*[F.lit(h) for h in vocab.CHILD_FORBIDDEN_HINTS])
    rows = rows.withColumn("structural_transform_hints", F.when(
        F.col("canonical_modeling_status") == "child_repeat_member", F.array_except(hints, child_banned)).otherwise(hints))

    # --- missingness: reviewed, then structural family default, then baseline, then reconcile
    structural_default = F.coalesce(F.col("fam_default.missingness_disposition").isin(*vocab.STRUCTURAL_DISPOSITIONS), F.lit(False))
    miss_source = (
        F.when(F.col("missed").isNotNull(), "reviewed_missingness_worker")
        .when(structural_default & F.coalesce("in_a2", F.lit(False)), "family_default")
        .when(F.col("a17").isNotNull(), "a17_baseline").otherwise("unresolved_no_a2_evidence")
    )
    rows = rows.withColumn("missingness_decision_source", miss_source)

    def by_missing(reviewed: str, field: str, fallback: Column) -> Column:
        src = F.col("missingness_decision_source")
        return F.coalesce(
            F.when(src == "reviewed_missingness_worker", F.col(f"missed.{reviewed}"))
            .when(src == "family_default", F.col(f"fam_default.{field}"))
            .when(src == "a17_baseline", F.col(f"a17.{field}")), fallback)

    rows = rows.withColumns({
        "missingness_disposition": by_missing("missingness_disposition", "missingness_disposition", F.lit("no_material_missingness")),
        "missingness_handling": by_missing("recommended_handling", "missingness_handling", F.lit("no_action_needed")),
        "skip_logic_protected": by_missing("skip_logic_protected", "skip_logic_protected", F.lit(False)),
        "base": F.when(F.col("a17").isNotNull(), F.struct(
            "a17.missingness_disposition", "a17.missingness_handling",
            F.lit("a17_baseline").alias("missingness_decision_source"), "a17.skip_logic_protected")),
    })
    rows = normalize_missingness(rows)
    rows = rows.withColumn("interpretation_hints", F.when(
        F.col("skip_logic_protected"), F.array_union("notes_raw", F.array(F.lit("skip_logic_protected"))))
        .otherwise(F.array_remove("notes_raw", "skip_logic_protected")))

    # --- meaning
    scale_note = F.concat(F.lit("Confirmed scale mapping ("), F.coalesce("scale.response_scale_kind", F.lit("")),
                          F.lit("). Ordered labels: "), F.array_join("scale.ordered_labels", " | "), F.lit("."))
    semantic_source = (
        F.when(F.col("code").isNotNull() | F.col("var").isNotNull(), "semantic_context_worker")
        .when(F.col("fam_result.member_semantics_notes").isNotNull(), "family_worker")
        .when(F.col("scale").isNotNull(), "scale_mapping_resolver").otherwise("unknown")
    )
    used_a17 = (F.col("type_decision_source") == "a17_baseline") | (F.col("missingness_decision_source") == "a17_baseline")
    used_default = (F.col("type_decision_source") == "family_default") | (F.col("missingness_decision_source") == "family_default")
    sources = F.array_compact(F.array(
        F.when(has_layout, "table_layout_worker"),
        F.when(F.col("structure_decision_source") == "light_contract_fallback", "light_contract"),
        F.when(semantic_source == "semantic_context_worker", "semantic_context_worker"),
        F.when(used_default, "family_worker.member_defaults"),
        F.when(F.col("scale").isNotNull(), "scale_mapping_resolver"),
        F.when(F.col("typed").isNotNull(), "type_transform_worker"),
        F.when(F.col("missed").isNotNull(), "missingness_worker"),
        F.when(used_a17, "A17")))
    review = F.coalesce("typed.needs_human_review", F.when(F.col("type_decision_source") == "family_default", F.col("fam_default.needs_human_review")),
                        F.when(F.col("type_decision_source") == "a17_baseline", F.col("a17.type_review_required")), F.col("in_a2").isNull())
    review = review | F.coalesce("missed.needs_human_review", F.when(
        F.col("missingness_decision_source") == "a17_baseline", F.col("a17.missingness_review_required")), F.lit(False))
    return rows.select(
        *KEY, F.coalesce("in_a2", F.lit(False)).alias("in_a2"), "ordinal",
        "canonical_modeling_status", "canonical_table_name", "canonical_assignment_role",
        F.coalesce("family_id", F.lit("")).alias("source_family_id"),
        F.coalesce("a17.a9_primary_role", F.lit("")).alias("a9_primary_role"),
        "recommended_logical_type", "recommended_storage_type", "transform_actions", "structural_transform_hints",
        "interpretation_hints", "missingness_disposition", "missingness_handling", "skip_logic_protected",
        F.coalesce("code.meaning", "var.meaning", "fam_result.member_semantics_notes", F.lit("")).alias("semantic_meaning"),
        F.concat_ws(" ", "code.codes_or_labels_note", F.when(F.col("scale").isNotNull(), scale_note)).alias("codebook_note"),
        F.array_join(F.array_compact(F.array(F.col("typed.normalization_notes"), F.array_join("normalization_notes_list", "; "))), " ").alias("normalization_notes"),
        F.round("confidence", 6).alias("confidence"), review.alias("needs_human_review"),
        "type_decision_source", "structure_decision_source", "missingness_decision_source",
        semantic_source.alias("semantic_decision_source"), sources.alias("applied_sources"),
    )


def ordered(contract: DataFrame) -> DataFrame:
    """Stable row order: A2 position, then reviewed-only columns by name; ``ordinal`` is 0-based.

    The running number counts within one dataset's columns, never over dataset rows.
    """
    order = Window.partitionBy("run_id").orderBy((~F.col("in_a2")).cast("int"), "ordinal", "column")
    return contract.withColumn("ordinal", F.row_number().over(order) - 1)


def summary_counts(contract: DataFrame) -> DataFrame:
    """The nine code-owned counts of each run's contract."""
    status, kind, gap = F.col("canonical_modeling_status"), F.col("type_decision_source"), F.col("missingness_decision_source")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    reviewed_type = F.coalesce(kind == "reviewed_type_worker", F.lit(False))
    return contract.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_source_columns"),
        F.count_if(~F.coalesce(status.isin("excluded_from_outputs", "unresolved"), F.lit(False))).alias("included_column_count"),
        n(status == "excluded_from_outputs").alias("excluded_column_count"),
        n(status == "unresolved").alias("unresolved_column_count"),
        F.count_if(reviewed_type | F.coalesce(gap == "reviewed_missingness_worker", F.lit(False))).alias("reviewed_override_count"),
        F.count_if(F.coalesce(kind == "family_default", F.lit(False)) | F.coalesce(gap == "family_default", F.lit(False))).alias("family_default_count"),
        n((kind == "a17_baseline") & (gap == "a17_baseline")).alias("deterministic_baseline_count"),
        F.count_if(reviewed_type).alias("reviewed_type_count"),
        F.count_if(~reviewed_type).alias("fallback_type_count"),
    )


def review_flags(contract: DataFrame) -> DataFrame:
    """Reviewed columns without evidence, and runs that lean mostly on the baseline."""
    ghosts = contract.filter(~F.col("in_a2")).select(
        "run_id", F.col("column").alias("item"), F.lit("reviewed_column_not_in_a2").alias("issue"),
        F.lit("Reviewed decisions name a column that the profile has no evidence for.").alias("why"))
    share = summary_counts(contract).filter(
        F.col("deterministic_baseline_count") / F.col("total_source_columns") >= vocab.BASELINE_SHARE_FLAG)
    heavy = share.select(
        "run_id", F.lit("column_contracts").alias("item"), F.lit("high_deterministic_baseline_share").alias("issue"),
        F.format_string("%d of %d columns rest on the deterministic baseline.", "deterministic_baseline_count",
                        "total_source_columns").alias("why"))
    return ghosts.unionByName(heavy)


def assumptions(skipped_semantics: DataFrame) -> DataFrame:
    """A run whose semantic step was skipped says so."""
    return skipped_semantics.select(
        "run_id", F.lit("semantic_context_skipped").alias("assumption"),
        F.concat(F.lit("Semantic fields stay blank: "), "reason").alias("explanation"))
