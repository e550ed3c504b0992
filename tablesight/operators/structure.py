"""Column roles, skip logic, layout candidates and the baseline resolution of each column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesight import vocab
from tablesight.functions import cells
from tablesight.operators.keys import _grouped
from tablesight.plans.shared import cut

KEY = ["run_id", "column"]


def roles(shares: DataFrame, members: DataFrame) -> DataFrame:
    """Primary role per column from ranked role scores; several strong readings ask for review."""
    present = F.col("n_present") == F.col("n_rows")
    unique = F.coalesce(F.try_divide("unique_count", "n_present"), F.lit(0.0))
    named = F.greatest("url_share", "email_share", "words_share", "prose_share") >= vocab.ANCHOR_SHARE
    numeric = F.col("numeric_share") >= vocab.TYPE_SHARE
    few = F.col("unique_count") <= vocab.CODED_LEVELS
    member = F.col("family_id").isNotNull()
    index = F.col("column").rlike(cells.EXPORT_INDEX)
    rules = [
        ("id_key", 1.0, (unique >= 0.99) & present & ~named & ~index & (F.col("datetime_share") < vocab.TYPE_SHARE)),
        ("time_index", 0.95, F.col("datetime_share") >= vocab.TYPE_SHARE),
        ("measure_item", 0.9, member & (numeric | few)),
        ("coded_categorical", 0.85, numeric & few),
        ("measure", 0.8, numeric),
        ("invariant_attr", 0.5, F.lit(True)),
    ]
    scored = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(-score).alias("minus"), F.lit(role).alias("role"))) for role, score, cond in rules
    ]))
    strong = F.size(F.filter("scored", lambda s: s["minus"] <= -0.85))
    role = F.col("scored")[0]["role"]
    out = shares.join(members.select(*KEY, "family_id"), KEY, "left").withColumn("scored", F.array_sort(scored))
    return out.select(
        *KEY, role.alias("primary_role"),
        F.when(role == "time_index", "temporal").when(role == "measure", "numeric")
        .when(role == "measure_item", "ordinal").otherwise("nominal").alias("encoding_type"),
        (strong >= 2).alias("review_required"),
        F.transform("scored", lambda s: F.struct(s["role"].alias("role"), (-s["minus"]).alias("score"))).alias("role_candidates"),
    )


def repeat_indexes(df: DataFrame, run_id: str, keys: Sequence[str], columns: Sequence[str], cut_off: float = 0.99) -> DataFrame:
    """Columns that number the rows of a repeated key without gaps: run_id, key, column, checked, held_share.

    Every pair of key and integer column is looked at in one pass. A key counts if it has several rows; its
    values must be as many as its rows, all different, and run from 0 or 1 without a gap. Rows combine per
    key and value first, so a hot key is as many rows as it has values.
    """
    pairs = [(k, c) for k in keys for c in columns if k != c]
    if not pairs:
        return df.sparkSession.createDataFrame([], "run_id string, key string, column string, checked long, held_share double")
    cell = {x: F.col(f"`{x}`").cast("string") for pair in pairs for x in pair}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(c).alias("column"), cell[k].alias("of"), cells.as_double(cell[c]).cast("long").alias("at")) for k, c in pairs])
    counted = df.select(F.inline(entries)).where("of is not null").groupBy("key", "column", "of", "at").agg(F.count(F.lit(1)).alias("n"))
    keyed = counted.groupBy("key", "column", "of").agg(
        F.sum("n").alias("n"), F.count("at").alias("values"), F.min("at").alias("low"), F.max("at").alias("high")).where("n > 1")
    gapless = (F.col("values") == F.col("n")) & F.col("low").isin(0, 1) & (F.col("high") - F.col("low") + 1 == F.col("n"))
    out = keyed.groupBy("key", "column").agg(F.count(F.lit(1)).alias("checked"), F.count_if(gapless).alias("held"))
    return out.select(F.lit(run_id).alias("run_id"), "key", "column", "checked", F.round(F.col("held") / F.col("checked"), 6).alias("held_share")).where(F.col("held_share") >= cut_off)


def refined_roles(role_rows: DataFrame, repeats: DataFrame, shares: DataFrame) -> DataFrame:
    """``role_rows`` with two narrower roles: ``repeat_index`` for columns that number a key's rows, and ``measure_numeric``
    for measures that are not whole numbers. The former role stays among the candidates."""
    counts = repeats.groupBy(*KEY).agg(F.lit(True).alias("counts"))
    joined = role_rows.join(counts, KEY, "left").join(shares.select(*KEY, "integral_share"), KEY, "left")
    role = (
        F.when(F.col("counts") & F.col("primary_role").isin("coded_categorical", "measure", "measure_item"), "repeat_index")
        .when((F.col("primary_role") == "measure") & (F.coalesce("integral_share", F.lit(0.0)) < vocab.TYPE_SHARE), "measure_numeric")
        .otherwise(F.col("primary_role"))
    )
    changed = F.col("role") != F.col("primary_role")
    return joined.withColumn("role", role).select(
        *KEY, F.col("role").alias("primary_role"),
        F.when(F.col("role") == "repeat_index", "ordinal").otherwise(F.col("encoding_type")).alias("encoding_type"), "review_required",
        F.when(changed, F.concat(F.array(F.struct(F.col("role"), F.lit(1.0).alias("score"))), F.col("role_candidates"))).otherwise(F.col("role_candidates")).alias("role_candidates"),
    )


def gap_groups(df: DataFrame, targets: Sequence[str]) -> list[list[str]]:
    """Columns of ``targets`` that are missing in the same rows, by sums of row hashes over those rows.

    One aggregation without a key, so one short row per input partition is shuffled.
    """
    rows = [F.xxhash64(F.lit(seed), *[x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]) for seed in (1, 2)]
    base = df.select(*[h.cast("decimal(38,0)").alias(f"row_{i}") for i, h in enumerate(rows)],
                     *[cells.is_missing(F.col(f"`{c}`").cast("string")).alias(f"gap_{i}") for i, c in enumerate(targets)])
    sums = base.agg(*[F.struct(F.sum(F.when(F.col(f"gap_{i}"), F.col("row_0"))), F.sum(F.when(F.col(f"gap_{i}"), F.col("row_1")))).alias(f"m_{i}")
                      for i in range(len(targets))]).first()
    groups: dict[tuple, list[str]] = {}
    for i, c in enumerate(targets):
        groups.setdefault(tuple(sums[f"m_{i}"]), []).append(c)
    return list(groups.values())


#: Targets and triggers of one aggregation; more are taken in turn.
TARGETS_AT_ONCE, TRIGGERS_AT_ONCE = 20, 40


def all_skip_logic(df: DataFrame, run_id: str, triggers: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """``skip_logic`` of every trigger with every target, however many there are.

    Columns missing in the same rows follow the same rules, so one of each such group is tested and its
    rules hold for all; a second one stands in where the tested column is itself the trigger.
    """
    rules, stand_in = None, {}
    for group in gap_groups(df, targets) if targets else []:
        first = next((c for c in group if c not in triggers), group[0])
        for c in (first, *([g for g in group if g != first][:1] if first in triggers else [])):
            stand_in[c] = group
    tested = list(stand_in)
    for a in range(0, len(tested), TARGETS_AT_ONCE):
        for b in range(0, len(triggers), TRIGGERS_AT_ONCE):
            part = skip_logic(df, run_id, triggers[b : b + TRIGGERS_AT_ONCE], tested[a : a + TARGETS_AT_ONCE])
            rules = part if rules is None else rules.unionByName(part)
    if rules is None:
        raise ValueError("skip logic needs a trigger and a target")
    pairs = [(c, member) for c, group in stand_in.items() for member in group]
    members = df.sparkSession.createDataFrame(pairs, "tested string, affected_column string")
    named = rules.withColumnRenamed("affected_column", "tested").join(F.broadcast(members), "tested")  # one row per column
    return named.where(F.col("trigger_column") != F.col("affected_column")).select(*rules.columns).distinct()


def skip_logic(df: DataFrame, run_id: str, triggers: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Trigger levels that decide whether another column is filled.

    One scan: each trigger is a grouping set, so what is shuffled is levels and not rows. The level
    counts are read twice (for themselves and for their totals), so they are cut off from the scan
    first. Both ``trigger = v`` and ``trigger <> v`` are tried as the reason for a gap.
    """
    base = df.select(*[F.col(f"`{t}`").cast("string").alias(t) for t in triggers],
                     *[cells.is_missing(F.col(f"`{c}`").cast("string")).alias(f"gap_{i}") for i, c in enumerate(targets)])
    levels = _grouped(base, [[t] for t in triggers], [
        F.count(F.lit(1)).alias("n"), *[F.count_if(f"gap_{i}").alias(f"m_{i}") for i in range(len(targets))]])
    rows = cut(levels).select(
        F.col("keys_tested").alias("trigger_column"), F.coalesce(*triggers).alias("level"), "n",
        F.inline(F.array(*[F.struct(F.lit(c).alias("target"), F.col(f"m_{i}").alias("m"))
                           for i, c in enumerate(targets)])),
    ).filter(F.col("trigger_column") != F.col("target"))
    totals = rows.groupBy("trigger_column", "target").agg(
        F.sum("n").alias("all_n"), F.sum("m").alias("all_m"), F.count("level").alias("n_levels"),
    ).filter((F.col("n_levels") <= vocab.CODED_LEVELS) & (F.col("all_m") > 0)).drop("n_levels")
    # one row per trigger and target, so the broadcast is as small as the two column lists
    per = rows.filter(F.col("level").isNotNull()).join(F.broadcast(totals), ["trigger_column", "target"])
    both = per.select("*", F.inline(F.array(
        F.struct(F.lit("=").alias("op"), F.col("n").alias("cn"), F.col("m").alias("cm")),
        F.struct(F.lit("<>").alias("op"), (F.col("all_n") - F.col("n")).alias("cn"), (F.col("all_m") - F.col("m")).alias("cm")),
    )))
    explained = F.round(100 * F.col("cm") / F.col("all_m"), 6)
    gap_if = F.coalesce(F.try_divide("cm", "cn"), F.lit(0.0))
    rest = F.col("all_n") - F.col("cn")
    filled_else = F.coalesce(F.try_divide(rest - (F.col("all_m") - F.col("cm")), rest), F.lit(0.0))
    direction = (
        F.when((gap_if >= vocab.SKIP_SHARE) & (filled_else >= vocab.SKIP_SHARE), "bidirectional")
        .when(gap_if >= vocab.SKIP_SHARE, "forward").otherwise("partial")
    )
    return both.select(
        F.lit(run_id).alias("run_id"), "trigger_column", F.col("level").alias("trigger_value"),
        F.col("op").alias("trigger_test"), F.col("target").alias("affected_column"),
        explained.alias("missing_explained_pct"), direction.alias("directionality"),
    ).filter((F.col("missing_explained_pct") >= vocab.SKIP_EXPLAINED_PCT)
             & ((F.col("trigger_test") == "=") | (F.col("directionality") != "partial")))


def skip_summary(rules: DataFrame, members: DataFrame, sample: int = 5) -> DataFrame:
    """Rules folded per trigger, with the affected columns and families."""
    affected = rules.join(members.select("run_id", F.col("column").alias("affected_column"), "family_id"),
                          ["run_id", "affected_column"], "left")
    return affected.groupBy("run_id", "trigger_column", "trigger_test", "trigger_value").agg(
        F.count(F.lit(1)).alias("affected_column_count"),
        F.array_sort(F.collect_set("family_id")).alias("affected_family_ids"),
        F.slice(F.array_sort(F.collect_list("affected_column")), 1, sample).alias("sample_affected_columns"),
        F.min("missing_explained_pct").alias("missing_explained_pct"),
        F.when(F.bool_and(F.col("directionality") == "bidirectional"), "bidirectional")
        .when(F.bool_and(F.col("directionality") != "partial"), "forward").otherwise("partial").alias("directionality"),
    )


def master_switches(rules: DataFrame, at_least: int = vocab.MASTER_SWITCH_TARGETS) -> DataFrame:
    """Triggers that govern many columns at once."""
    return rules.filter(F.col("directionality") != "partial").groupBy(
        "run_id", "trigger_column", "trigger_test", "trigger_value"
    ).agg(F.count(F.lit(1)).alias("governed_columns")).filter(F.col("governed_columns") >= at_least)


def layout_candidates(ranked: DataFrame, role_rows: DataFrame, members: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """One layout per tested grain: what would sit in the base table, in child tables, or nowhere."""
    columns = role_rows.select("run_id", "column", "primary_role").join(
        members.select("run_id", "column", "family_id"), ["run_id", "column"], "left")
    table = F.when(F.col("column").rlike(cells.EXPORT_INDEX), "none").otherwise(F.coalesce("family_id", F.lit("base")))
    shape = columns.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.count_if(F.col("family_id").isNull()).alias("base_columns"),
        F.count_distinct("family_id").alias("child_tables"),
        F.count_if(F.col("column").rlike(cells.EXPORT_INDEX)).alias("coverage_gap_columns"),
        F.array_sort(F.collect_list(F.struct("column", table.alias("table")))).alias("column_placements"),  # as long as the table is wide
    )
    out = cut(ranked).join(shape, "run_id")  # a few rows per run, and costly to recompute
    match = F.lit(False)
    if preferred is not None:
        out = out.join(preferred.select("run_id", F.array_sort("keys").alias("wanted")), "run_id", "left")
        match = F.coalesce(F.array_sort(F.split("keys_tested", ",")) == F.col("wanted"), F.lit(False))
    score = 0.6 * F.col("uniqueness_rate") + 0.3 * (1 - F.col("non_key_conflict_group_pct") / 100) + F.when(
        F.col("pivot_safety"), 0.1).otherwise(0.0)
    return out.select(
        "run_id", F.col("keys_tested").alias("layout_id"), F.col("keys_tested").alias("grain"),
        F.split("keys_tested", ",").alias("grain_keys"), "column_placements", "base_columns", "child_tables", "coverage_gap_columns",
        match.alias("preferred_grain_match"), F.round(score, 6).alias("score"),
        F.when(F.col("uniqueness_rate") < 1, F.array(F.lit("grain_not_unique"))).otherwise(F.array().cast("array<string>")).alias("ambiguities"),
    )


def baseline_resolution(a2: DataFrame, role_rows: DataFrame, missingness: DataFrame, anchors: DataFrame,
                        quality_rows: DataFrame, drift_rows: DataFrame, skip_rules: DataFrame,
                        transform_items: DataFrame, type_items: DataFrame) -> DataFrame:
    """The deterministic per-column baseline (A17): every evidence artifact left-joined on its column.

    All inputs share the (run_id, column) key, so after the first join the left side keeps its
    partitioning and each further artifact is moved once.
    """
    # a partial rule only says where the gaps are, not that the trigger causes them
    decisive = (F.col("missing_explained_pct") >= vocab.SKIP_EXPLAINED_PCT) & (F.col("directionality") != "partial")
    affected = skip_rules.filter(decisive).groupBy(
        "run_id", F.col("affected_column").alias("column")).agg(F.lit(True).alias("gated"))
    reasons = transform_items.groupBy(*KEY).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    competing = type_items.select(*KEY, F.lit(True).alias("competing")).distinct()
    joined = a2
    for part in (
        role_rows.select(*KEY, "primary_role", F.col("review_required").alias("role_review")),
        missingness.select(*KEY, F.col("missing_pct").alias("a4_missing_pct"), "token_na_count"),
        anchors.select(*KEY, "detected_anchors"),
        quality_rows.select(*KEY, F.col("global_quality_score").alias("quality_score")),
        drift_rows.select(*KEY, "drift_detected"),
        affected, reasons, competing,
    ):
        joined = joined.join(part, KEY, "left")

    role, kind = F.coalesce("primary_role", F.lit("")), F.col("top_candidate.type")
    prose = F.coalesce("prose_share", F.lit(0.0)) >= 0.5
    logical = (
        F.when(role == "id_key", "identifier")
        .when(role == "coded_categorical", "categorical_code")
        .when(prose, "free_text")
        .when((kind == "datetime") & (F.coalesce("time_of_day_share", F.lit(0.0)) > 0), "datetime")
        .when(kind == "datetime", "date")
        .when(kind == "boolean", "boolean_flag")
        .when(kind.isin("numeric", "numeric_with_unit"), "numeric_measure")
        .when(kind == "categorical", "nominal_category")
        .when(kind == "text", "free_text")
        .otherwise("mixed_or_ambiguous")
    )
    storage = (
        F.when(F.col("logical") == "date", "date").when(F.col("logical") == "datetime", "datetime")
        .when(F.col("logical") == "boolean_flag", "boolean")
        .when((F.col("logical") == "numeric_measure") & (F.coalesce("integral_share", F.lit(0.0)) >= 1.0), "integer")
        .when(F.col("logical") == "numeric_measure", "decimal").otherwise("string")
    )
    pct = F.coalesce("a4_missing_pct", "missing_pct")
    disposition = (
        F.when(pct == 0, "no_material_missingness")
        .when(F.coalesce("gated", F.lit(False)), "structurally_valid_missingness")
        .when(F.coalesce("token_na_count", F.lit(0)) > 0, "token_missingness_present")
        .when(pct >= vocab.HIGH_MISSING_PCT, "unexplained_high_missingness")
        .when(pct < 5, "no_material_missingness")
        .otherwise("mixed_missingness_risk")
    )
    handling = (
        F.when(F.col("disposition") == "no_material_missingness", "no_action_needed")
        .when(F.col("disposition") == "structurally_valid_missingness", "protect_from_null_penalty")
        .when(F.col("disposition") == "unexplained_high_missingness", "review_before_drop")
        .otherwise("retain_with_caution")
    )
    has = lambda r: F.array_contains(F.coalesce("reasons", F.array().cast("array<string>")), r)
    protect = F.col("disposition") == "structurally_valid_missingness"
    actions = F.array_compact(F.array(
        F.lit("trim_whitespace"),
        F.when(F.coalesce("token_na_count", F.lit(0)) > 0, "normalize_missing_tokens"),
        F.when(has("currency"), "strip_numeric_formatting"),
        F.when(kind == "numeric_with_unit", "strip_unit_suffix"),
        F.when(has("percent_possible"), "standardize_percent_scale"),
        F.when(F.col("storage") == "boolean", "normalize_boolean_tokens"),
        F.concat(F.lit("cast_to_"), F.when(F.col("storage") != "boolean", F.col("storage"))),
    ))
    hints = F.array_compact(F.array(
        F.when(has("categorical_multi"), "split_multiselect_tokens"),
        F.when(has("range_like"), "split_range_into_start_end"),
        F.when(has("numeric_with_unit"), "requires_unit_normalization_review"),
    ))
    notes = F.array_compact(F.array(
        F.when(F.col("logical") == "identifier", "identifier_not_measure"),
        F.when(F.col("logical") == "categorical_code", "code_not_quantity"),
        F.when(role == "time_index", "time_index_not_identifier"),
        F.when(role == "measure_item", "repeat_context_do_not_use_as_base_key"),
        F.when(prose & (kind == "numeric"), "numeric_parse_is_misleading"),
        F.when(F.col("logical") == "mixed_or_ambiguous", "mixed_content_high_risk"),
        F.when(protect, "skip_logic_protected"),
    ))
    staged = joined.withColumn("logical", logical).withColumn("disposition", disposition)
    staged = staged.withColumn("storage", storage).withColumn("handling", handling)
    type_review = F.coalesce("competing", F.lit(False)) | F.coalesce("role_review", F.lit(False))
    missing_review = F.col("disposition").isin("unexplained_high_missingness", "mixed_missingness_risk")
    missing_conf = F.when(missing_review, 0.6).otherwise(0.85)
    return staged.select(
        *KEY, role.alias("a9_primary_role"),
        F.col("logical").alias("recommended_logical_type"), F.col("storage").alias("recommended_storage_type"),
        actions.alias("transform_actions"), hints.alias("structural_transform_hints"),
        notes.alias("interpretation_hints"),
        F.col("disposition").alias("missingness_disposition"), F.col("handling").alias("missingness_handling"),
        protect.alias("skip_logic_protected"),
        F.lit("").alias("type_normalization_notes"), F.lit("").alias("missingness_normalization_notes"),
        F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"),
        F.coalesce("drift_detected", F.lit(False)).alias("drift_detected"),
        F.lit("a17_baseline").alias("type_decision_source"), F.lit("a17_baseline").alias("missingness_decision_source"),
        F.round("confidence", 6).alias("type_confidence"), missing_conf.alias("missingness_confidence"),
        type_review.alias("type_review_required"), missing_review.alias("missingness_review_required"),
        F.round((F.col("confidence") + missing_conf) / 2, 6).alias("confidence"),
        F.array(F.lit("A17")).alias("applied_sources"),
    )
