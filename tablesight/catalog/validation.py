"""Validation queries over a fleet of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight import vocab
from tablesight.catalog import contracts as c
from tablesight.catalog.registry import query
from tablesight.functions import cells
from tablesight.operators import rules
from tablesight.plans.validate import validate


def none():
    return F.array().cast("array<string>")


def said():
    return F.lit("text")


def rules_sql(source, array, pairs, many=True):
    """Union of (condition, message tail) rules; a tail is an SQL text expression."""
    path = f"'{array}[' || cast(position as varchar) || ']'" if many else f"'{array}'"
    return "\nunion all ".join(f"select run_id, {path} || {tail} as message from {source} where {cond}" for cond, tail in pairs)


def listed(values):
    return ", ".join(sorted(values))


def only(errors):
    return errors.select("run_id", "message")


def bad_types(tb):
    df = c.words(c.col(tb.input("bad_types")), "transform_actions")
    return df.withColumns({"structural_transform_hints": none(), "interpretation_hints": none(), "reasoning": said(),
                           "skip_logic_protected": F.lit(False), "needs_human_review": F.lit(False)})


_L, _S = "recommended_logical_type", "recommended_storage_type"
_KNOWN = f"{_L} <> 'weird' and {_S} is not null"
TYPE_PAIRS = [
    (f"{_S} is null", f"'.{_S} is required.'"), ("trim(column_name) = ''", "'.column must not be blank.'"),
    (f"{_L} = 'weird'", f"'.{_L} must be one of: {listed(vocab.LOGICAL_TYPES)}'"),
    (f"{_KNOWN} and {_L} = 'identifier' and {_S} <> 'string'", "' has inconsistent type/storage pair: identifier must use storage type string'"),
    (f"{_KNOWN} and {_L} = 'categorical_code' and {_S} <> 'string'", f"' has inconsistent type/storage pair: categorical_code cannot use storage type ' || {_S}"),
    (f"{_KNOWN} and {_L} = 'numeric_measure' and {_S} not in ('integer', 'decimal')", "' has inconsistent type/storage pair: numeric_measure must use storage type integer or decimal'"),
    (f"{_KNOWN} and {_L} = 'date' and {_S} <> 'date'", "' has inconsistent type/storage pair: date must use storage type date'"),
    (f"{_KNOWN} and {_L} = 'boolean_flag' and {_S} <> 'boolean'", "' has inconsistent type/storage pair: boolean_flag must use storage type boolean'"),
    ("transform_actions like '%explode_rows'", f"'.transform_actions[1] must be one of: {listed(vocab.TRANSFORM_ACTIONS)}'"),
    ("normalization_notes = ''", "'.normalization_notes must not be blank.'"), ("confidence > 1", "'.confidence must be between 0 and 1.'"),
]


@query("v_type_storage", rules_sql("bad_types", "column_decisions", TYPE_PAIRS), ("fleet_columns", "bad_types"))
def v_type_storage(tb):
    return only(rules.type_rules().errors(bad_types(tb)))


_D, _V, _H = "missingness_disposition", "structural_validity", "recommended_handling"


def _in(field, pairs):
    return " or ".join(f"({_D} = '{d}' and {field} in ({', '.join(repr(v) for v in vs)}))" for d, vs in pairs.items())


MISS_PAIRS = [
    (f"not ({_in(_V, vocab.VALIDITY_FOR_DISPOSITION)})", f"' has inconsistent {_D}/{_V} pair: ' || {_D} || ' cannot use ' || {_V}"),
    (f"not ({_in(_H, vocab.HANDLING_FOR_DISPOSITION)})", f"' has inconsistent {_D}/{_H} pair: ' || {_D} || ' cannot use ' || {_H}"),
    (f"{_H} = 'protect_from_null_penalty' and not skip_logic_protected", f"'.skip_logic_protected must be true when {_H} is protect_from_null_penalty.'"),
    (f"{_V} = 'confirmed_structural' and not skip_logic_protected", f"'.skip_logic_protected must be true when {_V} is confirmed_structural.'"),
    (f"skip_logic_protected and {_V} in ('not_structurally_explained', 'not_applicable')", f"'.skip_logic_protected cannot be true when {_V} is ' || {_V} || '.'"),
]


def missing_rows(tb):
    df = c.col(tb.input("fleet_missing")).join(
        c.col(tb.input("fleet_columns")).select("run_id", "column", F.col("ordinal").alias("position")), ["run_id", "column"])
    return df.withColumns({"trigger_columns": none(), "normalization_notes": said(), "reasoning": said(), "confidence": F.lit(0.5)})


_MISS = "(select m.*, c.ordinal as position from fleet_missing m join fleet_columns c on m.run_id = c.run_id and m.column_name = c.column_name) q"


@query("v_missingness_pairs", rules_sql(_MISS, "column_decisions", MISS_PAIRS), ("fleet_columns", "fleet_missing"))
def v_missingness_pairs(tb):
    return only(rules.missingness_rules().errors(missing_rows(tb)))


_WIDE = "kind = 'child_repeat' and strategy = 'wide_to_long_family'"
_FAM = "kind = 'child_repeat' and basis = 'accepted_family'"
LAYOUT_PAIRS = [
    ("kind = 'cube'", "'.kind is invalid.'"), (f"{_WIDE} and repeat_index_name = ''", "'.repeat_index_name must be non-empty.'"),
    (f"{_WIDE} and repeat_index_name <> '' and grain_columns <> 'id,row'", "'.grain_columns must equal parent_key + repeat_index_name.'"),
    (f"{_FAM} and source_family_id = ''", "'.source_family_id must not be blank.'"),
    (f"{_FAM} and included_column_count <= 0", "'.included_column_count must be > 0.'"),
    (f"{_FAM} and preview = ''", "'.included_columns_preview must not be empty.'"),
    (f"{_FAM} and pick % 6 = 0", "'.included_columns must be omitted or empty for family-like child compact summaries.'"),
    (f"not ({_FAM}) and source_family_id <> ''", "'.source_family_id must be omitted or blank for non-family tables.'"),
]


@query("v_layout_rules", rules_sql("bad_layout", "table_suggestions", LAYOUT_PAIRS), ("fleet_columns", "bad_layout"))
def v_layout_rules(tb):
    df = c.words(tb.input("bad_layout"), "grain_columns", "preview").withColumnsRenamed(
        {"basis": "source_basis_kind", "strategy": "build_strategy", "preview": "included_columns_preview", "column_name": "table_name"})
    df = df.withColumns({
        "parent_table_name": F.lit("base_rows"), "parent_key": F.array(F.lit("id")), "excluded_columns": none(), "confidence": F.lit(0.9),
        "reasoning": said(), "needs_human_review": F.lit(False),
        "included_columns": F.when(F.col("pick") % 6 == 0, F.array("table_name")).otherwise(none())})
    return only(rules.layout_table_rules().errors(df))


_OK = "assignment_role <> 'pivot_me'"
_LOOSE = "assignment_role in ('exclude_from_outputs', 'unresolved')"
ASSIGN_PAIRS = [
    (f"not ({_OK})", "'.assignment_role is invalid.'"), (f"not ({_LOOSE}) and assigned_table = ''", "'.assigned_table must not be blank.'"),
    (f"{_OK} and not ({_LOOSE}) and assigned_table like 'nowhere%'", "'.assigned_table must match a table_name in table_suggestions.'"),
    ("assignment_role = 'melt_member' and source_family_id = ''", "'.source_family_id is required for melt_member.'"),
]


@query("v_layout_assignments", rules_sql("bad_assign", "column_table_assignments", ASSIGN_PAIRS), ("fleet_columns", "bad_assign"))
def v_layout_assignments(tb):
    rows = c.col(tb.input("bad_assign")).withColumn("why", said())
    tables = rows.select("run_id", F.lit("base_rows").alias("assigned_table"), F.lit(True).alias("known")).distinct()
    rows = rows.join(tables, ["run_id", "assigned_table"], "left").withColumn("known_table", F.coalesce("known", F.lit(False)))
    return only(rules.assignment_rules().errors(rows))


_MERGE = "strategy = 'merge_sibling_families_with_wave'"
PLAN_PAIRS = [
    ("strategy = 'mystery'", "'.build_strategy is invalid.'"), ("grain_columns = ''", "'.grain_columns must not be empty.'"),
    ("confidence > 1", "'.confidence must be between 0 and 1.'"),
    (f"{_MERGE} and wave_column = ''", "'.wave_column must be non-empty for merge_sibling_families_with_wave.'"),
    (f"{_MERGE} and wave_column <> '' and not list_contains(string_split(grain_columns, ','), wave_column)", "'.wave_column must be present in grain_columns for merge_sibling_families_with_wave.'"),
    ("strategy = 'pass_through' and sources = 'a,b'", "'.pass_through should reference exactly one source canonical table.'"),
]


@query("v_analysis_tables", rules_sql("bad_plan", "analysis_table_suggestions", PLAN_PAIRS), ("fleet_columns", "bad_plan"))
def v_analysis_tables(tb):
    df = c.words(tb.input("bad_plan"), "grain_columns", "sources").withColumnsRenamed(
        {"strategy": "build_strategy", "sources": "source_canonical_tables", "column_name": "table_name"})
    df = df.withColumns({"kind": F.lit("score_table"), "included_family_ids": none(), "value_columns": F.array(F.lit("v")),
                         "reasoning": said(), "needs_human_review": F.lit(False)})
    return only(rules.analysis_table_rules().errors(df))


@query("v_derivations", rules_sql("bad_plan", "derivations", [
    ("policy is null", "'.null_handling_policy is required.'"), ("derivation_kind = 'guess'", "'.derivation_kind is invalid.'"),
    ("policy = 'zero_fill'", "'.null_handling_policy is invalid.'")]), ("fleet_columns", "bad_plan"))
def v_derivations(tb):
    df = c.words(tb.input("bad_plan"), "sources").withColumnsRenamed(
        {"sources": "source_tables", "column_name": "output_table_name", "policy": "null_handling_policy"})
    df = df.withColumns({"derivation_name": said(), "join_keys": none(), "grouping_keys": none(), "reasoning": said()})
    return only(rules.derivation_rules().errors(df))


def contract_rows(tb):
    base = c.small_contract(tb)
    return base.withColumn("position", F.col("ordinal")).withColumns({
        "a9_primary_role": F.lit("measure"),
        "canonical_table_name": F.when(F.col("column").like("Q%"), "base_rows").otherwise(F.col("canonical_table_name")),
        "recommended_logical_type": F.when(F.col("confidence") > 0.8, "odd").otherwise(F.col("recommended_logical_type")),
        "skip_logic_protected": F.col("skip_logic_protected") | (F.col("confidence") == 0.3),
        "confidence": F.when(F.col("confidence") == 0.5, F.lit(None)).otherwise(F.col("confidence"))})


@query("v_contract_rows", f"""
with {c.SMALL},
x as (select *, ordinal as position from small)
{rules_sql("x", "column_contracts", [
    ("conf = 0.5", "'.confidence is required'"), ("conf > 0.8", "'.recommended_logical_type is invalid'"),
    ("status = 'unresolved' and column_name like 'Q%'", "'.canonical_table_name must be blank for excluded or unresolved assignments'"),
    ("conf = 0.5", "'.confidence must be between 0 and 1'"),
    ("conf = 0.3 and ih = '[]'", "'.skip_logic_protected can only be true for structurally_valid_missingness or partially_structural_missingness'")])}
""", ("fleet_columns",))
def v_contract_rows(tb):
    return only(rules.contract_rules().errors(contract_rows(tb)))


def _py(values):
    return "[" + ", ".join(f"''{v}''" for v in sorted(values)) + "]"


@query("v_family_results", "with f as (select run_id, family_id, 0 as position, count(*) as n from fleet_members group by all)\n" + rules_sql("f", "family_result", [
    ("n = 2", f"'.recommended_family_role must be one of {_py(vocab.FAMILY_ROLES)}.'"),
    ("run_id % 3 = 0 and n % 2 = 0", "'.recommended_parent_key must be non-empty when recommended_handling is retain_as_child_table.'")], many=False)
    + "\nunion all select run_id, 'top-level family_id must equal family_result.family_id.' from f where family_id = 'q' and run_id % 5 = 0",
    ("fleet_columns", "fleet_members"))
def v_family_results(tb):
    f = tb.input("fleet_members").groupBy("run_id", "family_id").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "position": F.lit(0), "root_family_id": F.when((F.col("family_id") == "q") & (F.col("run_id") % 5 == 0), "other").otherwise(F.col("family_id")),
        "recommended_table_name": said(), "recommended_repeat_index_name": F.lit("row"), "member_semantics_notes": said(), "reasoning": said(),
        "recommended_parent_key": F.when((F.col("run_id") % 3 == 0) & (F.col("n") % 2 == 0), "").otherwise("id"), "confidence": F.lit(0.9),
        "recommended_family_role": F.when(F.col("n") == 2, "pair").otherwise("event_sequence"),
        "recommended_handling": F.lit("retain_as_child_table"), "needs_human_review": F.lit(False)})
    return only(rules.family_result_rules().errors(f))


@query("v_member_defaults", "with d as (select *, 0 as position from fleet_defaults)\n" + rules_sql("d", "member_defaults", [
    ("run_id % 3 = 0", f"'.missingness_disposition must be one of {_py(vocab.STRUCTURAL_DISPOSITIONS)}.'"),
    ("run_id % 3 = 0", "'.missingness_disposition is required when member_defaults.missingness_handling or member_defaults.skip_logic_protected is provided.'"),
    ("run_id % 3 = 0 and run_id % 4 = 0", "'.skip_logic_protected can only be true when member_defaults.missingness_disposition is structurally_valid_missingness or partially_structural_missingness.'"),
    ("run_id % 3 <> 0 and run_id % 5 = 0", "'.skip_logic_protected must be true when member_defaults.missingness_handling is protect_from_null_penalty.'")], many=False),
    ("fleet_columns", "fleet_members", "fleet_defaults"))
def v_member_defaults(tb):
    flip = F.when((F.col("run_id") % 3 == 0) & (F.col("run_id") % 4 == 0), True).when(F.col("run_id") % 5 == 0, False)
    d = tb.input("fleet_defaults").withColumns({
        "position": F.lit(0), "transform_actions": none(), "structural_transform_hints": none(), "interpretation_hints": none(),
        "confidence": F.lit(0.5), "skip_logic_protected": F.coalesce(flip, F.col("skip_logic_protected"))})
    return only(rules.member_default_rules().errors(d))


@query("v_grain", "with g as (select run_id, min(seed) as s, min(pick) as p, 0 as position from fleet_columns group by run_id)\n" + rules_sql("g", "recommended_primary_grain", [
    ("s % 7 = 0", "'.description must be a non-empty string'"), ("p % 3 = 0", "'.keys must be a non-empty array'"),
    ("s % 5 = 0", "'.confidence_score must be between 0 and 1'"), ("p % 3 = 0 and s % 2 = 0", "'.keys must still be non-empty for no_clear_key'")], many=False)
    + "\nunion all select run_id, 'Invalid recommended_primary_grain.grain_type: fuzzy' from g where s % 2 = 1 and p % 11 = 0", ("fleet_columns",))
def v_grain(tb):
    g = tb.input("fleet_columns").groupBy("run_id").agg(F.min("seed").alias("s"), F.min("pick").alias("p"))
    g = g.select("run_id", F.lit(0).alias("position"), F.when(F.col("s") % 7 == 0, " ").otherwise("d").alias("description"), said().alias("justification"),
                 F.when(F.col("s") % 2 == 0, "no_clear_key").when(F.col("p") % 11 == 0, "fuzzy").otherwise("composite").alias("grain_type"),
                 F.when(F.col("p") % 3 == 0, none()).otherwise(F.array(F.lit("id"))).alias("keys"),
                 F.when(F.col("s") % 5 == 0, 1.2).otherwise(0.9).alias("confidence_score"))
    return only(rules.grain_rules().errors(g))


@query("v_scale_mappings", "with m as (select *, ordinal as position from fleet_columns)\n" + rules_sql("m", "mappings", [
    ("seed % 7 = 0", "'.target_kind must be one of: column, family'"), ("pick % 5 = 0", "'.mapping_status must be one of: codebook_confirmed, unresolved'"),
    ("seed % 4 = 0", "'.ordered_labels[1] must not be blank.'"), ("pick % 3 = 0", "'.label_to_numeric_score[hi] must be numeric.'")]), ("fleet_columns",))
def v_scale_mappings(tb):
    m = tb.input("fleet_columns").select(
        "run_id", F.col("ordinal").alias("position"), F.when(F.col("seed") % 7 == 0, "table").otherwise("column").alias("target_kind"),
        F.col("column_name").alias("target_id"), F.when(F.col("pick") % 5 == 0, "maybe").otherwise("unresolved").alias("mapping_status"),
        said().alias("response_scale_kind"), F.array(F.lit("lo"), F.when(F.col("seed") % 4 == 0, " ").otherwise("hi")).alias("ordered_labels"),
        F.create_map(F.lit("lo"), F.lit(1.0)).alias("label_to_ordinal_position"),
        F.create_map(F.lit("hi"), F.when(F.col("pick") % 3 != 0, 2.0)).alias("label_to_numeric_score"),
        F.lit(True).alias("numeric_score_semantics_confirmed"), said().alias("source"), said().alias("notes"), F.lit(0.5).alias("confidence"))
    return only(rules.scale_rules().errors(m))


@query("v_semantic_context", "with m as (select *, ordinal as position from fleet_columns)\n" + rules_sql("m", "important_variables", [
    ("seed % 3 = 0", f"'.kind must be one of: {listed(vocab.SEMANTIC_KINDS)}'"), ("pick % 4 = 0", "'.meaning must not be blank.'"),
    ("qty % 5 = 0", "'.confidence is required.'")])
    + "\nunion all " + rules_sql("m", "codebook_hints", [("seed % 5 = 0", "'.codes_or_labels_note is required.'")])
    + "\nunion all select run_id, 'reason must be one of: blank_semantic_input, light_contract_accepted' from (select distinct run_id from m) r where run_id % 4 = 0", ("fleet_columns",))
def v_semantic_context(tb):
    base = tb.input("fleet_columns").withColumn("position", F.col("ordinal"))
    v = base.select("run_id", "position", F.col("column_name").alias("column_or_family"), F.when(F.col("seed") % 3 == 0, "gossip").otherwise("other").alias("kind"),
                    F.when(F.col("pick") % 4 == 0, "").otherwise("m").alias("meaning"), said().alias("downstream_importance"), F.when(F.col("qty") % 5 != 0, 0.5).alias("confidence"))
    h = base.select("run_id", "position", F.col("column_name").alias("column"), F.when(F.col("seed") % 5 != 0, "n").alias("codes_or_labels_note"),
                    said().alias("meaning"), F.lit(0.5).alias("confidence"))
    runs = base.select("run_id").distinct().select("run_id", F.lit("skipped").alias("status"),
                                                   F.when(F.col("run_id") % 4 == 0, "tired").otherwise("blank_semantic_input").alias("reason"))
    return only(rules.semantic_rules().errors(v)).unionByName(only(rules.codebook_rules().errors(h))).unionByName(
        rules.skip_sentinel(runs, vocab.SEMANTIC_SKIP_REASONS))


@query("v_patch_rules", f"""
with {c.PATCHES}, {c.SMALL},
k as (select p.*, s.column_name is not null as known from patches p left join small s on p.run_id = s.run_id and p.column_name = s.column_name)
{rules_sql("k", "change_set", [
    ("field = 'type_decision_source'", "'.field points to a forbidden field: ' || field"),
    ("not known and field <> 'type_decision_source'", "'.column does not exist in canon_contract_json: ' || column_name"),
    ("known and field = 'semantic_meaning' and after_value = 'null'", "'.after_value must be a string.'")])}
""", ("fleet_columns",))
def v_patch_rules(tb):
    known = c.small_contract(tb).select("run_id", "column", F.lit(True).alias("known"))
    rows = c.patch_rows(tb).join(known, ["run_id", "column"], "left").withColumn("known_column", F.coalesce("known", F.lit(False)))
    return only(rules.patch_rules().errors(rows))


@query("v_duplicates", f"""
with {c.PATCHES},
ids as (select run_id, 'Duplicate change_set.change_id: ' || change_id as message from patches group by run_id, change_id having count(*) > 1),
pairs as (select run_id, 'Duplicate change_set column/field pair: ' || column_name || '.' || field as message from patches group by run_id, column_name, field having count(*) > 1)
select * from ids union all select * from pairs
union all select l_orderkey, 'Duplicate column_decisions entry for column: Q' || cast(l_linenumber as varchar) from lineitem group by l_orderkey, l_linenumber having count(*) > 1
""", ("fleet_columns",))
def v_duplicates(tb):
    rows = c.patch_rows(tb)
    lines = tb.table("lineitem").selectExpr("l_orderkey as run_id", "concat('Q', l_linenumber) as column")
    return rules.duplicates(rows, ["change_id"], "Duplicate change_set.change_id: ").unionByName(
        rules.duplicates(rows, ["column", "field"], "Duplicate change_set column/field pair: ")).unionByName(
        rules.duplicates(lines, ["column"], "Duplicate column_decisions entry for column: "))


@query("v_coverage", """
with miss as (select c.run_id, c.column_name from fleet_columns c where not exists (select 1 from fleet_type t where t.run_id = c.run_id and t.column_name = c.column_name)),
extra as (select t.run_id, t.column_name from fleet_type t where not exists (select 1 from fleet_columns c where t.run_id = c.run_id and t.column_name = c.column_name))
select run_id, 'column_decisions is missing reviewed columns: ' || string_agg(column_name, ', ' order by column_name) as message from miss group by run_id
union all select run_id, 'column_decisions contains unexpected columns: ' || string_agg(column_name, ', ' order by column_name) from extra group by run_id
""", ("fleet_columns", "fleet_type"))
def v_coverage(tb):
    return rules.coverage(c.col(tb.input("fleet_type")), c.col(tb.input("fleet_columns")),
                          "column_decisions is missing reviewed columns: ", "column_decisions contains unexpected columns: ")


@query("v_unexpected_keys", """
select event_id as run_id, 'change_set[' || cast(user_id as varchar) || '] has unexpected key(s): k' as message from events
""")
def v_unexpected_keys(tb):
    rows = tb.table("events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("position"), "props")
    return only(rules.unexpected_keys(rows, "props", ["change_id", "column"], F.format_string("change_set[%d]", "position")))


@query("v_document_errors", """
with d as (select event_id as run_id, case when event_id % 7 = 0 then null when event_id % 7 = 1 then '  ' when event_id % 7 = 2 then props || 'x' when event_id % 7 = 3 then '[' || props || ']' else props end as raw from events)
select run_id, case when raw is null then 'reviewer_output must be a string.' when trim(raw) = '' then 'reviewer_output is empty.' when raw like '%x' then 'reviewer_output is not valid JSON'
 else 'reviewer_output root must be an object.' end as message from d where raw is null or trim(raw) = '' or raw like '%x' or raw like '[%'
""")
def v_document_errors(tb):
    raw = "case event_id % 7 when 0 then null when 1 then '  ' when 2 then props || 'x' when 3 then '[' || props || ']' else props end as raw"
    return rules.document_errors(tb.table("events").selectExpr("event_id as run_id", raw), "raw", "reviewer_output")


@query("v_json_numbers", """
select event_id, case when event_id % 4 = 0 then null else cast(json_extract_string(props, '$.k') as double) end as k,
 event_id % 4 <> 0 and cast(json_extract_string(props, '$.k') as double) between 0 and 50 as in_range from events
""")
def v_json_numbers(tb):
    raw = F.when(F.col("event_id") % 4 == 0, "true").otherwise(F.get_json_object("props", "$.k"))
    k = cells.json_number(raw)
    return tb.table("events").select("event_id", k.alias("k"), F.coalesce(k.between(0, 50), F.lit(False)).alias("in_range"))


@query("v_default_fill", """
with d as (select *, case when seed % 3 <> 0 then 'fam' end as fam, case when pick % 4 <> 0 then 'x' end as preview from fleet_columns)
select run_id, 'column_contracts[' || cast(ordinal as varchar) || '].source_family_id' as path, '""' as defaulted_to from d where fam is null
union all select run_id, 'column_contracts[' || cast(ordinal as varchar) || '].applied_sources', '[]' from d where preview is null
""", ("fleet_columns",))
def v_default_fill(tb):
    rows = tb.input("fleet_columns").select(
        "run_id", F.col("ordinal").alias("position"), F.when(F.col("seed") % 3 != 0, "fam").alias("source_family_id"),
        F.when(F.col("pick") % 4 != 0, F.array(F.lit("x"))).alias("applied_sources"))
    return rules.fill_defaults(rows, {"source_family_id": '""', "applied_sources": "[]"}, "column_contracts")[1]


_ORDERED = "\nunion all ".join(
    f"select run_id, position, {i} as rule, 'column_decisions[' || cast(position as varchar) || ']' || {tail} as message from bad_types where {cond}"
    for i, (cond, tail) in enumerate(TYPE_PAIRS))


@query("v_report", f"""
with e as ({_ORDERED}),
r as (select run_id, message, row_number() over (partition by run_id order by position, rule) as rn, count(*) over (partition by run_id) as n from e)
select t.run_id, r.message is null as validation_ok, coalesce(r.message, '') as validation_error, coalesce(r.n, 0) as n_errors
from (select distinct run_id from fleet_columns) t left join r on t.run_id = r.run_id and r.rn = 1
""", ("fleet_columns", "bad_types"))
def v_report(tb):
    rows = bad_types(tb)
    errors = rules.type_rules().errors(rows).withColumn("place", F.struct("position", "rule"))
    return rules.report(rows, errors)


@query("v_source_contract_gate", f"""
with {c.PATCHES}, {c.SMALL}, bad as (select distinct run_id from small where conf > 0.8 or conf = 0.5 or (conf = 0.3 and ih = '[]') or (status = 'unresolved' and column_name like 'Q%'))
select run_id, count(*) as n_patches from patches where run_id not in (select run_id from bad) group by run_id
""", ("fleet_columns",))
def v_source_contract_gate(tb):
    errors = rules.contract_rules().errors(contract_rows(tb))
    return rules.gate(errors, c.patch_rows(tb)).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_patches"))


_DOC_ORDERED = "\nunion all ".join(
    f"select run_id, position, {i} as rule, 'column_decisions[' || cast(position as varchar) || ']' || {tail} as message from placed where {cond}"
    for i, (cond, tail) in enumerate(TYPE_PAIRS))


@query("v_documents_report", f"""
with placed as (select * replace (row_number() over (partition by run_id order by position) - 1 as position) from bad_types),
e as ({_DOC_ORDERED}),
agg as (select run_id, count(*) as n from e group by run_id)
select t.run_id, a.run_id is null as validation_ok, coalesce(a.n, 0) as n_errors
from (select distinct run_id from fleet_columns) t left join agg a on t.run_id = a.run_id
""", ("fleet_columns", "bad_types"))
def v_documents_report(tb):
    """The same decisions as one JSON document per run, parsed and judged as documents."""
    item = F.struct("position", F.struct("column", "recommended_logical_type", "recommended_storage_type", "transform_actions", "normalization_notes",
                                         "confidence", "reasoning", "skip_logic_protected", "needs_human_review").alias("d"))
    docs = bad_types(tb).groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["d"]).alias("column_decisions"))
    raw = F.to_json(F.struct(F.lit("type_value_specialist").alias("worker"), F.struct(F.lit("ok").alias("overview")).alias("summary"), "column_decisions"))
    return validate("type_transform_worker", docs.select("run_id", raw.alias("raw")))["report"].drop("validation_error")
