"""Scale, contract and patch queries over a fleet of runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablesight.catalog.registry import query
from tablesight.operators import contract, patch, profile, scale
from tablesight.plans.shared import cut

STRUCTURAL = "('structurally_valid_missingness', 'partially_structural_missingness')"


def col(df):
    return df.withColumnRenamed("column_name", "column")


def words(df, *names):
    return df.withColumns({n: F.when(F.col(n) == "", F.array().cast("array<string>")).otherwise(F.split(n, ",")) for n in names})


def joined(df, *names):
    return df.withColumns({n: F.array_join(n, ",") for n in names})


# ---- missingness normaliser and invariants ----

_NORM = f"""
s1 as (select *, missingness_decision_source = 'family_default' and coalesce(missingness_disposition not in {STRUCTURAL}, true) and has_base as n1 from fleet_decisions),
a1 as (select run_id, ordinal, column_name, token_flag, has_base, base_disposition, base_handling, base_source, n1,
  case when n1 then base_disposition else missingness_disposition end as d, case when n1 then base_handling else missingness_handling end as h,
  case when n1 then base_source else missingness_decision_source end as s, case when n1 then false else skip_logic_protected end as k from s1),
s2 as (select *, coalesce(s = 'family_default' and not token_flag and d = 'token_missingness_present' and has_base and base_disposition <> 'token_missingness_present', false) as n2 from a1),
a2 as (select * replace (case when n2 then base_disposition else d end as d, case when n2 then base_handling else h end as h, case when n2 then base_source else s end as s, case when n2 then false else k end as k) from s2),
a3 as (select * replace (case when d = 'no_material_missingness' then 'no_action_needed' else h end as h), coalesce(d = 'no_material_missingness' and h <> 'no_action_needed', false) as n3 from a2),
a4 as (select * replace (case when d = 'no_material_missingness' then false else k end as k), coalesce(d = 'no_material_missingness', false) and coalesce(k, true) as n4 from a3),
a5 as (select * replace (case when h = 'protect_from_null_penalty' then true else k end as k), h = 'protect_from_null_penalty' and not coalesce(k, false) as n5 from a4)
"""


def decisions(tb):
    base = F.when(F.col("has_base"), F.struct(
        F.col("base_disposition").alias("missingness_disposition"), F.col("base_handling").alias("missingness_handling"),
        F.col("base_source").alias("missingness_decision_source"), F.lit(False).alias("skip_logic_protected")))
    return words(col(tb.input("fleet_decisions")).withColumn("base", base), "structural_transform_hints")


@query("c_missingness_normalize", f"""
with {_NORM}
select run_id, column_name as "column", d as missingness_disposition, h as missingness_handling, s as missingness_decision_source, k as skip_logic_protected,
 concat_ws(',', case when n1 then 'reverted_invalid_family_default_missingness' end, case when n2 then 'reverted_token_missingness_without_global_support' end,
  case when n3 then 'coerced_missingness_handling_to_single_allowed_value' end, case when n4 then 'cleared_skip_logic_for_no_material_missingness' end,
  case when n5 then 'forced_skip_logic_for_protect_from_null_penalty' end) as notes
from a5
""", ("fleet_columns", "fleet_decisions"))
def c_missingness_normalize(tb):
    out = contract.normalize_missingness(decisions(tb))
    return out.select("run_id", "column", *contract.MISSINGNESS, F.array_join("normalization_notes_list", ",").alias("notes"))


INVARIANTS = f"""
rules as (
 select run_id, column_name, 0 as rule, 'row.structural_transform_hints must not contain ' || hint || ' when canonical_modeling_status is child_repeat_member' as message
 from (select *, unnest(string_split(structural_transform_hints, ',')) as hint from fleet_decisions where canonical_modeling_status = 'child_repeat_member') u
 where hint in ('requires_child_table_review', 'requires_wide_to_long_review')
 union all select run_id, column_name, 1, 'row.missingness_handling must be one of ' || case missingness_disposition when 'no_material_missingness' then '[''no_action_needed'']'
   when 'structurally_valid_missingness' then '[''protect_from_null_penalty'', ''retain_with_caution'']' when 'unexplained_high_missingness' then '[''candidate_drop_review'', ''review_before_drop'']'
   else '[''retain_with_caution'', ''review_before_drop'']' end || ' when missingness_disposition is ' || missingness_disposition
  from fleet_decisions where missingness_handling not in (select unnest(case missingness_disposition when 'no_material_missingness' then ['no_action_needed']
   when 'structurally_valid_missingness' then ['protect_from_null_penalty', 'retain_with_caution'] when 'unexplained_high_missingness' then ['candidate_drop_review', 'review_before_drop']
   else ['retain_with_caution', 'review_before_drop'] end)) and missingness_disposition is not null
 union all select run_id, column_name, 2, 'row.skip_logic_protected must be true when missingness_handling is protect_from_null_penalty' from fleet_decisions where missingness_handling = 'protect_from_null_penalty' and not coalesce(skip_logic_protected, false)
 union all select run_id, column_name, 3, 'row.skip_logic_protected can only be true for structurally_valid_missingness or partially_structural_missingness' from fleet_decisions where skip_logic_protected and not coalesce(missingness_disposition in {STRUCTURAL}, false)
 union all select run_id, column_name, 4, 'row.missingness_disposition must not be token_missingness_present when global_contract.token_missing_placeholders_detected is false' from fleet_decisions where not token_flag and missingness_disposition = 'token_missingness_present'
 union all select run_id, column_name, 5, 'row.missingness_decision_source may not be family_default for non-structural missingness_disposition ' || coalesce(missingness_disposition, 'None') from fleet_decisions where missingness_decision_source = 'family_default' and not coalesce(missingness_disposition in {STRUCTURAL}, false))
"""


@query("v_contract_invariants", f"with {INVARIANTS} select run_id, column_name as \"column\", message from rules", ("fleet_columns", "fleet_decisions"))
def v_contract_invariants(tb):
    errors = contract.row_invariant_errors(F.lit("row"), F.col("token_flag"))
    return decisions(tb).select("run_id", "column", F.explode(errors).alias("message"))


# ---- synthesis ----

def synthesized(tb, scales=None):
    typed = words(col(tb.input("fleet_type")), "transform_actions", "structural_transform_hints", "interpretation_hints")
    none = F.array().cast("array<string>")
    defaults = tb.input("fleet_defaults").withColumns({
        "transform_actions": F.array(F.lit("trim_whitespace")), "structural_transform_hints": none, "interpretation_hints": none,
        "confidence": F.lit(0.88), "needs_human_review": F.lit(False)})
    a17 = col(tb.input("fleet_a17")).withColumns({
        "a9_primary_role": F.lit("measure"), "transform_actions": F.array(F.lit("trim_whitespace")), "structural_transform_hints": none,
        "interpretation_hints": none, "confidence": F.lit(0.71), "type_review_required": F.lit(False), "missingness_review_required": F.lit(False)})
    a2 = col(tb.input("fleet_columns"))
    return contract.synthesize(
        a2.select("run_id", "column", "ordinal"), a17, layout=col(tb.input("fleet_layout")), members=col(tb.input("fleet_members")),
        family_decisions=tb.input("fleet_members").select("run_id", "family_id", F.lit("accept").alias("status"),
                                                          F.concat("family_id", F.lit("_long")).alias("table_name")).distinct(),
        family_defaults=defaults, grain_keys=a2.filter("column = 'RespondentId'").select("run_id", "column"),
        type_decisions=typed,
        missingness_decisions=col(tb.input("fleet_missing")).drop("structural_validity"),
        token_flags=a2.select("run_id", (F.col("run_id") % 3 == 0).alias("token_missing_placeholders_detected")).distinct(),
        codebook=a2.filter("column = 'Status'").select("run_id", "column", F.lit("1 = active").alias("codes_or_labels_note"), F.lit("Status code").alias("meaning")),
        scales=scales)


FLEET = ("fleet_columns", "fleet_members", "fleet_type", "fleet_missing", "fleet_layout", "fleet_defaults", "fleet_a17")
CONTRACT = f"""
names as (select run_id, column_name from fleet_columns union select run_id, column_name from fleet_type union select run_id, column_name from fleet_missing),
j as (select n.run_id, n.column_name, c.ordinal, c.column_name is not null as in_a2, l.assigned_table, l.assignment_role, m.family_id,
   t.column_name is not null as has_t, t.recommended_logical_type as t_l, t.recommended_storage_type as t_s, t.structural_transform_hints as t_h, t.interpretation_hints as t_i,
   x.column_name is not null as has_x, x.missingness_disposition as x_d, x.recommended_handling as x_h, x.skip_logic_protected as x_k,
   f.family_id is not null as has_f, f.missingness_disposition as f_d, f.missingness_handling as f_h, f.skip_logic_protected as f_k,
   a.column_name is not null as has_a, a.recommended_logical_type as a_l, a.recommended_storage_type as a_s, a.missingness_disposition as a_d, a.missingness_handling as a_h, a.skip_logic_protected as a_k,
   n.run_id % 3 = 0 as flag
  from names n left join fleet_columns c on n.run_id = c.run_id and n.column_name = c.column_name
  left join fleet_layout l on n.run_id = l.run_id and n.column_name = l.column_name
  left join fleet_members m on n.run_id = m.run_id and n.column_name = m.column_name
  left join fleet_type t on n.run_id = t.run_id and n.column_name = t.column_name
  left join fleet_missing x on n.run_id = x.run_id and n.column_name = x.column_name
  left join fleet_defaults f on m.run_id = f.run_id and m.family_id = f.family_id
  left join fleet_a17 a on n.run_id = a.run_id and n.column_name = a.column_name),
r as (select *, case when assignment_role is not null then assignment_role when column_name = 'RespondentId' then 'base_key' when family_id is not null then 'melt_member' else 'unresolved' end as role,
   case when assignment_role is not null then assigned_table when column_name = 'RespondentId' then 'base_table' when family_id is not null then family_id || '_long' else '' end as tbl,
   case when has_t then 'reviewed_type_worker' when has_f then 'family_default' when has_a then 'a17_baseline' else 'unresolved_no_a2_evidence' end as ts,
   case when has_x then 'reviewed_missingness_worker' when f_d in {STRUCTURAL} then 'family_default' when has_a then 'a17_baseline' else 'unresolved_no_a2_evidence' end as ms from j),
v as (select *, case ts when 'reviewed_type_worker' then t_l when 'family_default' then 'ordinal_category' when 'a17_baseline' then a_l else 'mixed_or_ambiguous' end as lt,
   case ts when 'reviewed_type_worker' then t_s when 'family_default' then 'string' when 'a17_baseline' then a_s else 'string' end as st,
   case ms when 'reviewed_missingness_worker' then x_d when 'family_default' then f_d when 'a17_baseline' then a_d else 'no_material_missingness' end as d,
   case ms when 'reviewed_missingness_worker' then x_h when 'family_default' then f_h when 'a17_baseline' then a_h else 'no_action_needed' end as h0,
   case ms when 'reviewed_missingness_worker' then x_k when 'family_default' then f_k when 'a17_baseline' then a_k else false end as k0 from r),
w as (select *, case when d = 'no_material_missingness' then 'no_action_needed' else h0 end as h, case when d = 'no_material_missingness' then false when h0 = 'protect_from_null_penalty' then true else k0 end as k from v),
contract as (select run_id, column_name, ordinal, in_a2,
   case role when 'exclude_from_outputs' then 'excluded_from_outputs' when 'unresolved' then 'unresolved' when 'melt_member' then 'child_repeat_member' else 'base_field' end as status,
   tbl, role, coalesce(family_id, '') as fam, lt, st, ts, ms, d, h, k, has_t, t_h, t_i, assignment_role is not null as has_l, column_name = 'Status' as coded from w)
"""


@query("c_contract_synthesis", f"""
with {CONTRACT}
select run_id, column_name as "column", status as canonical_modeling_status, tbl as canonical_table_name, role as canonical_assignment_role, fam as source_family_id,
 lt as recommended_logical_type, st as recommended_storage_type, ts as type_decision_source,
 case when has_l then 'table_layout_worker' when role <> 'unresolved' then 'light_contract_fallback' else 'unresolved' end as structure_decision_source,
 d as missingness_disposition, h as missingness_handling, k as skip_logic_protected, ms as missingness_decision_source,
 case when coded then 'semantic_context_worker' else 'unknown' end as semantic_decision_source, case when coded then '1 = active' else '' end as codebook_note,
 case when not has_t then '' when status = 'child_repeat_member' and t_h like 'requires_child%' then 'split_multiselect_tokens' else t_h end as structural_transform_hints,
 case when has_t and t_i <> 'skip_logic_protected' then t_i || case when k then ',skip_logic_protected' else '' end when k then 'skip_logic_protected' else '' end as interpretation_hints,
 concat_ws(',', case when has_l then 'table_layout_worker' end, case when not has_l and role <> 'unresolved' then 'light_contract' end, case when coded then 'semantic_context_worker' end,
  case when ts = 'family_default' or ms = 'family_default' then 'family_worker.member_defaults' end, case when has_t then 'type_transform_worker' end,
  case when ms = 'reviewed_missingness_worker' then 'missingness_worker' end, case when ts = 'a17_baseline' or ms = 'a17_baseline' then 'A17' end) as applied_sources
from contract
""", FLEET)
def c_contract_synthesis(tb):
    out = synthesized(tb).select(
        "run_id", "column", "canonical_modeling_status", "canonical_table_name", "canonical_assignment_role", "source_family_id",
        "recommended_logical_type", "recommended_storage_type", "type_decision_source", "structure_decision_source",
        "missingness_disposition", "missingness_handling", "skip_logic_protected", "missingness_decision_source",
        "semantic_decision_source", "codebook_note", "structural_transform_hints", "interpretation_hints", "applied_sources")
    return joined(out, "structural_transform_hints", "interpretation_hints", "applied_sources")


@query("c_contract_with_scales", f"""
with {CONTRACT},
confirmed as (select * from fleet_scales where mapping_status <> 'deterministic_inferred'),
k as (select v.*, coalesce(c.response_scale_kind, f.response_scale_kind) as kind from v
  left join confirmed c on c.target_kind = 'column' and c.run_id = v.run_id and c.target_id = v.column_name
  left join confirmed f on f.target_kind = 'family' and f.run_id = v.run_id and f.target_id = v.family_id),
z as (select *, not has_t and kind is not null as scaled from k)
select run_id, column_name as "column", case when scaled then 'ordinal_category' else lt end as recommended_logical_type, case when scaled then 'string' else st end as recommended_storage_type,
 case when scaled then 'trim_whitespace,normalize_category_tokens' when ts = 'unresolved_no_a2_evidence' then '' when ts = 'reviewed_type_worker' and column_name = 'GhostCol' then '' else 'trim_whitespace' end as transform_actions,
 case when scaled then 'scale_mapping_resolver' else ts end as type_decision_source, column_name = 'Status' as coded,
 concat_ws(' ', case when column_name = 'Status' then '1 = active' end, case when kind is not null then 'Confirmed scale mapping (' || kind || '). Ordered labels: Low | High.' end) as codebook_note,
 case when column_name = 'Status' then 'semantic_context_worker' when kind is not null then 'scale_mapping_resolver' else 'unknown' end as semantic_decision_source
from z
""", (*FLEET, "fleet_scales"))
def c_contract_with_scales(tb):
    scales = tb.input("fleet_scales").withColumn("ordered_labels", F.array(F.lit("Low"), F.lit("High")))
    out = synthesized(tb, scales).select("run_id", "column", "recommended_logical_type", "recommended_storage_type", "transform_actions", "type_decision_source",
                                         (F.col("column") == "Status").alias("coded"), "codebook_note", "semantic_decision_source")
    return joined(out, "transform_actions")


COUNTS = """count(*) as total_source_columns, count(case when {s} not in ('excluded_from_outputs', 'unresolved') then 1 end) as included_column_count,
 count(case when {s} = 'excluded_from_outputs' then 1 end) as excluded_column_count, count(case when {s} = 'unresolved' then 1 end) as unresolved_column_count,
 count(case when ts = 'reviewed_type_worker' or ms = 'reviewed_missingness_worker' then 1 end) as reviewed_override_count,
 count(case when ts = 'family_default' or ms = 'family_default' then 1 end) as family_default_count,
 count(case when ts = 'a17_baseline' and ms = 'a17_baseline' then 1 end) as deterministic_baseline_count,
 count(case when ts = 'reviewed_type_worker' then 1 end) as reviewed_type_count, count(case when ts <> 'reviewed_type_worker' then 1 end) as fallback_type_count"""


@query("c_summary_counts", f"with {CONTRACT} select run_id, {COUNTS.replace('{s}', 'status')} from contract group by run_id", FLEET)
def c_summary_counts(tb):
    return contract.summary_counts(synthesized(tb))


@query("c_review_flags", f"""
with {CONTRACT}
select run_id, column_name as item, 'reviewed_column_not_in_a2' as issue from contract where not in_a2
union all select run_id, 'column_contracts', 'high_deterministic_baseline_share' from contract group by run_id
having cast(count(case when ts = 'a17_baseline' and ms = 'a17_baseline' then 1 end) as double) / count(*) >= 0.4
""", FLEET)
def c_review_flags(tb):
    return contract.review_flags(synthesized(tb)).drop("why")


@query("c_row_order", f"""
with {CONTRACT} select run_id, column_name as "column", cast(row_number() over (partition by run_id order by not in_a2, ordinal, column_name) - 1 as integer) as ordinal from contract
""", FLEET)
def c_row_order(tb):
    return contract.ordered(synthesized(tb)).select("run_id", "column", "ordinal")


# ---- patches ----

PATCHES = """
patches as (
 select run_id, cast(ordinal as bigint) as position, 'chg' || cast(seed % 3 as varchar) || case when pick % 5 = 0 then '_1' else '' end as change_id, column_name,
  case qty % 6 when 0 then 'recommended_logical_type' when 1 then 'confidence' when 2 then 'needs_human_review' when 3 then 'semantic_meaning' when 4 then 'interpretation_hints' else 'type_decision_source' end as field,
  case qty % 6 when 0 then '"free_text"' when 1 then '0.' || cast(seed % 10 as varchar) when 2 then 'true' when 3 then case when pick % 3 = 0 then 'null' else '"Meaning ' || cast(pick as varchar) || '"' end
   when 4 then '["code_not_quantity"' || case when pick % 2 = 0 then ',"skip_logic_protected"' else '' end || ']' else '"a17_baseline"' end as after_value
 from fleet_columns where seed % 2 = 0
 union all select run_id, cast(1000 + ordinal as bigint), 'ghost', 'Nope', 'confidence', '0.5' from fleet_columns where seed % 50 = 0
 union all select run_id, cast(2000 + ordinal as bigint), 'drop', column_name, 'canonical_modeling_status', '"excluded_from_outputs"' from fleet_columns where seed % 9 = 0)
"""


def patch_rows(tb):
    """The patches, each branch of their text a possible row of one reading of the columns, so that these stay where they lie."""
    import re

    text = re.sub(r"^\s*patches as \((.*)\)\s*$", r"\1", PATCHES, flags=re.S).replace("as varchar)", "as string)")
    branches = re.findall(r"select run_id, (.*?) from fleet_columns where (.*?)\s*(?=union all|$)", text, flags=re.S)
    kind = "struct<position: bigint, change_id: string, column: string, field: string, after_value: string>"
    rows = ", ".join(f"case when {cond} then cast(struct({values}) as {kind}) end" for values, cond in branches)
    # JSON text holds double quotes, so this input skips the identifier-quote translation
    frame = tb.spark.sql(f"select run_id, inline(array_compact(array({rows}))) from {{fleet_columns}}", fleet_columns=tb.input("fleet_columns"))
    return frame.withColumns({
        "reasoning": F.lit("r"), "justification": F.lit("j"), "confidence": F.lit(0.9), "needs_human_review": F.lit(False)})


def small_contract(tb):
    """A contract whose fields depend on the line items alone, for the patch jobs."""
    empty = F.array().cast("array<string>")
    rows = col(tb.input("fleet_columns"))
    order = F.row_number().over(Window.partitionBy("run_id").orderBy("ordinal")) - 1
    return rows.select(
        "run_id", "column", order.alias("ordinal"), F.lit(True).alias("in_a2"),
        F.when(F.col("pick") % 3 == 0, "unresolved").otherwise("base_field").alias("canonical_modeling_status"),
        F.when(F.col("pick") % 3 == 0, "").otherwise("base_rows").alias("canonical_table_name"),
        F.when(F.col("pick") % 3 == 0, "unresolved").otherwise("base_attribute").alias("canonical_assignment_role"),
        F.lit("").alias("source_family_id"),
        F.when(F.col("seed") % 4 == 0, "free_text").otherwise("identifier").alias("recommended_logical_type"),
        F.lit("string").alias("recommended_storage_type"), empty.alias("transform_actions"), empty.alias("structural_transform_hints"),
        F.when(F.col("pick") % 4 == 0, F.array(F.lit("code_not_quantity"), F.lit("skip_logic_protected"))).otherwise(empty).alias("interpretation_hints"),
        F.when(F.col("pick") % 4 == 0, "structurally_valid_missingness").otherwise("no_material_missingness").alias("missingness_disposition"),
        F.when(F.col("pick") % 4 == 0, "retain_with_caution").otherwise("no_action_needed").alias("missingness_handling"),
        (F.col("pick") % 4 == 0).alias("skip_logic_protected"), F.lit("").alias("semantic_meaning"), F.lit("").alias("codebook_note"),
        F.lit("").alias("normalization_notes"), (F.col("seed") % 10 / 10.0).cast("double").alias("confidence"), F.lit(False).alias("needs_human_review"),
        F.when(F.col("qty") % 3 == 0, "reviewed_type_worker").otherwise("a17_baseline").alias("type_decision_source"),
        F.lit("table_layout_worker").alias("structure_decision_source"), F.lit("a17_baseline").alias("missingness_decision_source"),
        F.lit("unknown").alias("semantic_decision_source"), F.array(F.lit("A17")).alias("applied_sources"))


SMALL = """
small as (select run_id, column_name, cast(row_number() over (partition by run_id order by ordinal) - 1 as integer) as ordinal,
 case when pick % 3 = 0 then 'unresolved' else 'base_field' end as status, case when seed % 4 = 0 then 'free_text' else 'identifier' end as lt,
 case when pick % 4 = 0 then '["code_not_quantity","skip_logic_protected"]' else '[]' end as ih, cast(seed % 10 as double) / 10 as conf,
 case when qty % 3 = 0 then 'reviewed_type_worker' else 'a17_baseline' end as ts, 'a17_baseline' as ms from fleet_columns)
"""
_STRICT = "('recommended_logical_type', 'confidence', 'needs_human_review', 'semantic_meaning', 'interpretation_hints', 'canonical_modeling_status')"
_REJECT = f"""
chk as (select p.*, s.column_name is not null as known, p.field = 'interpretation_hints' and (coalesce(s.ih, '') like '%skip_logic_protected%') <> (p.after_value like '%skip_logic_protected%') as moved
  from patches p left join small s on p.run_id = s.run_id and p.column_name = s.column_name),
good as (select * from chk where known and field in {_STRICT} and not moved)
"""


def good_patches(rows, base):
    bad = patch.rejected(rows, base).select("run_id", "position")
    return rows.join(bad, ["run_id", "position"], "left_anti")


def dealt_patches(tb):
    """Patches that can be applied and the contract, dealt by run, and what keeps other frames of runs beside them."""
    keep = tb.by_run()
    base = keep(small_contract(tb), "base")
    return keep(good_patches(patch_rows(tb), base), "patches"), base, keep


@query("c_patch_reject", f"""
with {PATCHES}, {SMALL}, {_REJECT}
select run_id, position, 'change_set[' || cast(position as varchar) || ']' || case when not known then '.column must resolve against canon_contract_json.column_contracts.'
 when field not in {_STRICT} then '.field points to a forbidden field: ' || field
 else '.field cannot add or remove skip_logic_protected in interpretation_hints because that bookkeeping is code-owned.' end as message
from chk where not known or field not in {_STRICT} or moved
""", ("fleet_columns",))
def c_patch_reject(tb):
    return patch.rejected(patch_rows(tb), small_contract(tb))


_APPLY = """
last as (select run_id, column_name, field, arg_max(after_value, position) as v from good group by all),
wide as (select run_id, column_name, max(case when field = 'recommended_logical_type' then v end) as v_lt, max(case when field = 'confidence' then v end) as v_c,
  max(case when field = 'needs_human_review' then v end) as v_r, max(case when field = 'semantic_meaning' then v end) as v_m, max(case when field = 'interpretation_hints' then v end) as v_i,
  max(case when field = 'canonical_modeling_status' then v end) as v_s from last group by all),
after as (select s.run_id, s.column_name, s.ordinal, case when v_s is null then status else 'excluded_from_outputs' end as status, case when v_lt is null then lt else 'free_text' end as lt,
  case when v_c is null then conf else cast(v_c as double) end as conf, v_r is not null as review, case when v_m is null then '' when v_m = 'null' then null else trim(v_m, '"') end as meaning,
  coalesce(v_i, ih) as ih, ts, ms from small s left join wide w on s.run_id = w.run_id and s.column_name = w.column_name)
"""


@query("c_patch_apply", f"""
with {PATCHES}, {SMALL}, {_REJECT}, {_APPLY}
select run_id, column_name as "column", ordinal, status as canonical_modeling_status, lt as recommended_logical_type, conf as confidence, review as needs_human_review, meaning as semantic_meaning, ih as interpretation_hints from after
""", ("fleet_columns",))
def c_patch_apply(tb):
    rows, base = patch_rows(tb), cut(small_contract(tb))
    out = patch.apply(base, cut(good_patches(rows, base)))
    return out.select("run_id", "column", "ordinal", "canonical_modeling_status", "recommended_logical_type", "confidence", "needs_human_review",
                      "semantic_meaning", F.to_json("interpretation_hints").alias("interpretation_hints"))


@query("c_noop_removal", f"""
with {PATCHES}, {SMALL}
select p.run_id, 'change_set[' || cast(position as varchar) || ']' as path, '{{"removed":"no_op_change_entry"}}' as defaulted_to
from patches p join small s on p.run_id = s.run_id and p.column_name = s.column_name
where (field = 'recommended_logical_type' and lt = 'free_text') or (field = 'confidence' and cast(after_value as double) = conf)
 or (field = 'interpretation_hints' and after_value = ih)
""", ("fleet_columns",))
def c_noop_removal(tb):
    return patch.split_noops(patch_rows(tb), small_contract(tb))[1]


_LOG = f"""
old_c as (select run_id, {COUNTS.replace('{s}', 'status')} from small group by run_id),
new_c as (select run_id, {COUNTS.replace('{s}', 'status')} from after group by run_id),
sys as (select o.run_id, 'included_column_count' as key, o.included_column_count as a, n.included_column_count as b from old_c o join new_c n on o.run_id = n.run_id
 union all select o.run_id, 'excluded_column_count', o.excluded_column_count, n.excluded_column_count from old_c o join new_c n on o.run_id = n.run_id
 union all select o.run_id, 'unresolved_column_count', o.unresolved_column_count, n.unresolved_column_count from old_c o join new_c n on o.run_id = n.run_id)
"""


@query("c_change_log", f"""
with {PATCHES}, {SMALL}, {_REJECT}, {_APPLY}, {_LOG}
select g.run_id, g.column_name as "column", '/reviewed_contract/column_contracts/' || cast(s.ordinal as varchar) || '/' || field as target_path,
 case field when 'recommended_logical_type' then '"' || s.lt || '"' when 'confidence' then cast(s.conf as varchar) when 'needs_human_review' then 'false' when 'semantic_meaning' then '""'
  when 'interpretation_hints' then s.ih else '"' || s.status || '"' end as before_value,
 case field when 'recommended_logical_type' then '"' || a.lt || '"' when 'confidence' then cast(a.conf as varchar) when 'needs_human_review' then 'true'
  when 'semantic_meaning' then case when a.meaning is null then 'null' else '"' || a.meaning || '"' end when 'interpretation_hints' then a.ih else '"' || a.status || '"' end as after_value,
 cast(0.9 as double) as confidence
from good g join small s on g.run_id = s.run_id and g.column_name = s.column_name join after a on g.run_id = a.run_id and g.column_name = a.column_name
union all select run_id, '', '/reviewed_contract/summary/' || key, cast(a as varchar), cast(b as varchar), cast(1.0 as double) from sys where a <> b
""", ("fleet_columns",))
def c_change_log(tb):
    rows, base, keep = dealt_patches(tb)
    log = patch.change_log(rows, base, keep(patch.apply(base, rows), "contract"), keep=keep)
    return log.select("run_id", "column", "target_path", "before_value", "after_value", "confidence")


@query("c_unique_change_ids", f"""
with recursive {PATCHES},
ordered as materialized (select run_id, position, change_id, row_number() over (partition by run_id order by position) as i from patches),
walk as (
 select run_id, cast(0 as bigint) as i, cast([] as varchar[]) as seen, cast(null as bigint) as position, cast(null as varchar) as unique_id from (select distinct run_id from ordered)
 union all
 select run_id, i, list_append(seen, name), position, name from (
  select o.run_id, o.i, w.seen, o.position, case when list_contains(w.seen, o.change_id) then o.change_id || '_' ||
    list_min(list_filter(range(1, len(w.seen) + 2), lambda k: not list_contains(w.seen, o.change_id || '_' || k))) else o.change_id end as name
  from walk w join ordered o on o.run_id = w.run_id and o.i = w.i + 1))
select run_id, position, unique_id from walk where i > 0
""", ("fleet_columns",))
def c_unique_change_ids(tb):
    return patch.unique_ids(patch_rows(tb).select("run_id", "position", "change_id")).select("run_id", "position", "unique_id")


@query("c_review_summary", f"""
with {PATCHES}, {SMALL}, {_REJECT}, {_APPLY}, {_LOG},
log as (select run_id, column_name from good union all select run_id, '' from sys where a <> b),
agg as (select run_id, count(*) as n, count(distinct case when column_name <> '' then column_name end) as c from log group by run_id)
select o.run_id, 'Post-review canonical column contract for ' || cast(o.total_source_columns as varchar) || ' columns. Deterministic summary counts reflect the final reviewed rows after applying '
 || cast(coalesce(n, 0) as varchar) || ' reviewer change(s) affecting ' || cast(coalesce(c, 0) as varchar) || ' column(s).' as overview, o.included_column_count, coalesce(n, 0) as review_change_count,
 coalesce(c, 0) as review_changed_column_count
from new_c o left join agg on o.run_id = agg.run_id
""", ("fleet_columns",))
def c_review_summary(tb):
    rows, base, keep = dealt_patches(tb)
    after = keep(patch.apply(base, rows), "contract")
    out = patch.stamped_summary(after, patch.change_log(rows, base, after, keep=keep))
    return out.select("run_id", "overview", "included_column_count", "review_change_count", "review_changed_column_count")


@query("c_review_envelope", f"""
with {PATCHES}, {SMALL}, {_REJECT}, {_APPLY}, {_LOG},
log as (select run_id from good union all select run_id from sys where a <> b)
select s.run_id, 'canonical_contract_reviewer' as worker, n.n as rows_in_contract, coalesce(l.n, 0) as change_count
from (select distinct run_id from small) s join (select run_id, count(*) as n from small group by run_id) n on s.run_id = n.run_id
left join (select run_id, count(*) as n from log group by run_id) l on s.run_id = l.run_id
""", ("fleet_columns",))
def c_review_envelope(tb):
    rows, base, keep = dealt_patches(tb)
    after = keep(patch.apply(base, rows), "contract")
    log = patch.change_log(rows, base, after, keep=keep)
    review = base.select("run_id").distinct().withColumns({"review_overview": F.lit("Reviewed."), "review_principles": F.array(F.lit("evidence first"))})
    doc = patch.envelope(patch.stamped_summary(after, log), log, after, review)
    parsed = F.try_parse_json("canon_review_json")
    count = lambda path: F.coalesce(F.size(F.try_variant_get(parsed, path, "array<variant>")), F.lit(0)).cast("bigint")
    return doc.select("run_id", F.try_variant_get(parsed, "$.worker", "string").alias("worker"),
                      count("$.reviewed_contract.column_contracts").alias("rows_in_contract"), count("$.change_log").alias("change_count"))


@query("c_order_check", f"""
with {SMALL},
kept as (select run_id, column_name, row_number() over (partition by run_id order by ordinal) - 1 as ordinal from small where status <> 'unresolved')
select coalesce(s.run_id, k.run_id) as run_id, cast(coalesce(s.ordinal, k.ordinal) as integer) as ordinal, s.column_name as before_column, k.column_name as after_column
from small s full join kept k on s.run_id = k.run_id and s.ordinal = k.ordinal where s.column_name is distinct from k.column_name
""", ("fleet_columns",))
def c_order_check(tb):
    base = small_contract(tb)
    return patch.order_violations(base, contract.ordered(base.filter("canonical_modeling_status <> 'unresolved'")))


@query("c_final_errors", f"""
with {SMALL}
select run_id, ordinal, 'reviewed_contract.column_contracts[' || cast(ordinal as varchar) || '].skip_logic_protected can only be true for structurally_valid_missingness or partially_structural_missingness' as message
from small where ih = '[]' and lt = 'free_text'
""", ("fleet_columns",))
def c_final_errors(tb):
    base = small_contract(tb)
    wrong = (F.size("interpretation_hints") == 0) & (F.col("recommended_logical_type") == "free_text")
    return patch.final_errors(base.withColumn("skip_logic_protected", F.col("skip_logic_protected") | wrong)).drop("rule")


# ---- scales ----

SCALE = """
targets as (select run_id, family_id, min(column_name) as c, count(*) as n from fleet_members group by all),
sheet as (select run_id, 'family' as target_kind, family_id as target_id, 'familiarity' as response_scale_kind,
   case when n = 1 then '' when run_id % 2 = 0 then ' Never 0 |Some 3|| Very 6' else 'No 1|2|Strong 3' end as labels,
   case when n > 2 then '0|1|2' else '' end as scores from targets where family_id in ('q', 'a_1')),
levels as (select run_id, column_name, case when column_name like 'A1%' then cast(seed % 3 + 1 as varchar) || ' ' when column_name like 'Score%' then cast(pick % 2 + 1 as varchar)
   else 'Agree ' || cast(seed % 4 as varchar) end as value from fleet_columns where column_name not like 'Unnamed%'
  union all select run_id, column_name, case when column_name like 'A1%' then cast(pick % 3 + 1 as varchar) when column_name like 'Score%' then '2'
   else case when pick % 5 = 0 then 'Never' else 'Disagree ' || cast(seed % 4 + 4 as varchar) end end from fleet_columns where column_name not like 'Unnamed%'),
book as (select run_id, 'family' as target_kind, family_id as target_id, case when run_id % 5 = 0 then 'unresolved' else 'codebook_confirmed' end as mapping_status from targets where family_id in ('a_1', 'score'))
"""


def scale_inputs(tb):
    from tablesight.catalog.inputs import depends_on

    body = SCALE.replace("from fleet_columns", "from {fleet_columns}").replace("from fleet_members", "from {fleet_members}").replace("as varchar)", "as string)")
    tables = {n: tb.input(n) for n in depends_on(body)}
    return {n: tb.spark.sql(f"with {body} select * from {n}", **tables) for n in ("sheet", "levels", "book")}


def handed_off(parts):
    sheet = parts["sheet"].withColumnsRenamed({"labels": "ordered_labels_low_to_high", "scores": "numeric_scores_low_to_high"})
    return scale.handoff(sheet.withColumn("notes", F.lit("")))


def codebook_of(parts):
    labels = F.when(F.col("target_id") == "a_1", F.array(F.lit("No anxiety 1"), F.lit("2"), F.lit("Strong anxiety 3"))).otherwise(F.array(F.lit("Low 1"), F.lit("High 2")))
    positions = F.map_from_arrays(labels, F.transform(labels, lambda _, i: (i + 1).cast("double")))
    return parts["book"].select(
        "run_id", "target_kind", "target_id", "mapping_status", F.lit("likert").alias("response_scale_kind"), labels.alias("ordered_labels"),
        positions.alias("label_to_ordinal_position"), positions.alias("label_to_numeric_score"), F.lit(True).alias("numeric_score_semantics_confirmed"),
        F.lit("codebook_pdf").alias("source"), F.lit("From codebook.").alias("notes"), F.lit(0.92).alias("confidence"))


def reconciled(tb, parts):
    observed = scale.observed_values(col(parts["levels"]), col(tb.input("fleet_members")))
    return scale.reconcile(codebook_of(parts).filter("mapping_status = 'codebook_confirmed'"), observed)


@query("c_scale_handoff", f"""
with {SCALE}
select run_id, target_kind, target_id, case when run_id % 2 = 0 then 'Never 0|Some 3|Very 6' else 'No 1|2|Strong 3' end as ordered_labels,
 case when scores = '' then '' else '0.0|1.0|2.0' end as numeric_scores
from sheet where labels <> ''
""", ("fleet_columns", "fleet_members"))
def c_scale_handoff(tb):
    out = handed_off(scale_inputs(tb))
    return out.select("run_id", "target_kind", "target_id", F.array_join("ordered_labels", "|").alias("ordered_labels"),
                      F.array_join(F.transform("numeric_scores", lambda x: x.cast("string")), "|").alias("numeric_scores"))


_OBS = """
obs as (select m.run_id, family_id, array_to_string(list(distinct trim(value) order by trim(value)), '|') as observed from levels l join fleet_members m on l.run_id = m.run_id and l.column_name = m.column_name group by all),
rec as (select b.run_id, target_id, observed, observed = case target_id when 'a_1' then '1|2|3' else '1|2' end as rewrite from book b join obs o on b.run_id = o.run_id and b.target_id = o.family_id where mapping_status = 'codebook_confirmed')
"""


@query("c_scale_reconcile", f"""
with {SCALE}, {_OBS}
select run_id, target_id, case when rewrite then observed when target_id = 'a_1' then 'No anxiety 1|2|Strong anxiety 3' else 'Low 1|High 2' end as ordered_labels,
 'From codebook.' || case when rewrite then ' Codebook meaning: ' || case target_id when 'a_1' then '1 = No anxiety; 3 = Strong anxiety.' else '1 = Low; 2 = High.' end else '' end as notes, not rewrite as mismatch
from rec
""", ("fleet_columns", "fleet_members"))
def c_scale_reconcile(tb):
    out = reconciled(tb, scale_inputs(tb))
    return out.select("run_id", "target_id", F.array_join("ordered_labels", "|").alias("ordered_labels"), "notes", "mismatch")


@query("c_scale_mismatch_flags", f"""
with {SCALE}, {_OBS} select run_id, 'family:' || target_id as item, 'scale_mapping_source_value_mismatch' as issue from rec where not rewrite
""", ("fleet_columns", "fleet_members"))
def c_scale_mismatch_flags(tb):
    return scale.mismatch_flags(reconciled(tb, scale_inputs(tb))).drop("why")


_INFER = """
lv as (select run_id, column_name, trim(value) as v from levels),
inf as (select l.run_id, l.column_name, array_to_string(list(distinct v order by v), '|') as labels, count(distinct v) as n from lv l
  where not exists (select 1 from fleet_members m where m.run_id = l.run_id and m.column_name = l.column_name) and l.column_name <> 'RespondentId'
  group by all having bool_and(regexp_matches(v, '[A-Za-z].*[0-9]+$')) and count(distinct v) > 1)
"""


@query("c_scale_infer", f"""
with {SCALE}, {_INFER} select run_id, column_name as target_id, n as n_labels, 'deterministic_inferred' as mapping_status from inf
""", ("fleet_columns", "fleet_members"))
def c_scale_infer(tb):
    parts = scale_inputs(tb)
    keys = col(tb.input("fleet_columns")).filter("column = 'RespondentId'").select("run_id", "column", F.lit("id_key").alias("primary_role"))
    out = scale.infer_textual(col(parts["levels"]), col(tb.input("fleet_members")), keys)
    return out.select("run_id", "target_id", F.size("ordered_labels").cast("bigint").alias("n_labels"), "mapping_status")


@query("c_scale_resolve", f"""
with {SCALE}, {_OBS}, {_INFER},
h as (select run_id, target_id from sheet where labels <> '')
select run_id, 'family' as target_kind, target_id, 'human_confirmed' as mapping_status from h
union all select r.run_id, 'family', r.target_id, 'codebook_confirmed' from rec r where not exists (select 1 from h where h.run_id = r.run_id and h.target_id = r.target_id)
union all select run_id, 'column', column_name, 'deterministic_inferred' from inf
""", ("fleet_columns", "fleet_members"))
def c_scale_resolve(tb):
    parts = scale_inputs(tb)
    keys = col(tb.input("fleet_columns")).filter("column = 'RespondentId'").select("run_id", "column", F.lit("id_key").alias("primary_role"))
    inferred = scale.infer_textual(col(parts["levels"]), col(tb.input("fleet_members")), keys)
    out = scale.resolve(scale.human_mappings(handed_off(parts)), reconciled(tb, parts), inferred)
    return out.select("run_id", "target_kind", "target_id", "mapping_status")


_ANSWERS = ("pain", "effort", "mood", "price", "yes")
_TEXTS = " union all ".join(f"select '{c}' as c, trim({c}) as v from scale_answers where trim({c}) not in ('', 'n/a')" for c in _ANSWERS)


@query("c_scale_whole_levels", f"""
with texts as ({_TEXTS}),
sets as (select c, count(distinct v) as n, list(distinct v order by v) as vs, bool_and(regexp_matches(v, '[A-Za-z].*[0-9]+$')) as ladder from texts group by c)
select 'answers' as run_id, 'pain' as target_id, 'codebook_confirmed' as mapping_status, case when vs = list_sort(list_transform(range(1, 11), lambda i: i::varchar)) then '1|2|3|4|5|6|7|8|9|10' end as labels,
 vs <> list_sort(list_transform(range(1, 11), lambda i: i::varchar)) as mismatch from sets where c = 'pain'
union all select 'answers', 'price', 'codebook_confirmed', 'Low 1|High 2', n > 100 or vs <> ['High 2', 'Low 1'] from sets where c = 'price'
union all select 'answers', c, 'deterministic_inferred', array_to_string(vs, '|'), null from sets where ladder and n <= 100
""", ("scale_answers",))
def c_scale_whole_levels(tb):
    levels = cut(scale.complete_levels(profile.cell_histogram(tb.input("scale_answers"), "answers")))
    ten = [f"{w} {i}".strip() for i, w in enumerate(["No pain", *[""] * 8, "Worst"], 1)]
    books = [("pain", ten), ("price", ["Low 1", "High 2"])]
    book = tb.spark.createDataFrame([("answers", "column", c, labels) for c, labels in books], "run_id string, target_kind string, target_id string, ordered_labels array<string>")
    positions = F.map_from_arrays("ordered_labels", F.transform("ordered_labels", lambda _, i: (i + 1).cast("double")))
    mapped = book.withColumns({"mapping_status": F.lit("codebook_confirmed"), "response_scale_kind": F.lit("rating"), "label_to_ordinal_position": positions,
                               "label_to_numeric_score": positions, "numeric_score_semantics_confirmed": F.lit(True), "source": F.lit("codebook_pdf"), "notes": F.lit(""), "confidence": F.lit(0.9)})
    none = tb.spark.createDataFrame([], "run_id string, column string, family_id string, primary_role string")
    fitted = scale.reconcile(mapped, scale.observed_values(levels, none)).select("run_id", "target_id", "mapping_status", F.array_join("ordered_labels", "|").alias("labels"), "mismatch")
    inferred = scale.infer_textual(levels, none, none)
    return fitted.unionByName(inferred.select("run_id", "target_id", "mapping_status", F.array_join("ordered_labels", "|").alias("labels"), F.lit(None).cast("boolean").alias("mismatch")))
