"""Messy inputs derived from the given tables.

Each text is plain SQL that both Spark and the checking engine run, so a query and its oracle
start from the same rows. ``{table}`` names a given table. Every input is built over whole tables;
where a decision input holds only some columns of each run, that is what it models: reviewers decide
on part of the columns and the rest must come from defaults and the baseline.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablesight.plans.shared import cut, dealt

_CENTS = "cast(round(abs(c_acctbal) * 100) as bigint)"
_UNITS = f"cast(floor({_CENTS} / 100) as bigint)"

INPUTS: dict[str, str] = {}

INPUTS["dirty_customer"] = f"""
select
  lpad(cast(c_custkey as string), 8, '0') as cust_id,
  case when c_custkey % 11 = 0 then 'N/A' when c_custkey % 13 = 0 then ''
       when c_custkey % 17 = 0 then '  ' || c_name || ' ' else c_name end as name,
  case when c_custkey % 23 = 0 then 'unknown'
       when c_custkey % 7 = 0 and {_UNITS} >= 1000 then '$' || cast(cast(floor({_UNITS} / 1000) as bigint) as string) || ',' || lpad(cast({_UNITS} % 1000 as string), 3, '0') || '.50'
       else cast({_UNITS} as string) || '.' || lpad(cast({_CENTS} % 100 as string), 2, '0') end as balance,
  case when c_custkey % 19 = 0 then null when c_custkey % 3 = 0 then lower(c_mktsegment)
       when c_custkey % 5 = 0 then ' ' || c_mktsegment || ' ' else c_mktsegment end as segment,
  cast(c_custkey % 60 + 40 as string) || 'kg' as weight,
  cast(2000 + c_custkey % 20 as string) || ' ~ ' || cast(2005 + c_custkey % 18 as string) as contract,
  case c_custkey % 4 when 0 then 'RW, ST' when 1 then 'CF' when 2 then 'GK, RW' else 'ST, CF, RW' end as positions,
  case when c_custkey % 29 = 0 then '2025-02-30' when c_custkey % 31 = 0 then 'missing'
       else '20' || lpad(cast(c_custkey % 24 as string), 2, '0') || '-' || lpad(cast(c_custkey % 12 + 1 as string), 2, '0') || '-' || lpad(cast(c_custkey % 28 + 1 as string), 2, '0') end as joined,
  case c_custkey % 4 when 0 then 'Yes' when 1 then 'no' when 2 then 'Y' else 'FALSE' end as active,
  cast(c_custkey % 100 as string) || '%' as discount,
  case when c_custkey % 3 = 0 then '1' else '0' end as flag_1,
  case when c_custkey % 3 = 1 then '1' else '0' end as flag_2,
  case when c_custkey % 3 = 2 then '1' else '0' end as flag_3,
  cast(c_nationkey % 5 as string) as nation_code,
  case when c_custkey % 4 = 3 then '' else 'user' || cast(c_custkey as string) || '@example.com' end as email,
  'Customer prefers ' || lower(c_mktsegment) || ' offers and asks about item ' || cast(c_custkey as string) as notes
from {{customer}}
"""

INPUTS["wide_orders"] = "select l_orderkey,\n" + ",\n".join(
    f"  max(case when l_linenumber = {i} then l_quantity end) as \"Qty_{i}\"" for i in range(1, 8)
) + "\nfrom {lineitem} group by l_orderkey"

INPUTS["wide_waves"] = "select l_orderkey as respondent_id,\n" + ",\n".join(
    f"  max(case when l_linenumber = {i} and l_linestatus = '{s}' then cast(l_quantity as bigint) % 5 + 1 end) as \"A{w}_Q{i}\""
    for w, s in ((1, "O"), (2, "F")) for i in range(1, 6)
) + "\nfrom {lineitem} group by l_orderkey"

INPUTS["answer_key"] = """
select l_linenumber as item, l_quantity as key_value from (
  select l_linenumber, l_quantity,
         row_number() over (partition by l_linenumber order by n desc, l_quantity) as rn
  from (select l_linenumber, l_quantity, count(*) as n from {lineitem} group by l_linenumber, l_quantity) q
) r where rn = 1
"""

INPUTS["gated_events"] = """
select event_id, user_id, event_type,
  case when event_type = 'purchase' then value end as refund_amt,
  case when event_type = 'purchase' then user_id % 7 end as refund_reason,
  case when event_type = 'purchase' then event_id % 3 end as refund_channel,
  case when event_type = 'purchase' then value * 2 end as refund_total,
  case when event_type = 'purchase' then 'k' || cast(event_id % 5 as string) end as refund_code,
  case when event_type = 'click' and event_id % 4 <> 0 then value end as click_depth,
  case when event_id % 3 <> 0 then value end as noise
from {events}
"""

# A fleet of datasets: every order is one run and its lines are that run's columns.
INPUTS["fleet_columns"] = """
select run_id, min(line * 10 + fam) as ordinal, column_name, min(seed) as seed, min(pick) as pick,
       min(qty) as qty
from (
  select l_orderkey as run_id, l_linenumber as line, l_suppkey % 6 as fam, l_partkey as seed,
         l_suppkey as pick, cast(l_quantity as bigint) as qty,
         case l_suppkey % 6
           when 0 then 'Q6Main_cell_groupRow' || cast(l_linenumber as string)
           when 1 then 'A1_Q' || cast(l_linenumber as string)
           when 2 then 'Q' || cast(l_linenumber as string)
           when 3 then 'Score-' || cast(l_linenumber as string)
           when 4 then case when l_linenumber < 3 then 'W/F' when l_linenumber < 5 then 'Status' else 'Comment' end
           else case when l_linenumber < 4 then 'Unnamed: 0' else 'RespondentId' end
         end as column_name
  from {lineitem}
) s group by run_id, column_name
"""

INPUTS["nation_customers"] = """
select c_custkey, c_nationkey, n_name, r_regionkey, r_name, c_mktsegment
from {customer}
join {nation} on c_nationkey = n_nationkey
join {region} on n_regionkey = r_regionkey
"""

# Order numbers split into four parts, the first null for one of its levels, among flags of few levels.
INPUTS["split_orders"] = """
select o_orderkey as order_no, cast(floor(o_orderkey / 100) as bigint) as batch, o_orderkey % 100 as slot,
  case when o_orderkey % 11 > 0 then o_orderkey % 11 end as part_a, cast(floor(o_orderkey / 11) as bigint) % 13 as part_b,
  cast(floor(o_orderkey / 143) as bigint) % 7 as part_c, cast(floor(o_orderkey / 1001) as bigint) as part_d,
""" + ",\n".join(f"  cast(floor((o_custkey + {i}) * {2 * i + 3} / 7) as bigint) % {2 + i % 2} as flag_{i}" for i in range(33)) + """
from {orders}
"""

# Postal codes of several per order, a city for each, and a rate that two columns fix.
INPUTS["zip_lines"] = """
select 'z' || cast(zip as string) as zip, zip % 997 as city, zip % 997 % 10 as area, qty, line_no,
  case when (qty + 3 * line_no) % 17 > 0 then (qty + 3 * line_no) % 17 end as rate, flag, status, part, (part * 7 + qty) % 400 as stock
from (select l_orderkey * 5 + l_partkey % 5 as zip, cast(l_quantity as bigint) as qty, l_linenumber as line_no, l_returnflag as flag, l_linestatus as status, l_partkey as part
  from {lineitem}) l
"""

# Amounts that add up on some columns, and are never in order on others; some cells empty.
INPUTS["ledger"] = """
select l_orderkey as order_no, l_linenumber as line_no, cast(round(l_extendedprice * 100) as bigint) as gross,
  cast(round(l_extendedprice * 100) as bigint) - cast(floor(l_extendedprice * 10) as bigint) as net,
  case when l_linenumber <> 4 then cast(floor(l_extendedprice * 10) as bigint) end as tax,
  cast(l_quantity as bigint) as qty, case when l_partkey % 3 = 0 then cast(l_quantity as bigint) + l_linenumber end as stock,
  case when l_partkey % 3 > 0 then l_partkey % 50 end as loss, case when l_partkey % 3 > 0 then l_partkey % 50 + cast(l_quantity as bigint) end as used,
  l_shipdate as shipped
from {lineitem}
"""

# Versions of an order's record: written later and later, one latest row each; some are written twice at once.
INPUTS["versions"] = """
select o_orderkey * 4 + v as write_no, o_custkey as customer, o_orderkey as record,
  case when o_orderkey % 10 > 0 then o_orderkey * 10 + v * 2 end as written,
  case when o_orderkey % 2 = 0 then v else 1 end as revision, o_custkey * 3 + v as other
from (select *, 0 as v from {orders} union all select *, 1 as v from {orders} union all select *, 2 as v from {orders}) o
"""

# Orders with a second time, along which a numeric column rises and a status changes; the first time has no drift.
INPUTS["two_times"] = """
select o_orderkey as order_no, o_orderdate as ordered, cast(timestamp '2020-01-01 00:00:00' as timestamp) + (o_orderkey % 1000) * interval '1' hour as logged,
  o_orderkey % 1000 * 10 + o_custkey % 3000 as load, (o_orderkey * 7919) % 10007 as noise, case when o_orderkey % 1000 > 700 then 'new' else o_orderstatus end as state, o_orderpriority as priority
from {orders}
"""

# Orders of a customer, numbered.
INPUTS["visits"] = """
select o_custkey as customer, row_number() over (partition by o_custkey order by o_orderkey) as visit, o_totalprice as spent, o_orderkey as order_no, o_orderpriority as priority
from {orders}
"""

INPUTS["fleet_a2"] = """
select run_id, ordinal, column_name, seed, pick, qty, seed % 20 as unique_count, cast(pick % 101 as double) as missing_pct,
  pick % 101 >= 40 as high_missingness, seed % 11 = 0 as is_one_hot_like,
  case when seed % 7 = 0 then seed % 5 + 1 end as token_count
from {fleet_columns}
"""

INPUTS["fleet_buckets"] = """
select run_id, 'review_columns' as bucket, column_name as name, ordinal as rank from {fleet_columns} where seed % 6 = 0
union all select run_id, 'structural_columns', column_name, ordinal from {fleet_columns} where pick % 9 = 0
union all select run_id, 'reviewer_focus_columns', column_name, qty from {fleet_columns} where qty % 4 = 0
"""

INPUTS["fleet_roles"] = """
select run_id, column_name, seed, pick,
  case pick % 6 when 0 then 'id_key' when 1 then 'time_index' when 2 then 'invariant_attr' when 3 then 'coded_categorical'
       when 4 then 'measure' else 'measure_item' end as primary_role,
  seed % 3 = 0 as review_required
from {fleet_columns}
"""

INPUTS["fleet_tests"] = """
select run_id, column_name || ',id' as keys_tested, seed % 4 = 0 as pivot_safety, cast(qty % 7 as double) / 7 as collision_severity_score,
  cast(pick % 5 as double) as non_key_conflict_group_pct, cast(seed % 9 as double) / 9 as uniqueness_rate, column_name
from {fleet_columns}
"""

INPUTS["fleet_members"] = """
select run_id, column_name, case when column_name like 'Q6Main%' then 'q_6_main_cell_group' when column_name like 'A1%' then 'a_1'
  when column_name like 'Score%' then 'score' else 'q' end as family_id
from {fleet_columns} where column_name like 'Q%' or column_name like 'A1%' or column_name like 'Score%'
"""

INPUTS["fleet_type"] = """
select run_id, column_name,
  case seed % 5 when 0 then 'identifier' when 1 then 'ordinal_category' when 2 then 'numeric_measure' when 3 then 'free_text' else 'boolean_flag' end as recommended_logical_type,
  case when seed % 5 = 2 then 'integer' when seed % 5 = 4 and pick % 3 > 0 then 'boolean' else 'string' end as recommended_storage_type,
  'trim_whitespace' as transform_actions,
  case when seed % 4 = 0 then 'requires_child_table_review,split_multiselect_tokens' else 'requires_unit_normalization_review' end as structural_transform_hints,
  case when pick % 4 = 0 then 'skip_logic_protected' else 'code_not_quantity' end as interpretation_hints,
  'Reviewed.' as normalization_notes, cast(seed % 100 as double) / 100 as confidence, pick % 5 = 0 as needs_human_review
from {fleet_columns} where seed % 3 = 0
union all
select distinct run_id, 'GhostCol', 'mixed_or_ambiguous', 'string', '', '', 'mixed_content_high_risk', '', cast(0.7 as double), true
from {fleet_columns} where run_id % 10 = 0
"""

INPUTS["fleet_missing"] = """
select run_id, column_name,
  case pick % 6 when 0 then 'no_material_missingness' when 1 then 'token_missingness_present' when 2 then 'structurally_valid_missingness'
    when 3 then 'partially_structural_missingness' when 4 then 'unexplained_high_missingness' else 'mixed_missingness_risk' end as missingness_disposition,
  case seed % 4 when 0 then 'confirmed_structural' when 1 then 'plausible_structural' when 2 then 'not_structurally_explained' else 'not_applicable' end as structural_validity,
  case qty % 5 when 0 then 'no_action_needed' when 1 then 'protect_from_null_penalty' when 2 then 'retain_with_caution'
    when 3 then 'review_before_drop' else 'candidate_drop_review' end as recommended_handling,
  pick % 2 = 0 as skip_logic_protected, pick % 7 = 0 as needs_human_review
from {fleet_columns} where pick % 4 < 2
"""

INPUTS["fleet_layout"] = """
select c.run_id, c.column_name,
  case when c.column_name like 'Unnamed%' then '' when m.family_id is not null then m.family_id || '_rows' else 'base_rows' end as assigned_table,
  case when c.column_name like 'Unnamed%' then 'exclude_from_outputs' when m.family_id is not null then 'melt_member'
       when c.column_name = 'RespondentId' then 'base_key' else 'base_attribute' end as assignment_role,
  coalesce(m.family_id, '') as source_family_id
from {fleet_columns} c left join {fleet_members} m on c.run_id = m.run_id and c.column_name = m.column_name
where c.seed % 13 <> 0
"""

INPUTS["fleet_defaults"] = """
select run_id, family_id, 'ordinal_category' as recommended_logical_type, 'string' as recommended_storage_type,
  case when run_id % 3 = 0 then 'token_missingness_present' else 'structurally_valid_missingness' end as missingness_disposition,
  case when run_id % 3 = 0 then 'retain_with_caution' else 'protect_from_null_penalty' end as missingness_handling,
  run_id % 3 <> 0 as skip_logic_protected
from (select distinct run_id, family_id from {fleet_members} where family_id in ('q_6_main_cell_group', 'a_1') and run_id % 2 = 0) f
"""

INPUTS["fleet_a17"] = """
select run_id, column_name,
  case seed % 3 when 0 then 'numeric_measure' when 1 then 'nominal_category' else 'free_text' end as recommended_logical_type,
  case when seed % 3 = 0 then 'integer' else 'string' end as recommended_storage_type,
  case when pick % 5 = 0 then 'token_missingness_present' when pick % 5 = 1 then 'structurally_valid_missingness' else 'no_material_missingness' end as missingness_disposition,
  case when pick % 5 = 0 then 'retain_with_caution' when pick % 5 = 1 then 'protect_from_null_penalty' else 'no_action_needed' end as missingness_handling,
  pick % 5 = 1 as skip_logic_protected
from {fleet_columns}
"""

INPUTS["fleet_decisions"] = """
select run_id, ordinal, column_name,
  case seed % 7 when 0 then 'no_material_missingness' when 1 then 'token_missingness_present' when 2 then 'structurally_valid_missingness'
    when 3 then 'partially_structural_missingness' when 4 then 'unexplained_high_missingness' when 5 then 'mixed_missingness_risk' end as missingness_disposition,
  case qty % 5 when 0 then 'no_action_needed' when 1 then 'protect_from_null_penalty' when 2 then 'retain_with_caution'
    when 3 then 'review_before_drop' else 'candidate_drop_review' end as missingness_handling,
  case pick % 3 when 0 then 'family_default' when 1 then 'reviewed_missingness_worker' else 'a17_baseline' end as missingness_decision_source,
  case pick % 4 when 0 then true when 1 then false when 2 then true end as skip_logic_protected,
  case when seed % 2 = 0 then 'child_repeat_member' else 'base_field' end as canonical_modeling_status,
  case when pick % 5 = 0 then 'requires_child_table_review,split_multiselect_tokens,requires_wide_to_long_review' else 'split_multiselect_tokens' end as structural_transform_hints,
  case when run_id % 3 = 0 then false when run_id % 3 = 1 then true end as token_flag,
  pick % 9 <> 0 as has_base,
  case when qty % 2 = 0 then 'token_missingness_present' else 'no_material_missingness' end as base_disposition,
  case when qty % 2 = 0 then 'retain_with_caution' else 'no_action_needed' end as base_handling,
  case when qty % 3 = 0 then 'family_default' else 'a17_baseline' end as base_source
from {fleet_columns}
"""

# Answers on long scales: ten points, nine steps, nine steps and a text that is none, and amounts that are no scale.
INPUTS["scale_answers"] = """
select ' ' || cast(l_partkey % 10 + 1 as string) as pain, 'Level ' || cast(l_partkey % 9 + 1 as string) || ' ' as effort,
  case when l_orderkey % 50 = 0 then 'unsure' else 'Agree ' || cast(l_suppkey % 9 + 1 as string) end as mood,
  cast(cast(l_extendedprice as bigint) as string) as price, case when l_linenumber = 3 then 'n/a' else cast(l_linenumber % 2 as string) end as yes
from {lineitem}
"""

INPUTS["fleet_scales"] = """
select distinct run_id, 'family' as target_kind, family_id as target_id, 'likert' as response_scale_kind,
  case when family_id = 'score' then 'deterministic_inferred' when run_id % 2 = 0 then 'human_confirmed' else 'codebook_confirmed' end as mapping_status
from {fleet_members} where family_id in ('q', 'score', 'a_1') and run_id % 5 > 0
union all select distinct run_id, 'column', column_name, 'ladder', case when column_name = 'W/F' then 'human_confirmed' else 'deterministic_inferred' end
from {fleet_columns} where column_name in ('W/F', 'Comment') or column_name = 'Q2' and run_id % 3 = 0
"""

INPUTS["bad_types"] = """
select run_id, ordinal as position, case when seed % 31 = 0 then ' ' else column_name end as column_name,
  case when seed % 17 = 0 then 'weird' else case seed % 5 when 0 then 'identifier' when 1 then 'categorical_code' when 2 then 'numeric_measure' when 3 then 'date' else 'boolean_flag' end end as recommended_logical_type,
  case when pick % 13 = 0 then null else case pick % 4 when 0 then 'string' when 1 then 'integer' when 2 then 'date' else 'boolean' end end as recommended_storage_type,
  case when seed % 7 = 0 then 'trim_whitespace,explode_rows' else 'trim_whitespace' end as transform_actions,
  case when seed % 19 = 0 then '' else 'note' end as normalization_notes, case when pick % 23 = 0 then 1.5e0 else 0.5e0 end as confidence
from {fleet_columns}
"""

INPUTS["bad_layout"] = """
select run_id, ordinal as position, column_name, seed, pick,
  case when column_name like 'Q%' then 'child_repeat' when seed % 29 = 0 then 'cube' else 'base_entity' end as kind,
  case when column_name like 'Q%' and seed % 3 > 0 then 'accepted_family' else 'primary_grain' end as basis,
  case when column_name like 'Q%' then 'wide_to_long_family' else 'direct_select' end as strategy,
  case when seed % 5 = 0 then '' else 'row' end as repeat_index_name,
  case when pick % 3 = 0 then 'id' else 'id,row' end as grain_columns,
  case when pick % 4 = 0 then '' else 'fam' end as source_family_id, seed % 6 as included_column_count,
  case when pick % 5 = 0 then '' else column_name end as preview
from {fleet_columns}
"""

INPUTS["bad_assign"] = """
select run_id, ordinal as position, column_name,
  case seed % 5 when 0 then 'exclude_from_outputs' when 1 then 'melt_member' when 2 then 'base_attribute' when 3 then 'unresolved' else 'pivot_me' end as assignment_role,
  case when pick % 3 = 0 then '' when pick % 3 = 1 then 'base_rows' else 'nowhere_' || cast(pick % 7 as string) end as assigned_table,
  case when qty % 2 = 0 then 'fam' else '' end as source_family_id
from {fleet_columns}
"""

INPUTS["bad_plan"] = """
select run_id, ordinal as position, column_name,
  case pick % 5 when 0 then 'merge_sibling_families_with_wave' when 1 then 'pass_through' when 2 then 'aggregate_scores' when 3 then 'assemble_analysis_mart' else 'mystery' end as strategy,
  case when seed % 4 = 0 then '' when seed % 4 = 1 then 'term' else 'wave' end as wave_column,
  case when qty % 3 = 0 then '' when qty % 3 = 1 then 'id,wave' else 'id' end as grain_columns,
  case when qty % 2 = 0 then 'a,b' else 'a' end as sources,
  case seed % 3 when 0 then 'family_merge' when 1 then 'score_aggregation' else 'guess' end as derivation_kind,
  case pick % 4 when 0 then 'treat_as_incorrect' when 1 then 'exclude_from_score' when 2 then 'zero_fill' end as policy,
  cast(qty % 12 as double) / 10 as confidence
from {fleet_columns}
"""


#: A survey whose gate comes after ten answers and empties seventy columns.
INPUTS["gated_survey"] = f"""
select o_orderkey as respondent, case when o_orderkey % 2 = 0 then 'f' else 'm' end as gender,
  {", ".join(f"cast((o_orderkey * {k + 3} + o_custkey) % 5 as string) as a_{k}" for k in range(1, 11))},
  case when o_custkey % 3 = 0 then 'yes' else 'no' end as gate,
  {", ".join(f"case when o_custkey % 3 = 0 then cast((o_orderkey + {k}) % 4 as string) when {k} % 2 = 0 then '' end as g_{k}" for k in range(1, 71))}
from {{orders}}
"""


def depends_on(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


class Tables:
    """The given parquet tables of one folder, plus the messy inputs built from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        tables = {n: self.table(n) if n not in INPUTS else self.input(n) for n in depends_on(text)}
        return self.spark.sql(text.replace('"', "`"), **tables)

    def input(self, name: str) -> DataFrame:
        """A messy input; the one that many others start from is computed once per query."""
        if name != "fleet_columns":
            return self.sql(INPUTS[name])
        if name not in self._kept:
            self._kept[name] = cut(self.sql(INPUTS[name]))
        return self._kept[name]

    def by_run(self) -> Callable[[DataFrame, str], DataFrame]:
        """From now on ``fleet_columns`` lies dealt by run; returns what keeps frames of that key beside it.

        The lines move once, as they are read. There are as many parts as keep each at some 200,000 lines.
        """
        lines = self.table("lineitem")
        parts = max(self.spark.sparkContext.defaultParallelism, lines.count() // 200_000)
        keep = lambda df, name: dealt(df, "run_id", parts, name)
        rows = self.spark.sql(INPUTS["fleet_columns"], lineitem=lines.repartition(parts, "l_orderkey"))
        self._kept["fleet_columns"] = keep(rows, "fleet_columns")
        return keep


def with_inputs(body: str, *names: str) -> str:
    """Oracle text: the named inputs as CTEs in front of ``body``."""
    ctes = [f"{n} as materialized ({re.sub(r'[{](\w+)[}]', r'\1', INPUTS[n])})" for n in names]
    text = body.strip()
    if not ctes:
        return text
    if text.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(ctes) + ",\n" + text[15:]
    if text.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + text[5:]
    return "with " + ",\n".join(ctes) + "\n" + text
