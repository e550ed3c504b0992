"""Grain, key, family, role, skip-logic and baseline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight.catalog import profiles as p
from tablesight.catalog.registry import query
from tablesight.operators import families, keys, profile, prune, structure
from tablesight.plans import worker_views
from tablesight.plans.shared import cut

GRAINS = [["l_orderkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
          ["l_partkey", "l_suppkey"]]
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _grain_sql():
    row = "row(" + ", ".join(LINE) + ")"
    parts = []
    for g in GRAINS:
        k = ", ".join(g)
        parts.append(f"""select '{",".join(g)}' as keys_tested, sum(n) as n_rows, count(*) as n_groups,
  count(case when n > 1 then 1 end) as cg, count(case when n > 1 and d > 1 then 1 end) as fg
  from (select {k}, count(*) as n, count(distinct {row}) as d from lineitem group by {k}) q""")
    return f"""tests as (select 'lineitem' as run_id, keys_tested, cast(n_rows as bigint) as n_rows, n_groups,
  round(cast(n_groups as double) / n_rows, 6) as uniqueness_rate,
  round(cast(n_rows - n_groups as double) / n_rows, 6) as collision_severity_score,
  round(coalesce(100.0 * cast(fg as double) / nullif(cg, 0), 0), 6) as non_key_conflict_group_pct,
  n_groups = n_rows as pivot_safety from ({" union all ".join(parts)}) u)"""


_RANK = "row_number() over (order by pivot_safety desc, collision_severity_score, non_key_conflict_group_pct, uniqueness_rate desc, keys_tested)"


@query("a6_grain_tests", f"with {_grain_sql()} select *, cast({_RANK} as integer) as grain_rank from tests")
def a6_grain_tests(tb):
    return keys.ranked_grains(keys.grain_tests(tb.table("lineitem"), "lineitem", GRAINS))


@query("a6_fake_grain_rejection", f"""
with {_grain_sql()}
select * from tests where keys_tested not like '%l_linenumber%'
""")
def a6_fake_grain_rejection(tb):
    tests = keys.grain_tests(tb.table("lineitem"), "lineitem", GRAINS)
    columns = families.column_catalog(tb.table("lineitem"), "lineitem").select(
        "run_id", "column", F.when(F.col("column") == "l_linenumber", "line").alias("family_id"),
        F.col("column").rlike("(?i)^(unnamed: ?[0-9]+|index)$").alias("is_export_index"))
    return keys.reject_fake_grains(tests, columns)


@query("a5_single_keys", """
with s as (""" + " union all ".join(
    f"select '{c}' as \"column\", count(distinct {c}) as unique_count, count(*) as n from lineitem" for c in LINE) + """)
select run_id, "column", unique_count, missing_pct, key_ratio, cast(seed_rank as integer) as seed_rank from (
  select 'lineitem' as run_id, "column", unique_count, cast(0 as double) as missing_pct, round(cast(unique_count as double) / n, 6) as key_ratio,
  row_number() over (order by round(cast(unique_count as double) / n, 6) desc, "column") as seed_rank from s) q
where seed_rank <= 8
""")
def a5_single_keys(tb):
    return keys.single_key_seeds(profile.column_stats(profile.cell_histogram(tb.table("lineitem"), "lineitem")), 8)


PAIR_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_PAIRS = [(a, b) for i, a in enumerate(PAIR_COLS) for b in PAIR_COLS[i + 1:]]
_PAIR_SQL = "pairs as (" + " union all ".join(
    f"select 'lineitem' as run_id, '{a},{b}' as pair, count(*) as n_groups, max(n) as largest_group, round(cast(count(*) as double) / sum(n), 6) as pair_ratio "
    f"from (select count(*) as n from lineitem group by {a}, {b}) q" for a, b in _PAIRS) + ")"


@query("a5_pair_keys", f"with {_PAIR_SQL} select * from pairs")
def a5_pair_keys(tb):
    return keys.pair_key_seeds(tb.table("lineitem"), "lineitem", _PAIRS)


@query("a5_key_overlap", f"""
with {_PAIR_SQL},
parts as (select pair, pair_ratio, unnest(string_split(pair, ',')) as "column" from pairs where pair_ratio >= 0.5),
seeds as (""" + " union all ".join(
    f"select '{c}' as \"column\", round(cast(count(distinct {c}) as double) / count(*), 6) as key_ratio from lineitem" for c in PAIR_COLS) + """),
best as (select "column", pair, row_number() over (partition by "column" order by pair_ratio desc, pair) as rn, count(*) over (partition by "column") as n_pairs from parts)
select 'lineitem' as run_id, s."column", s.key_ratio, b.n_pairs, b.pair as best_pair
from seeds s join best b on s."column" = b."column" and b.rn = 1
""")
def a5_key_overlap(tb):
    line = tb.table("lineitem").select(*PAIR_COLS)
    seeds = keys.single_key_seeds(profile.column_stats(profile.cell_histogram(line, "lineitem")), 12)
    return keys.key_overlap_groups(seeds, keys.pair_key_seeds(line, "lineitem", _PAIRS))


STRESS_KEYS = [["l_orderkey"], ["l_orderkey", "l_linenumber"]]
STRESS_ATTRS = ["l_returnflag", "l_linestatus", "l_suppkey", "l_linenumber"]
_STRESS_SQL = "stress as (" + " union all ".join(
    f"""select 'lineitem' as run_id, '{",".join(k)}' as key, '{a}' as attribute, count(*) as repeated_groups,
 round(100.0 * cast(count(case when lo <> hi then 1 end) as double) / count(*), 6) as drift_pct
 from (select min(cast({a} as varchar)) as lo, max(cast({a} as varchar)) as hi from lineitem group by {", ".join(k)} having count(*) > 1) q"""
    for k in STRESS_KEYS for a in STRESS_ATTRS if a not in k) + ")"


@query("a5_key_stress", f"with {_STRESS_SQL} select * from stress")
def a5_key_stress(tb):
    return keys.key_stress(tb.table("lineitem"), "lineitem", STRESS_KEYS, STRESS_ATTRS)


_CONFLICTS = " union all ".join(
    f"""select '{",".join(k)}' as key, '{a}' as attribute, concat_ws('|', {", ".join(f"cast({c} as varchar)" for c in k)}) as key_value, min(cast({a} as varchar)) as low_value, max(cast({a} as varchar)) as high_value
 from lineitem group by {", ".join(k)} having count(distinct {a}) > 1""" for k in STRESS_KEYS for a in STRESS_ATTRS if a not in k)


@query("a5_nested_stress", f"""
with {_STRESS_SQL}, conflicts as ({_CONFLICTS}),
ranked as (select *, row_number() over (partition by key order by drift_pct desc, attribute) as a_rank, count(*) over (partition by key) as drifted from stress where drift_pct > 0),
firsts as (select *, row_number() over (partition by key, attribute order by key_value) as e_rank from conflicts)
select 'lineitem' as run_id, r.key, r.repeated_groups, cast(drifted as integer) as drifted_attributes, r.attribute, r.drift_pct, f.key_value, f.low_value, f.high_value
from ranked r join firsts f on f.key = r.key and f.attribute = r.attribute and e_rank = 1 where a_rank <= 2
""")
def a5_nested_stress(tb):
    """The nested rows cut as the layout reviewer's view cuts them, then laid flat."""
    line = tb.table("lineitem")
    nested = keys.nested_stress(keys.key_stress(line, "lineitem", STRESS_KEYS, STRESS_ATTRS), keys.stress_examples(line, "lineitem", STRESS_KEYS, STRESS_ATTRS))
    for path, k in worker_views.PROFILES["table_layout_worker"]["A5.candidate_key_stress_tests"].nested_limits:
        nested = prune.slice_nested(nested, path, k)
    flat = nested.select("run_id", "key", "repeated_groups", "drifted_attributes", F.explode("top_drifted_attributes").alias("a"))
    return flat.select("run_id", "key", "repeated_groups", "drifted_attributes", "a.attribute", "a.drift_pct", F.explode("a.example_conflicts").alias("e")).select(
        "run_id", "key", "repeated_groups", "drifted_attributes", "attribute", "drift_pct", "e.key_value", "e.low_value", "e.high_value")


@query("a5_conflict_examples", """
with g as (select l_orderkey, count(distinct l_returnflag) as a, count(distinct l_shipdate) as b from lineitem group by l_orderkey)
select 'lineitem' as run_id, 'l_orderkey' as key, 'l_returnflag' as attribute, true as varies from g group by all having max(a) > 1
union all select 'lineitem', 'l_orderkey', 'l_shipdate', true from g group by all having max(b) > 1
""")
def a5_conflict_examples(tb):
    out = keys.conflict_examples(tb.table("lineitem"), "lineitem", ["l_orderkey"], ["l_returnflag", "l_shipdate", "l_orderkey"])
    return out.select("run_id", "key", "attribute", (F.col("low_value") < F.col("high_value")).alias("varies"))


@query("a5_invariants", """
with base as (select c_nationkey as k, count(*) as n, count(distinct n_name) as d1, count(distinct r_name) as d2, count(distinct c_mktsegment) as d3
  from nation_customers group by c_nationkey having count(*) > 1)
select 'customer' as run_id, 'c_nationkey' as key, attribute, repeated_groups, true as not_final_key from (
  select 'n_name' as attribute, count(*) as repeated_groups, max(d1) as d from base
  union all select 'r_name', count(*), max(d2) from base
  union all select 'c_mktsegment', count(*), max(d3) from base) q where d <= 1
""", ("nation_customers",))
def a5_invariants(tb):
    stress = keys.key_stress(tb.input("nation_customers"), "customer", [["c_nationkey"]], ["n_name", "r_name", "c_mktsegment"])
    return keys.invariants(stress)


@query("a7_exact_duplicates", """
select 'documents' as run_id, count(*) as n_copies, min(doc_id) as first_row, max(doc_id) as last_row
from documents group by text, lang having count(*) > 1
""")
def a7_exact_duplicates(tb):
    return keys.duplicate_clusters(tb.table("documents"), "documents", ["text", "lang"], "doc_id")


@query("a7_key_collisions", f"""
select 'lineitem' as run_id, l_orderkey, l_linenumber, count(*) as n_rows, count(distinct row({", ".join(LINE)})) > 1 as conflict
from lineitem group by l_orderkey, l_linenumber having count(*) > 1
""")
def a7_key_collisions(tb):
    return keys.key_collisions(tb.table("lineitem"), "lineitem", ["l_orderkey", "l_linenumber"])


FD = ["c_nationkey", "n_name", "r_regionkey", "r_name", "c_mktsegment"]


@query("a10_dependencies", " union all ".join(
    f"""select 'customer' as run_id, '{x}' as determinant, '{y}' as dependent, count(*) as n_groups,
 round(cast(count(case when d = 1 then 1 end) as double) / count(*), 6) as strength, count(case when d = 1 then 1 end) = count(*) as holds
 from (select count(distinct {y}) as d from nation_customers group by {x}) q"""
    for x in FD for y in FD if x != y), ("nation_customers",))
def a10_dependencies(tb):
    return keys.dependencies(tb.input("nation_customers"), "customer", FD, FD)


TWINS = ["user_id", "user_copy", "user_edit", "event_type", "refund_code", "code_copy"]
_TWINS = """select *, cast(user_id as {text}) as user_copy, case when event_id % 50 = 7 then 'edited' else cast(user_id as {text}) end as user_edit,
 'k' || cast(event_id % 5 as {text}) as code_copy from """


@query("a10_near_duplicates", f"with e as ({_TWINS.format(text='varchar')} gated_events), pairs as (" + " union all ".join(
    f"""select 'events' as run_id, '{a}' as left_column, '{b}' as right_column,
 round(avg(case when cast({a} as varchar) is not distinct from cast({b} as varchar) then 1.0 else 0.0 end), 6) as agreement from e"""
    for i, a in enumerate(TWINS) for b in TWINS[i + 1:]) + ") select * from pairs where agreement >= 0.95", ("gated_events",))
def a10_near_duplicates(tb):
    e = tb.sql(_TWINS.format(text="string") + "{gated_events}")
    pairs = keys.candidate_column_pairs(profile.cell_histogram(e, "events", TWINS), TWINS)
    return keys.near_duplicate_columns(e, "events", pairs).where("agreement >= 0.95")


@query("a10_one_hot", """
select 'customer' as run_id, 'flag' as stem, cast(3 as bigint) as n_columns,
 round(avg(case when (flag_1 = '1')::int + (flag_2 = '1')::int + (flag_3 = '1')::int = 1 then 1.0 else 0.0 end), 6) as exclusive_share
from dirty_customer
""", ("dirty_customer",))
def a10_one_hot(tb):
    return keys.one_hot_blocks(tb.input("dirty_customer"), "customer", {"flag": ["flag_1", "flag_2", "flag_3"]})


@query("a10_coded_categoricals", f"""
with {p.long_sql("dirty_customer", p.DIRTY)}, {p.shares_sql("numeric")}
select 'customer' as run_id, "column", unique_count, numeric_share from shares where numeric_share >= 0.95 and unique_count <= 12
""", ("dirty_customer",))
def a10_coded_categoricals(tb):
    return keys.coded_categoricals(profile.parse_shares(p._hist(tb)))


@query("a10_time_candidates", f"""
with {p.long_sql("dirty_customer", p.DIRTY)}, {p.shares_sql("datetime")}
select 'customer' as run_id, "column", datetime_share, cast(row_number() over (order by datetime_share desc, "column") as integer) as time_rank
from shares where datetime_share >= 0.9
""", ("dirty_customer",))
def a10_time_candidates(tb):
    return keys.time_candidates(profile.parse_shares(p._hist(tb)))


REFUND = ["refund_amt", "refund_reason", "refund_channel", "refund_total", "refund_code"]


@query("a10_screening_correlations", " union all ".join(
    f"""select 'events' as run_id, 'event_type' as screen, '{v}' as level, 'refund' as family_id,
 round(corr((event_type = '{v}')::int::double, ({" + ".join(f"({c} is not null)::int" for c in REFUND)})::double), 6) as correlation from gated_events"""
    for v in ("purchase", "view")), ("gated_events",))
def a10_screening_correlations(tb):
    return keys.screening_correlations(tb.input("gated_events"), "events", "event_type", ["purchase", "view"], {"refund": REFUND})


@query("a10_constraints", """
with e as (select refund_amt, refund_total, click_depth, noise from gated_events)
select 'events' as run_id, 'refund_amt <= refund_total' as "constraint", count(case when refund_amt <= refund_total is not null then 1 end) as checked,
 round(coalesce(avg(case when refund_amt <= refund_total then 1.0 when refund_amt <= refund_total is not null then 0.0 end), 0), 6) as held_share,
 count(case when refund_amt <= refund_total then 1 end) = count(refund_amt) and count(refund_amt) > 0 as deterministic from e
union all
select 'events', 'refund_amt + refund_amt = refund_total', count(refund_total),
 round(coalesce(avg(case when abs(refund_amt + refund_amt - refund_total) < 1e-9 then 1.0 when refund_total is not null then 0.0 end), 0), 6),
 count(case when abs(refund_amt + refund_amt - refund_total) < 1e-9 then 1 end) = count(refund_total) and count(refund_total) > 0 from e
""", ("gated_events",))
def a10_constraints(tb):
    return keys.constraints(tb.input("gated_events"), "events", [("refund_amt", "refund_total")],
                            [("refund_amt", "refund_amt", "refund_total")])


# ---- families over the fleet ----

_MEMBER = "^(.*?)(row|item|wave|q)?[_-]?([0-9]+)$"


def x1(v):
    s = f"regexp_replace({v}, '([A-Za-z])([0-9])', '\\1_\\2', 'g')"
    s = f"regexp_replace({s}, '([0-9])([A-Za-z])', '\\1_\\2', 'g')"
    s = f"regexp_replace({s}, '([a-z])([A-Z])', '\\1_\\2', 'g')"
    s = f"regexp_replace(lower({s}), '[^a-z0-9]+', '_', 'g')"
    return f"regexp_replace({s}, '^_+|_+$', '', 'g')"


MEMBERS_SQL = f"""
parsed as (select run_id, column_name, regexp_extract(column_name, '{_MEMBER}', 1, 'i') as raw_stem,
   lower(regexp_extract(column_name, '{_MEMBER}', 2, 'i')) as keyword,
   try_cast(regexp_extract(column_name, '{_MEMBER}', 3, 'i') as bigint) as idx
  from fleet_columns where regexp_matches(column_name, '[0-9]$') and not regexp_matches(column_name, '(?i)^(unnamed: ?[0-9]+|index)$')),
alike as (select run_id, raw_stem, keyword, case when raw_stem = '' then {x1("keyword")} else {x1("raw_stem")} end as plain_id,
   count(*) as n, list(column_name order by idx, column_name) as cols from parsed group by all),
worded as (select * exclude (plain_id), case when n >= 2 and keyword <> ''
     and row_number() over (partition by run_id, plain_id, n >= 2 order by keyword, raw_stem) > 1 then plain_id || '_' || keyword else plain_id end as word_id from alike),
numbered as (select *, row_number() over (partition by run_id, word_id, n >= 2 order by keyword, raw_stem) as place from worded),
fams as (select * exclude (word_id, place), case when n >= 2 and place > 1 then word_id || '_' || place else word_id end as family_id from numbered)
"""


def catalog_of(tb):
    return tb.input("fleet_columns").withColumnRenamed("column_name", "column")


@query("a8_families", f"""
with {MEMBERS_SQL}
select run_id, family_id, raw_stem, {x1("raw_stem")} as normalized_stem,
 case when keyword <> '' then 'suffix_keyword_numeric' else 'suffix_numeric' end as pattern_kind, keyword as repeat_dim,
 case when keyword <> '' then keyword else 'index' end as recommended_repeat_dimension_name,
 array_to_string(cols, ',') as columns, array_to_string(cols[1:8], ',') as columns_preview, n as columns_count
from fams where n >= 2
""", ("fleet_columns",))
def a8_families(tb):
    found = families.families(catalog_of(tb))
    return found.withColumns({c: F.array_join(c, ",") for c in ("columns", "columns_preview")})


@query("a8_families_index", f"""
with {MEMBERS_SQL}
select run_id, family_id, case when keyword <> '' then 'suffix_keyword_numeric' else 'suffix_numeric' end as patterns, keyword as repeat_dim,
 case when keyword <> '' then keyword else 'index' end as recommended_repeat_dimension_name, n as columns_count
from fams where n >= 2
""", ("fleet_columns",))
def a8_families_index(tb):
    return families.families_index(families.families(catalog_of(tb))).withColumn("patterns", F.array_join("patterns", ","))


@query("g_family_rollup", f"""
with {MEMBERS_SQL}
select run_id, family_id, n as included_column_count, array_to_string(cols[1:3], ',') as included_columns_preview from fams where n >= 2
""", ("fleet_columns",))
def g_family_rollup(tb):
    out = families.rollup(families.families(catalog_of(tb)))
    return out.withColumn("included_columns_preview", F.array_join("included_columns_preview", ","))


@query("a8_near_misses", f"""
with {MEMBERS_SQL}
select run_id, cols[1] as "column", raw_stem, 'single_member' as reason from fams where n = 1
union all select run_id, column_name, null, 'export_index' from fleet_columns where regexp_matches(column_name, '(?i)^(unnamed: ?[0-9]+|index)$')
""", ("fleet_columns",))
def a8_near_misses(tb):
    catalog = catalog_of(tb)
    return families.near_misses(catalog).unionByName(families.rejected_names(catalog), allowMissingColumns=True)


@query("a8_coverage", f"""
with {MEMBERS_SQL},
tot as (select run_id, count(*) as n_columns from fleet_columns group by run_id),
mem as (select run_id, cast(sum(n) as bigint) as nf, count(*) as k from fams where n >= 2 group by run_id)
select t.run_id, n_columns, coalesce(nf, 0) as n_family_columns, coalesce(k, 0) as n_families, round(cast(coalesce(nf, 0) as double) / n_columns, 6) as coverage
from tot t left join mem m on t.run_id = m.run_id
""", ("fleet_columns",))
def a8_coverage(tb):
    catalog = catalog_of(tb)
    return families.coverage(catalog, families.families(catalog))


@query("a8_signatures", f"""
with {MEMBERS_SQL},
f as (select *, case when keyword <> '' then keyword else 'index' end as kw from fams where n >= 2)
select run_id, family_id, raw_stem, {x1("raw_stem")} as normalized_stem, kw as suffix_keyword, upper(kw[1]) || kw[2:] as suffix_keyword_title,
 array_to_string(cols[1:3], ',') as columns_preview, n as columns_count, family_id || ':' || {x1("raw_stem")} as signature_label,
 case when keyword <> '' then '^' || raw_stem || '(' || upper(kw[1]) || kw[2:] || '|' || kw || ')[_-]?[0-9]+$' end as member_regex
from f
""", ("fleet_columns",))
def a8_signatures(tb):
    found = families.families(catalog_of(tb))
    s = families.with_signature(families.families_index(found), found)
    names = ("raw_stem", "normalized_stem", "suffix_keyword", "suffix_keyword_title", "columns_count", "signature_label", "member_regex")
    return s.select("run_id", "family_id", *[f"family_signature.{n}" for n in names],
                    F.array_join("family_signature.columns_preview", ",").alias("columns_preview"))


@query("a8_members_by_signature", f"""
with {MEMBERS_SQL},
sig as (select run_id, family_id, '^' || raw_stem || '(' || upper(keyword[1]) || keyword[2:] || '|' || keyword || ')[_-]?[0-9]+$' as rx from fams where n >= 2 and keyword <> '')
select c.run_id, c.column_name as "column", s.family_id from fleet_columns c join sig s on c.run_id = s.run_id and regexp_matches(c.column_name, s.rx)
""", ("fleet_columns",))
def a8_members_by_signature(tb):
    catalog = catalog_of(tb)
    found = families.families(catalog)
    return families.members_by_signature(catalog, families.with_signature(families.families_index(found), found))


@query("b1_family_packets", f"""
with {MEMBERS_SQL},
mem as (select run_id, family_id, unnest(cols) as column_name from fams where n >= 2)
select m.run_id, m.family_id, string_agg(m.column_name || ':' || cast(c.seed % 20 as varchar) || ':' || cast(c.pick % 101 as varchar), ',' order by try_cast(regexp_extract(m.column_name, '([0-9]+)$', 1) as bigint), m.column_name) as members,
 round(avg(c.pick % 101), 6) as mean_missing_pct, cast(max(case when m.column_name like '%1' then 1 else 0 end) as bigint) as grain_tests_touching_family
from mem m join fleet_columns c on m.run_id = c.run_id and m.column_name = c.column_name group by m.run_id, m.family_id
""", ("fleet_columns",))
def b1_family_packets(tb):
    catalog = catalog_of(tb)
    stats = catalog.selectExpr("run_id", "column", "seed % 20 as unique_count")
    miss = catalog.selectExpr("run_id", "column", "cast(pick % 101 as double) as missing_pct")
    tests = catalog.filter(F.col("column").endswith("1")).groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_set("column")), ",").alias("keys_tested"))
    packed = families.packets(families.families(catalog), stats, miss, tests)
    item = F.transform("members", lambda m: F.concat_ws(":", m["column"], m["unique_count"], m["missing_pct"].cast("bigint")))
    return packed.select("run_id", "family_id", F.array_join(item, ",").alias("members"), "mean_missing_pct", "grain_tests_touching_family")


# ---- roles, skip logic, layouts, baseline ----

_ROLE_CASES = """
 case when u >= 0.99 and n_present = n_rows and greatest(url_share, email_share, words_share, prose_share) < 0.5 and datetime_share < 0.95 then 'id_key'
      when datetime_share >= 0.95 then 'time_index'
      when fam and (numeric_share >= 0.95 or unique_count <= 12) then 'measure_item'
      when numeric_share >= 0.95 and unique_count <= 12 then 'coded_categorical'
      when numeric_share >= 0.95 then 'measure' else 'invariant_attr' end"""
p.FLAGS["words"] = f"coalesce(regexp_matches({p.t()}, '^[A-Za-z][A-Za-z ]*$'), false)"
p.FLAGS["prose"] = f"coalesce(regexp_matches({p.t()}, '[A-Za-z]+ [A-Za-z]+'), false)"
_ROLE_SHARES = p.shares_sql("numeric", "integral", "datetime", "time_of_day", "boolean", "range_like", "numeric_with_unit", "categorical_multi",
                            "percent", "currency", "email", "url", "code", "country", "words", "prose")
_ROLE_SQL = f"""
{p.long_sql("dirty_customer", p.DIRTY)}, {_ROLE_SHARES},
facts as (select *, coalesce(cast(unique_count as double) / nullif(n_present, 0), 0) as u, "column" in ('flag_1', 'flag_2', 'flag_3') as fam from shares),
roles as (select *, {_ROLE_CASES} as primary_role,
  (case when u >= 0.99 and n_present = n_rows and greatest(url_share, email_share, words_share, prose_share) < 0.5 and datetime_share < 0.95 then 1 else 0 end
   + case when datetime_share >= 0.95 then 1 else 0 end + case when fam and (numeric_share >= 0.95 or unique_count <= 12) then 1 else 0 end
   + case when numeric_share >= 0.95 and unique_count <= 12 then 1 else 0 end) >= 2 as review_required from facts)"""


def _members_of(tb):
    df = tb.input("dirty_customer")
    return families.membership(families.families(families.column_catalog(df, "customer")))


@query("a9_roles", f"""
with {_ROLE_SQL}
select 'customer' as run_id, "column", primary_role,
 case primary_role when 'time_index' then 'temporal' when 'measure' then 'numeric' when 'measure_item' then 'ordinal' else 'nominal' end as encoding_type,
 review_required from roles
""", ("dirty_customer",))
def a9_roles(tb):
    return structure.roles(profile.parse_shares(p._hist(tb)), _members_of(tb)).drop("role_candidates")


VISIT = ["customer", "visit", "spent", "order_no", "priority"]
_REPEAT = [(k, c) for k in ("customer", "priority") for c in ("visit", "order_no", "customer") if k != c]


@query("a9_refined_roles", f"""
with {p.long_sql("visits", VISIT)}, {_ROLE_SHARES},
facts as (select *, coalesce(cast(unique_count as double) / nullif(n_present, 0), 0) as u, false as fam from shares),
base as (select *, {_ROLE_CASES} as base_role from facts),
groups as (""" + " union all ".join(
    f"select '{c}' as c, count(*) as n, count(distinct {c}) as d, min({c}) as lo, max({c}) as hi from visits group by {k} having count(*) > 1" for k, c in _REPEAT) + """),
repeats as (""" + " union ".join(
    f"select '{c}' as c from (select count(*) as n, count(distinct {c}) as d, min({c}) as lo, max({c}) as hi from visits group by {k} having count(*) > 1) q having avg((d = n and lo in (0, 1) and hi - lo + 1 = n)::int) >= 0.99"
    for k, c in _REPEAT) + """)
select 'visits' as run_id, "column", case when "column" in (select c from repeats) and base_role in ('coded_categorical', 'measure', 'measure_item') then 'repeat_index'
  when base_role = 'measure' and integral_share < 0.95 then 'measure_numeric' else base_role end as primary_role from base
""", ("visits",))
def a9_refined_roles(tb):
    visits = tb.input("visits")
    shares = cut(profile.parse_shares(profile.cell_histogram(visits, "visits", VISIT)))
    none = tb.spark.createDataFrame([], "run_id string, column string, family_id string")
    repeats = structure.repeat_indexes(visits, "visits", ["customer", "priority"], ["visit", "order_no", "customer"])
    return structure.refined_roles(structure.roles(shares, none), repeats, shares).select("run_id", "column", "primary_role")


TARGETS = [*REFUND, "click_depth", "noise"]
_SKIP_SQL = "long as (" + " union all ".join(
    f"select event_type as level, '{c}' as target, {p.missing(f'cast({c} as varchar)')} as gap from gated_events" for c in TARGETS) + """),
lv as (select target, level, count(*) as n, count(case when gap then 1 end) as m from long group by all),
tot as (select target, sum(n) as all_n, sum(m) as all_m from lv group by target),
conds as (
 select l.target, level, '=' as op, n as cn, m as cm, all_n, all_m from lv l join tot t on l.target = t.target
 union all select l.target, level, '<>', all_n - n, all_m - m, all_n, all_m from lv l join tot t on l.target = t.target),
rules as (select 'events' as run_id, 'event_type' as trigger_column, level as trigger_value, op as trigger_test, target as affected_column,
  round(100.0 * cast(cm as double) / all_m, 6) as missing_explained_pct,
  case when cm::double / cn >= 0.95 and ((all_n - cn) - (all_m - cm))::double / (all_n - cn) >= 0.95 then 'bidirectional'
       when cm::double / cn >= 0.95 then 'forward' else 'partial' end as directionality
  from conds where all_m > 0),
kept as (select * from rules where missing_explained_pct >= 90 and (trigger_test = '=' or directionality <> 'partial'))"""


def _skip(tb):
    return structure.skip_logic(tb.input("gated_events"), "events", ["event_type"], TARGETS)


@query("a16_skip_logic", f"with {_SKIP_SQL} select * from kept", ("gated_events",))
def a16_skip_logic(tb):
    return _skip(tb)


SURVEY_TRIGGERS = ["gender", *[f"a_{k}" for k in range(1, 11)], "gate"]
SURVEY_TARGETS = [f"g_{k}" for k in range(1, 71)]


@query("a16_skip_logic_wide", f"""
with long as (
  select u.t.name as trigger_column, u.t.value as level, g.t.name as target, g.t.gap as gap
  from gated_survey, unnest([{", ".join(f"struct_pack(name := '{c}', value := {c})" for c in SURVEY_TRIGGERS)}]) as u(t),
   unnest([{", ".join(f"struct_pack(name := '{c}', gap := {p.missing(c)})" for c in SURVEY_TARGETS)}]) as g(t)),
lv as (select trigger_column, target, level, count(*) as n, count(case when gap then 1 end) as m from long group by all),
tot as (select trigger_column, target, sum(n) as all_n, sum(m) as all_m from lv group by all),
conds as (
 select trigger_column, target, level, '=' as op, n as cn, m as cm, all_n, all_m from lv join tot using (trigger_column, target)
 union all select trigger_column, target, level, '<>', all_n - n, all_m - m, all_n, all_m from lv join tot using (trigger_column, target)),
rules as (select 'survey' as run_id, trigger_column, level as trigger_value, op as trigger_test, target as affected_column,
  round(100.0 * cast(cm as double) / all_m, 6) as missing_explained_pct,
  case when cm::double / cn >= 0.95 and ((all_n - cn) - (all_m - cm))::double / (all_n - cn) >= 0.95 then 'bidirectional'
       when cm::double / cn >= 0.95 then 'forward' else 'partial' end as directionality
  from conds where all_m > 0 and cn > 0 and all_n > cn)
select * from rules where missing_explained_pct >= 90 and (trigger_test = '=' or directionality <> 'partial')
""", ("gated_survey",))
def a16_skip_logic_wide(tb):
    return structure.all_skip_logic(tb.input("gated_survey"), "survey", SURVEY_TRIGGERS, SURVEY_TARGETS)


@query("a16_skip_summary", f"""
with {_SKIP_SQL}
select run_id, trigger_column, trigger_test, trigger_value, count(*) as affected_column_count, '' as affected_family_ids,
 array_to_string(list(affected_column order by affected_column)[1:5], ',') as sample_affected_columns, min(missing_explained_pct) as missing_explained_pct,
 case when bool_and(directionality = 'bidirectional') then 'bidirectional' when bool_and(directionality <> 'partial') then 'forward' else 'partial' end as directionality
from kept group by all
""", ("gated_events",))
def a16_skip_summary(tb):
    members = families.membership(families.families(families.column_catalog(tb.input("gated_events"), "events")))
    out = structure.skip_summary(_skip(tb), members)
    return out.withColumns({c: F.array_join(c, ",") for c in ("affected_family_ids", "sample_affected_columns")})


@query("a16_master_switch", f"""
with {_SKIP_SQL}
select run_id, trigger_column, trigger_test, trigger_value, count(*) as governed_columns from kept where directionality <> 'partial'
group by all having count(*) >= 5
""", ("gated_events",))
def a16_master_switch(tb):
    return structure.master_switches(_skip(tb))


@query("a12_layout_candidates", f"""
with {_grain_sql()}
select run_id, keys_tested as layout_id, keys_tested as grain, keys_tested as grain_keys,
 (select string_agg(column_name || ':' || case when column_name = 'l_linenumber' then 'line' else 'base' end, ',' order by column_name)
  from (describe lineitem)) as column_placements, cast(10 as bigint) as base_columns, cast(1 as bigint) as child_tables, cast(0 as bigint) as coverage_gap_columns,
 keys_tested = 'l_orderkey,l_linenumber' as preferred_grain_match,
 round(0.6 * uniqueness_rate + 0.3 * (1 - non_key_conflict_group_pct / 100) + case when pivot_safety then 0.1 else 0.0 end, 6) as score,
 case when uniqueness_rate < 1 then 'grain_not_unique' else '' end as ambiguities
from tests
""")
def a12_layout_candidates(tb):
    line = tb.table("lineitem")
    ranked = keys.ranked_grains(keys.grain_tests(line, "lineitem", GRAINS))
    role_rows = families.column_catalog(line, "lineitem").withColumn("primary_role", F.lit(""))
    members = role_rows.filter("column = 'l_linenumber'").select("run_id", "column", F.lit("line").alias("family_id"))
    preferred = line.sparkSession.createDataFrame([("lineitem", ["l_linenumber", "l_orderkey"])], "run_id string, keys array<string>")
    out = structure.layout_candidates(ranked, role_rows, members, preferred)
    placed = F.transform("column_placements", lambda x: F.concat_ws(":", x["column"], x["table"]))
    return out.withColumns({"ambiguities": F.array_join("ambiguities", ","), "grain_keys": F.array_join("grain_keys", ","),
                            "column_placements": F.array_join(placed, ",")})


_A17 = f"""
with {_ROLE_SQL},
kinds as (select *, {p._LADDER_SQL} as kind,
 case when datetime_share >= 0.95 then datetime_share when numeric_share >= 0.95 then numeric_share
      when boolean_share >= 0.95 then boolean_share when range_like_share >= 0.95 then range_like_share
      when numeric_with_unit_share >= 0.95 then numeric_with_unit_share when categorical_multi_share >= 0.5 then categorical_multi_share
      else round(1 - greatest(datetime_share, numeric_share, boolean_share, range_like_share, numeric_with_unit_share, categorical_multi_share), 6) end as conf
 from roles),
miss as (select "column", count(case when lower({p.t()}) in {p._TOKENS} then 1 end) as tokens, 100.0 * cast(count(case when {p.missing()} then 1 end) as double) / count(*) as pct from cells group by "column"),
logical as (select k.*, m.tokens, m.pct,
  case when primary_role = 'id_key' then 'identifier' when primary_role = 'coded_categorical' then 'categorical_code'
       when prose_share >= 0.5 then 'free_text' when kind = 'datetime' and time_of_day_share > 0 then 'datetime' when kind = 'datetime' then 'date'
       when kind = 'boolean' then 'boolean_flag' when kind in ('numeric', 'numeric_with_unit') then 'numeric_measure'
       when kind = 'categorical' then 'nominal_category' when kind = 'text' then 'free_text' else 'mixed_or_ambiguous' end as lt,
  case when pct = 0 then 'no_material_missingness' when tokens > 0 then 'token_missingness_present'
       when pct >= 40 then 'unexplained_high_missingness' when pct < 5 then 'no_material_missingness' else 'mixed_missingness_risk' end as disp
  from kinds k join miss m on k."column" = m."column"),
fin as (select *, case when lt in ('date', 'datetime') then lt when lt = 'boolean_flag' then 'boolean' when lt = 'numeric_measure' and integral_share >= 1 then 'integer'
  when lt = 'numeric_measure' then 'decimal' else 'string' end as st from logical)
select 'customer' as run_id, "column", primary_role as a9_primary_role, lt as recommended_logical_type, st as recommended_storage_type,
 concat_ws(',', 'trim_whitespace', case when tokens > 0 then 'normalize_missing_tokens' end, case when currency_share >= 0.05 then 'strip_numeric_formatting' end,
   case when kind = 'numeric_with_unit' then 'strip_unit_suffix' end, case when percent_share >= 0.5 then 'standardize_percent_scale' end,
   case when st = 'boolean' then 'normalize_boolean_tokens' else 'cast_to_' || st end) as transform_actions,
 disp as missingness_disposition,
 case disp when 'no_material_missingness' then 'no_action_needed' when 'unexplained_high_missingness' then 'review_before_drop' else 'retain_with_caution' end as missingness_handling,
 round(conf, 6) as type_confidence
from fin
"""


@query("a17_baseline", _A17, ("dirty_customer",))
def a17_baseline(tb):
    df = tb.input("dirty_customer")
    hist = cut(profile.cell_histogram(df, "customer", p.DIRTY))
    shares = cut(profile.parse_shares(hist))
    rules = structure.skip_logic(df, "customer", ["nation_code"], ["email", "segment"])
    out = structure.baseline_resolution(
        profile.a2_rows(hist, shares), structure.roles(shares, _members_of(tb)), profile.missingness_catalog(hist),
        profile.semantic_anchors(shares), profile.quality(hist),
        profile.quality(hist).select("run_id", "column", F.lit(False).alias("drift_detected")),
        rules, profile.transform_queue(shares), profile.type_queue(shares))
    return out.select("run_id", "column", "a9_primary_role", "recommended_logical_type", "recommended_storage_type",
                      F.array_join("transform_actions", ",").alias("transform_actions"), "missingness_disposition",
                      "missingness_handling", "type_confidence")
