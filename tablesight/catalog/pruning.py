"""Evidence-view queries over a fleet of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight.catalog import structure as st
from tablesight.catalog.registry import query
from tablesight.operators import families, prune
from tablesight.operators.prune import RoleBuckets, Scope
from tablesight.plans import worker_views

FLEET = ("fleet_columns", "fleet_a2", "fleet_buckets")


def a2_of(tb):
    tokens = F.when(F.col("token_count").isNotNull(), F.create_map(F.lit("n/a"), F.col("token_count"))).otherwise(
        F.create_map().cast("map<string,bigint>"))
    samples = F.create_map(F.lit("random"), F.array(
        F.concat(F.lit("first "), "column"), F.concat(F.lit("second "), "column"), F.lit("third")))
    levels = F.array(F.lit("L0"), F.concat(F.lit("L"), (F.col("seed") % 3 + 1).cast("string")), F.lit("L9"))
    return tb.input("fleet_a2").withColumnRenamed("column_name", "column").withColumns(
        {"missing_tokens_observed": tokens, "a2_samples": samples, "top_levels": levels})


def _picked(df):
    return df.select("run_id", "column")


GROUP = ("case when regexp_matches(column_name, '[0-9]$') then regexp_extract(column_name, '^(.*?)(row|item|wave|q)?[_-]?([0-9]+)$', 1, 'i')"
         " || lower(regexp_extract(column_name, '^(.*?)(row|item|wave|q)?[_-]?([0-9]+)$', 2, 'i')) else column_name end")


def _admitted(lists, extra, seeds=()):
    wanted = [*seeds, *lists]
    place = "case bucket " + " ".join(f"when '{b}' then {i}" for i, b in enumerate(wanted)) + " end"
    names = ", ".join(f"'{b}'" for b in wanted)
    return f"""hits as (select run_id, name, arg_min(rank, {place} * 100000000 + rank) as hit_rank, min({place}) as hit_place from fleet_buckets where bucket in ({names}) group by all),
adm as (select a.*, {GROUP} as grp, hit_place * 1000000 + hit_rank as place, coalesce(hit_place < {len(seeds)}, false) as seeded
  from fleet_a2 a left join hits h on a.run_id = h.run_id and a.column_name = h.name where h.name is not null or {extra})"""


_EXTRA = "is_one_hot_like or high_missingness or token_count is not null"


@query("prune_scope_selector", f"""
with {_admitted(("review_columns", "structural_columns"), _EXTRA)},
ranked as (select *, row_number() over (partition by run_id order by place nulls last, ordinal, column_name) as rn from adm)
select run_id, column_name as "column" from ranked where rn <= 3
""", FLEET)
def prune_scope_selector(tb):
    spec = Scope(lists=("review_columns", "structural_columns"), true=("is_one_hot_like", "high_missingness"),
                 nonempty=("missing_tokens_observed",), total=3)
    return _picked(prune.scope_select(a2_of(tb), spec, tb.input("fleet_buckets")))


@query("prune_thresholds", """
select run_id, column_name as "column" from fleet_a2 where missing_pct >= 70 or unique_count <= 3
""", ("fleet_columns", "fleet_a2"))
def prune_thresholds(tb):
    return _picked(prune.scope_select(a2_of(tb), Scope(at_least={"missing_pct": 70}, at_most={"unique_count": 3})))


@query("prune_group_cap", f"""
with {_admitted(("review_columns",), _EXTRA)},
g as (select *, row_number() over (partition by run_id, grp order by place nulls last, ordinal, column_name) as rg from adm),
t as (select *, row_number() over (partition by run_id order by place nulls last, ordinal, column_name) as rn from g where rg <= 1)
select run_id, column_name as "column" from t where rn <= 3
""", FLEET)
def prune_group_cap(tb):
    spec = Scope(lists=("review_columns",), true=("is_one_hot_like", "high_missingness"),
                 nonempty=("missing_tokens_observed",), per_group=1, total=3)
    return _picked(prune.scope_select(a2_of(tb), spec, tb.input("fleet_buckets")))


@query("prune_seeded_selection", f"""
with {_admitted(("structural_columns",), "high_missingness", ("reviewer_focus_columns", "review_columns"))},
x as (select *, row_number() over (partition by run_id, grp, seeded order by missing_pct, column_name) as lo,
  row_number() over (partition by run_id, grp, seeded order by missing_pct desc, column_name) as hi from adm),
s as (select *, row_number() over (partition by run_id, grp, seeded order by lo > 1 and hi > 1, place nulls last, ordinal, column_name) as rs from x),
k as (select * from s where not seeded or rs <= 2),
u as (select *, row_number() over (partition by run_id, grp, seeded order by lo > 1 and hi > 1, place nulls last, ordinal, column_name) as ru from k),
v as (select *, row_number() over (partition by run_id order by place nulls last, ordinal, column_name) as rn from u where seeded or ru <= 1)
select run_id, column_name as "column" from v where rn <= 5
""", FLEET)
def prune_seeded_selection(tb):
    spec = Scope(lists=("structural_columns",), seeds=("reviewer_focus_columns", "review_columns"), true=("high_missingness",),
                 seeds_per_group=2, standalone_per_group=1, sample_extremes=True, total=5)
    return _picked(prune.scope_select(a2_of(tb), spec, tb.input("fleet_buckets"), severity="missing_pct"))


@query("prune_representative_outlier", f"""
with g as (select *, {GROUP} as grp from fleet_a2),
r as (select *, row_number() over (partition by run_id, grp order by missing_pct, column_name) as lo,
  row_number() over (partition by run_id, grp order by missing_pct desc, column_name) as hi from g)
select run_id, column_name as "column", missing_pct from r where lo = 1 or hi = 1
""", ("fleet_columns", "fleet_a2"))
def prune_representative_outlier(tb):
    a2 = a2_of(tb).select("run_id", "column", "missing_pct")
    return prune.representative_and_outlier(a2, "missing_pct")


@query("a9_role_buckets", """
with r as (select *, row_number() over (partition by run_id, primary_role order by column_name) as rr,
   count(case when primary_role = 'id_key' then 1 end) over (partition by run_id) > 1 as overflow from fleet_roles),
b as (select *, case when primary_role = 'id_key' and rr <= 1 then 0 when primary_role in ('time_index', 'invariant_attr', 'coded_categorical') and rr <= 1 then 1 end as b0 from r),
w as (select *, row_number() over (partition by run_id, review_required and b0 is null and primary_role not in ('measure', 'measure_item') order by column_name) as rv from b),
c as (select *, coalesce(b0, case when review_required and primary_role not in ('measure', 'measure_item') and rv <= 1 then 2 end) as bucket from w),
t as (select *, row_number() over (partition by run_id order by bucket, column_name) as rn from c where bucket is not null)
select run_id, column_name as "column", primary_role, cast(bucket as integer) as bucket, overflow from t where rn <= 3
""", ("fleet_columns", "fleet_roles"))
def a9_role_buckets(tb):
    spec = RoleBuckets(all_of={"id_key": 1}, top={"time_index": 1, "invariant_attr": 1, "coded_categorical": 1}, review_top=1,
                       exclude=("measure", "measure_item"), total=3, overflow_role="id_key")
    rows = tb.input("fleet_roles").withColumnRenamed("column_name", "column")
    return prune.role_buckets(rows, spec).select("run_id", "column", "primary_role", "bucket", "overflow")


@query("a6_best_grain_topk", """
with best as (select run_id, max(column_name) || ',id' as bk from fleet_tests group by run_id),
r as (select t.*, t.keys_tested = b.bk as must_keep, row_number() over (partition by t.run_id order by t.keys_tested = b.bk desc, pivot_safety desc,
   collision_severity_score, non_key_conflict_group_pct, uniqueness_rate desc, keys_tested) as rank from fleet_tests t join best b on t.run_id = b.run_id)
select run_id, keys_tested, must_keep, cast(rank as integer) as rank from r where rank <= 2
""", ("fleet_columns", "fleet_tests"))
def a6_best_grain_topk(tb):
    tests = tb.input("fleet_tests")
    best = tests.groupBy("run_id").agg(F.array(F.lit("id"), F.max("column_name")).alias("keys"))
    return prune.best_safe_topk(tests, best, 2).select("run_id", "keys_tested", "must_keep", "rank")


@query("prune_grounding", """
with p as (select distinct run_id, name from fleet_buckets where bucket = 'review_columns'),
r as (select a.*, row_number() over (partition by a.run_id order by case when p.name is null then 1 else 0 end, ordinal) as rn
  from fleet_a2 a left join p on a.run_id = p.run_id and a.column_name = p.name where unique_count <= 12)
select run_id, column_name as "column", unique_count, 'L0,L' || cast(seed % 3 + 1 as varchar) as top_levels from r where rn <= 2
""", FLEET)
def prune_grounding(tb):
    wanted = tb.input("fleet_buckets").filter("bucket = 'review_columns'")
    view = prune.a2_grounding(a2_of(tb), 12, 2, 2, wanted)["low_cardinality_value_preview"]
    return view.withColumn("top_levels", F.array_join("top_levels", ","))


@query("prune_layout_grounding", """
with l as (select *, column_name as layout_id, seed % 10 as score from fleet_a2),
w as (select run_id, min(column_name) as want from fleet_a2 group by run_id),
r as (select l.*, layout_id = want as m, row_number() over (partition by l.run_id order by layout_id = want desc, score desc, layout_id) as rn
  from l join w on l.run_id = w.run_id)
select run_id, layout_id, m as preferred_grain_match, 'a,' || column_name as column_placements, cast(rn as integer) as rank from r where rn <= 2
""", ("fleet_columns", "fleet_a2"))
def prune_layout_grounding(tb):
    layouts = tb.input("fleet_a2").select(
        "run_id", F.col("column_name").alias("layout_id"), (F.col("seed") % 10).alias("score"),
        F.array("column_name", F.lit("z")).alias("grain_keys"), F.array(F.lit("a"), "column_name", F.lit("c")).alias("column_placements"),
        F.array(F.lit("x")).alias("ambiguities"))
    preferred = tb.input("fleet_a2").groupBy("run_id").agg(F.array(F.lit("z"), F.min("column_name")).alias("keys"))
    out = prune.a12_grounding(layouts, preferred, top=2, placements=2, ambiguities=1)
    return out.select("run_id", "layout_id", "preferred_grain_match", F.array_join("column_placements", ",").alias("column_placements"), "rank")


@query("prune_compact_arrays", """
select run_id, column_name as "column", '{"random":["' || substring('first ' || column_name, 1, 9) || '","' || substring('second ' || column_name, 1, 9) || '"]}' as a2_samples
from fleet_a2
""", ("fleet_columns", "fleet_a2"))
def prune_compact_arrays(tb):
    out = prune.compact_keyed_arrays(a2_of(tb), "a2_samples", 2, 9)
    return out.select("run_id", "column", F.to_json("a2_samples").alias("a2_samples"))


@query("prune_drop_empty", """
select run_id, '{"column":"' || column_name || '"' || case when token_count is not null then ',"missing_tokens_observed":{"n/a":' || cast(token_count as varchar) || '}' else '' end || '}' as payload
from fleet_a2
""", ("fleet_columns", "fleet_a2"))
def prune_drop_empty(tb):
    out = prune.drop_when_empty(a2_of(tb), ["missing_tokens_observed"])
    return out.select("run_id", F.to_json(F.struct("column", "missing_tokens_observed")).alias("payload"))


@query("prune_role_preview", """
select run_id, column_name as "column",
 case when pick % 10 > 5 then 'b:' || cast(pick % 10 as varchar) else 'a:5' end || ',' ||
 case when pick % 10 > 5 then 'a:5' when pick % 10 >= 3 then 'b:' || cast(pick % 10 as varchar) else 'c:3' end as role_candidate_preview
from fleet_a2
""", ("fleet_columns", "fleet_a2"))
def prune_role_preview(tb):
    item = lambda role, score: F.struct(F.lit(role).alias("role"), score.cast("bigint").alias("score"))
    rows = tb.input("fleet_a2").select(
        "run_id", F.col("column_name").alias("column"),
        F.array(item("a", F.lit(5)), item("b", F.col("pick") % 10), item("c", F.lit(3))).alias("role_candidates"))
    out = prune.role_preview(rows, 2)
    text = F.transform("role_candidate_preview", lambda r: F.concat_ws(":", r["role"], r["score"]))
    return out.select("run_id", "column", F.array_join(text, ",").alias("role_candidate_preview"))


def _nested(tb):
    rows = F.array(F.struct(F.col("seed").alias("cell")))
    return tb.input("fleet_a2").select(
        "run_id", F.col("column_name").alias("column"), F.lit("raw").alias("inputs"),
        F.struct(F.array(F.struct(F.lit("head").alias("kind"), rows.alias("rows"))).alias("panels"), F.lit(1).alias("uses")).alias("row_samples"),
        F.struct(F.col("seed").alias("rows"), F.col("pick").alias("kept")).alias("counts"),
        F.array(F.struct(F.col("pick").alias("id"), rows.alias("rows"))).alias("others"),
    )


@query("prune_drop_keys", """
select run_id, '{"column":"' || column_name || '","row_samples":{"panels":[{"kind":"head","rows":[{"cell":' || cast(seed as varchar) || '}]}]},"counts":{"rows":' || cast(seed as varchar)
 || ',"kept":' || cast(pick as varchar) || '},"others":[{"id":' || cast(pick as varchar) || ',"rows":[{"cell":' || cast(seed as varchar) || '}]}]}' as payload
from fleet_a2
""", ("fleet_columns", "fleet_a2"))
def prune_drop_keys(tb):
    out = prune.drop_keys(_nested(tb), ["inputs", "uses"])
    return out.select("run_id", F.to_json(F.struct("column", "row_samples", "counts", "others")).alias("payload"))


@query("prune_drop_guarded", """
select run_id, '{"column":"' || column_name || '","row_samples":{"panels":[{"kind":"head"}],"uses":1},"counts":{"rows":' || cast(seed as varchar)
 || ',"kept":' || cast(pick as varchar) || '},"others":[{"id":' || cast(pick as varchar) || ',"rows":[{"cell":' || cast(seed as varchar) || '}]}]}' as payload
from fleet_a2
""", ("fleet_columns", "fleet_a2"))
def prune_drop_guarded(tb):
    out = prune.drop_guarded(_nested(tb), "rows", worker_views.ROW_HINTS, list_of_objects=True)
    return out.select("run_id", F.to_json(F.struct("column", "row_samples", "counts", "others")).alias("payload"))


@query("prune_limits", """
with r as (select *, row_number() over (partition by run_id order by ordinal) as rn from fleet_a2)
select run_id, column_name as "column", cast(seed as varchar) || '/' || cast(pick as varchar) as nested from r where rn <= 2
""", ("fleet_columns", "fleet_a2"))
def prune_limits(tb):
    inner = F.array("pick", F.lit(0), F.lit(1))
    rows = tb.input("fleet_a2").select(
        "run_id", "ordinal", F.col("column_name").alias("column"),
        F.array(*[F.struct(F.col("seed").alias("s"), inner.alias("b"))] * 2).alias("a"))
    out = prune.first_k(prune.slice_nested(prune.slice_nested(rows, "a", 1), "a[].b", 1), 2)
    text = F.transform("a", lambda x: F.concat_ws("/", x["s"].cast("string"), F.transform(x["b"], lambda v: v.cast("string"))))
    return out.select("run_id", "column", F.array_join(text, ",").alias("nested"))


@query("prune_family_scope", f"""
with {st.MEMBERS_SQL},
f as (select run_id, family_id, n from fams where n >= 2 and family_id in ('a_1', 'q')),
r as (select *, row_number() over (partition by run_id order by family_id) as rn from f)
select run_id, family_id, n as columns_count from r where rn <= 1
""", ("fleet_columns",))
def prune_family_scope(tb):
    found = families.families(st.catalog_of(tb))
    accepted = found.filter(F.col("family_id").isin("a_1", "q")).select("run_id", "family_id")
    return prune.family_scope(found, accepted, 1).select("run_id", "family_id", "columns_count")


@query("prune_reviewer_focus", """
with s as (select run_id, column_name, (pick % 100) <= 65 as a, (seed % 100) <= 70 as b, seed % 11 = 0 as c, pick % 9 = 0 as d, qty % 2 = 0 as e, qty % 3 = 0 as f from fleet_a2),
v as (select *, 3 * a::int + 3 * b::int + 2 * c::int + 2 * d::int + e::int + f::int as severity, a::int + b::int + c::int + d::int + e::int + f::int as signals from s),
r as (select *, row_number() over (partition by run_id order by severity desc, column_name) as rank from v where signals >= 2)
select run_id, column_name as "column", severity, signals, cast(rank as integer) as rank from r where rank <= 2
""", ("fleet_columns", "fleet_a2"))
def prune_reviewer_focus(tb):
    a17 = tb.input("fleet_a2").selectExpr(
        "run_id", "column_name as column", "(pick % 100) / 100.0 as confidence", "(seed % 100) / 100.0 as quality_score",
        "seed % 11 = 0 as drift_detected", "pick % 9 = 0 as skip_logic_protected", "qty % 2 = 0 as type_review_required",
        "qty % 3 = 0 as missingness_review_required")
    return prune.reviewer_focus(a17, 2)


@query("prune_force_include", """
with n as (select run_id, min(column_name) as column_name from fleet_a2 group by run_id
  union select run_id, column_name from fleet_a2 where seed % 5 = 0 union select run_id, 'GhostCol' from fleet_a2)
select n.run_id, n.column_name as "column" from n join fleet_a2 a on n.run_id = a.run_id and n.column_name = a.column_name
""", ("fleet_columns", "fleet_a2"))
def prune_force_include(tb):
    a2 = a2_of(tb).select("run_id", "column", "seed")
    grain = a2.groupBy("run_id").agg(F.array(F.min("column")).alias("keys"))
    references = a2.filter("seed % 5 = 0").select("run_id", F.array("column").alias("keys"))
    parents = a2.select("run_id", F.lit("GhostCol").alias("parent_key"))
    return prune.force_include(grain, references, parents, a2)


@query("prune_auto_scope", """
with q as (
 select run_id, 'review_columns' as bucket, column_name as name, 0 as rank from fleet_a2 where seed % 6 = 0
 union all select run_id, 'review_columns', column_name, 1 from fleet_a2 where seed % 4 = 0
 union all select run_id, 'structural_columns', column_name, 0 from fleet_roles where primary_role in ('id_key', 'time_index')
 union all select run_id, 'skip_trigger_columns', 'gate', 0 from fleet_a2 where pick % 8 = 0
 union all select run_id, 'skip_affected_preview_columns', column_name, row_number() over (partition by run_id order by column_name) from fleet_a2 where pick % 8 = 0
 union all select run_id, 'reviewer_focus_columns', column_name, qty from fleet_a2 where qty % 10 = 0)
select run_id, bucket, name, cast(min(rank) as bigint) as rank from q where bucket <> 'skip_affected_preview_columns' or rank <= 5 group by all
""", ("fleet_columns", "fleet_a2", "fleet_roles"))
def prune_auto_scope(tb):
    a2 = a2_of(tb)
    return prune.auto_scope(
        a2.filter("seed % 6 = 0"), a2.filter("seed % 4 = 0"), tb.input("fleet_roles").withColumnRenamed("column_name", "column"),
        a2.filter("pick % 8 = 0").select("run_id", F.lit("gate").alias("trigger_column"), F.col("column").alias("affected_column")),
        a2.filter("qty % 10 = 0").select("run_id", "column", F.col("qty").alias("rank")))


@query("prune_known_columns", """
select run_id, column_name as "column" from fleet_a2 where seed % 2 = 0 union select run_id, name from fleet_buckets
""", FLEET)
def prune_known_columns(tb):
    return prune.known_columns(a2_of(tb).filter("seed % 2 = 0"), tb.input("fleet_buckets").withColumnRenamed("name", "column"))


@query("prune_review_scope", """
with e as (select distinct run_id, column_name from fleet_a2 where run_id % 3 = 0 and seed % 2 = 0),
u as (select run_id, column_name from fleet_a2 where seed % 5 = 0 union select run_id, name from fleet_buckets)
select run_id, column_name as "column" from e
union all select run_id, column_name from u where run_id not in (select run_id from e)
""", FLEET)
def prune_review_scope(tb):
    a2 = a2_of(tb)
    return prune.review_scope(a2.filter("run_id % 3 = 0 and seed % 2 = 0"), a2.filter("seed % 5 = 0"),
                              tb.input("fleet_buckets").withColumnRenamed("name", "column"))


def _bundle(tb):
    a2 = a2_of(tb)
    per_column = a2.selectExpr("run_id", "ordinal", "column", "missing_pct", "missing_tokens_observed as token_breakdown")
    quality = a2.selectExpr("run_id", "ordinal", "column", "seed % 100 / 100.0 as global_quality_score", "seed % 11 = 0 as drift_detected")
    artifacts = {"A2": a2.drop("seed", "pick", "qty", "token_count"), "A4.per_column": per_column, "A14.columns": quality}
    return artifacts, worker_views.worker_view("type_transform_worker", artifacts, tb.input("fleet_buckets"))


_BUNDLE_SQL = f"""
hits as (select distinct run_id, name from fleet_buckets where bucket in ('review_columns', 'structural_columns')),
rev as (select distinct run_id, name from fleet_buckets where bucket = 'review_columns'),
x as (select a.*, {GROUP} as grp, h.name is not null as sc, r.name is not null as rc from fleet_a2 a
  left join hits h on a.run_id = h.run_id and a.column_name = h.name left join rev r on a.run_id = r.run_id and a.column_name = r.name),
n as (
 select run_id, 'A2' as artifact, grp, 4 as cap from x where sc or {_EXTRA}
 union all select run_id, 'A4.per_column', grp, 8 from x where rc or missing_pct >= 40
 union all select run_id, 'A14.columns', column_name, 8 from x where rc or seed % 11 = 0 or seed % 100 <= 85),
g as (select run_id, artifact, least(count(*), min(cap)) as k from n group by run_id, artifact, grp)
"""


@query("worker_bundle_rows", f"""
with {_BUNDLE_SQL} select run_id, artifact, cast(sum(k) as bigint) as n_rows from g group by all
""", FLEET)
def worker_bundle_rows(tb):
    return prune.accounting(_bundle(tb)[1]).drop("n_bytes")


@query("bundle_accounting", """
with p as (select run_id, 'A4' as artifact, '{"column":"' || column_name || '","unique_count":' || cast(unique_count as varchar) || '}' as payload from fleet_a2)
select run_id, artifact, count(*) as n_rows, cast(sum(strlen(payload)) as bigint) as n_bytes from p group by all
""", ("fleet_columns", "fleet_a2"))
def bundle_accounting(tb):
    return prune.accounting({"A4": a2_of(tb).select("run_id", "column", "unique_count")})


@query("bundle_accounting_delta", """
with a as (select run_id, count(*) as n, cast(sum(strlen('{"column":"' || column_name || '"}')) as bigint) as b from fleet_a2 where seed % 2 = 0 group by run_id),
c as (select run_id, count(*) as n, cast(sum(strlen('{"column":"' || column_name || '"}')) as bigint) as b from fleet_a2 where seed % 3 = 0 group by run_id)
select coalesce(a.run_id, c.run_id) as run_id, 'A2' as artifact, coalesce(a.n, 0) as rows_before, coalesce(a.b, 0) as bytes_before, coalesce(c.n, 0) as rows_after, coalesce(c.b, 0) as bytes_after,
 coalesce(c.n, 0) - coalesce(a.n, 0) as rows_delta, coalesce(c.b, 0) - coalesce(a.b, 0) as bytes_delta
from a full join c on a.run_id = c.run_id
""", ("fleet_columns", "fleet_a2"))
def bundle_accounting_delta(tb):
    a2 = a2_of(tb)
    size = lambda cond: prune.accounting({"A2": a2.filter(cond).select("run_id", "column")})
    return prune.accounting_delta(size("seed % 2 = 0"), size("seed % 3 = 0"))
