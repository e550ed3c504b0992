"""Canonical and analysis table queries, page selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight.catalog.registry import query
from tablesight.operators import materialize as m
from tablesight.operators import pages

QTY = [f"Qty_{i}" for i in range(1, 8)]
WAVES = {f"a_{w}": [f"A{w}_Q{i}" for i in range(1, 6)] for w in (1, 2)}
_LONG = "long as (" + " union all ".join(f"select l_orderkey, cast({i} as bigint) as item, \"Qty_{i}\" as response_value from wide_orders" for i in range(1, 8)) + ")"
_WAVE = "waves as (" + " union all ".join(
    f"select respondent_id, 'a_{w}' as wave, cast({i} as bigint) as item, \"A{w}_Q{i}\" as response_value from wide_waves" for w in (1, 2) for i in range(1, 6)) + ")"


def long_orders(tb):
    return m.wide_to_long(tb.input("wide_orders"), ["l_orderkey"], QTY, "item", kind="double")


@query("m_direct_select", """
select o_orderkey, o_custkey, case when o_orderstatus = 'F' then 'f' when o_orderstatus = 'O' then 'o' else 'p' end as o_orderstatus from orders
""")
def m_direct_select(tb):
    return m.direct_select(tb.table("orders"), ["o_orderkey"], ["o_custkey", "o_orderstatus"], {"o_orderstatus": ["lowercase_values"]}, dedupe=True)


@query("m_wide_to_long", f"with {_LONG} select * from long", ("wide_orders",))
def m_wide_to_long(tb):
    return long_orders(tb)


@query("m_reference_extract", "select distinct c_nationkey, n_name, r_name from nation_customers", ("nation_customers",))
def m_reference_extract(tb):
    return m.reference_extract(tb.input("nation_customers"), ["c_nationkey"], ["n_name", "r_name"])


@query("m_reference_conflicts", """
select c_nationkey, count(distinct c_mktsegment) as n_versions from customer group by c_nationkey having count(distinct c_mktsegment) > 1
""")
def m_reference_conflicts(tb):
    return m.reference_conflicts(m.reference_extract(tb.table("customer"), ["c_nationkey"], ["c_mktsegment"]), ["c_nationkey"])


@query("m_event_projection", "select user_id, event_id, ts as event_time, event_type from events")
def m_event_projection(tb):
    return m.event_projection(tb.table("events"), ["user_id", "event_id"], "ts", ["event_type"])


@query("m_residue", "select run_id, column_name as \"column\", assignment_role from bad_assign where assignment_role in ('exclude_from_outputs', 'unresolved')",
       ("fleet_columns", "bad_assign"))
def m_residue(tb):
    return m.residue(tb.input("bad_assign").withColumnRenamed("column_name", "column"))


@query("m_family_merge_wave", f"with {_WAVE} select * from waves", ("wide_waves",))
def m_family_merge_wave(tb):
    return m.merge_waves(tb.input("wide_waves"), ["respondent_id"], WAVES, "item", kind="bigint")


@query("m_wave_distribution", f"with {_WAVE} select wave, item, response_value, count(*) as n from waves group by all", ("wide_waves",))
def m_wave_distribution(tb):
    return m.response_distribution(m.merge_waves(tb.input("wide_waves"), ["respondent_id"], WAVES, "item", kind="bigint"), ["wave", "item"])


def key_of(tb):
    return tb.input("answer_key")


@query("m_answer_key_scoring", f"""
with {_LONG}
select l_orderkey, l.item, response_value, case when response_value is not null then (response_value = key_value)::int end as is_correct,
 response_value is not null as counted, response_value is null as structural_missing
from long l left join answer_key k on l.item = k.item
""", ("wide_orders", "answer_key"))
def m_answer_key_scoring(tb):
    return m.score_answers(long_orders(tb), key_of(tb), ["item"], "exclude_from_score")


_POLICIES = {
    "preserve_structural_missing": ("case when g then r end", "true"),
    "exclude_from_score": ("case when g then r end", "g"),
    "treat_as_incorrect": ("case when g then r else 0 end", "true"),
    "needs_review": ("null", "false"),
}


@query("m_score_policies", f"""
with {_LONG},
s as (select l_orderkey, response_value is not null as g, coalesce(response_value = key_value, false)::int as r from long l left join answer_key k on l.item = k.item),
""" + "p as (" + " union all ".join(f"select l_orderkey, '{n}' as policy, {a} as c, {b} as d, g from s" for n, (a, b) in _POLICIES.items()) + """)
select l_orderkey, policy, cast(sum(case when d then c end) as bigint) as score_sum, count(case when d then 1 end) as n_items, count(case when d then c end) as n_scored,
 count(case when not g then 1 end) as n_missing, round(cast(sum(case when d then c end) as double) / nullif(count(case when d then c end), 0), 6) as score_avg
from p group by all
""", ("wide_orders", "answer_key"))
def m_score_policies(tb):
    parts = None
    for policy in _POLICIES:
        scored = m.score_answers(long_orders(tb), key_of(tb), ["item"], policy)
        one = m.aggregate_scores(scored, ["l_orderkey"]).withColumn("policy", F.lit(policy))
        parts = one if parts is None else parts.unionByName(one)
    return parts


LABELS = {"1": 0, "2": 25, "3": 50, "4": 75, "5": 100}


@query("m_label_scores", f"""
with {_WAVE}
select respondent_id, wave, cast(sum(case when response_value is not null then 25.0 * (response_value - 1) end) as double) as total from waves group by all
""", ("wide_waves",))
def m_label_scores(tb):
    long = m.merge_waves(tb.input("wide_waves"), ["respondent_id"], WAVES, "item", kind="bigint")
    return m.label_scores(long, LABELS, confirmed=True).groupBy("respondent_id", "wave").agg(F.sum("label_score").alias("total"))


@query("m_unconfirmed_labels", f"with {_WAVE} select count(*) as n, cast(0 as bigint) as n_scored from waves", ("wide_waves",))
def m_unconfirmed_labels(tb):
    long = m.merge_waves(tb.input("wide_waves"), ["respondent_id"], WAVES, "item", kind="bigint")
    return m.label_scores(long, LABELS, confirmed=False).agg(F.count(F.lit(1)).alias("n"), F.count("label_score").alias("n_scored"))


@query("m_analysis_mart", f"""
with {_LONG},
s as (select l_orderkey, cast(sum((response_value = key_value)::int) as bigint) as score_sum, count(response_value) as n_items from long l left join answer_key k on l.item = k.item where response_value is not null group by l_orderkey),
e as (select l_orderkey, count(distinct l_partkey) as n_parts from lineitem group by l_orderkey)
select o_orderkey as l_orderkey, o_orderstatus, score_sum, n_items, n_parts from orders o left join s on o.o_orderkey = s.l_orderkey left join e on o.o_orderkey = e.l_orderkey
""", ("wide_orders", "answer_key"))
def m_analysis_mart(tb):
    base = tb.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    scores = m.aggregate_scores(m.score_answers(long_orders(tb), key_of(tb), ["item"], "exclude_from_score"), ["l_orderkey"])
    extra = tb.table("lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("n_parts"))
    return m.analysis_mart(base, [scores.filter("n_items > 0").select("l_orderkey", "score_sum", "n_items"), extra], ["l_orderkey"])


# ---- codebook pages: every conversation is a document and its turns are pages ----

_PAGES = """
pg as (select conv_id as run_id, turn + 1 as page_number, text, length(text) as char_count from conversations),
mk as (select *, contains(lower(text), 'tion') and contains(lower(text), 'ing') as matched from pg),
tg as (select *, lag(matched) over w as lg, lead(matched) over w as ld, bool_or(matched) over (partition by run_id) as anym, row_number() over w as place from mk window w as (partition by run_id order by page_number))
"""


def pages_of(tb):
    return tb.table("conversations").select(F.col("conv_id").alias("run_id"), (F.col("turn") + 1).alias("page_number"), "text",
                                            F.length("text").alias("char_count"))


@query("w_page_selection", f"""
with {_PAGES}
select run_id, page_number, matched, not anym as used_fallback from tg
where case when anym then matched or coalesce(lg, false) or coalesce(ld, false) or char_count < 40 else place <= 4 end
""")
def w_page_selection(tb):
    marked = pages_of(tb).withColumn("matched", F.lower("text").contains("tion") & F.lower("text").contains("ing"))
    return pages.select_pages(marked)


@query("w_page_terms", """
select conv_id as run_id, turn + 1 as page_number, contains(lower(text), 'the') or contains(lower(text), 'les') as matched from conversations
""")
def w_page_terms(tb):
    return pages.mark_pages(pages_of(tb), ["The", "les"]).select("run_id", "page_number", "matched")


_TERMS = ("the", "of", "and", "la", "les", "des")


@query("w_snippet_shortlist", """
with words as (select distinct conv_id as run_id, turn + 1 as page_number, unnest(string_split_regex(lower(text), '[^\\p{L}0-9_]+')) as term from conversations),
h as (select run_id, page_number, count(*) as n_terms from words where term in ('the', 'of', 'and', 'la', 'les', 'des') group by all),
r as (select *, row_number() over (partition by run_id order by n_terms desc, page_number) as rank from h)
select run_id, 'scale' as target_id, page_number, n_terms, cast(rank as integer) as rank from r where rank <= 2
""")
def w_snippet_shortlist(tb):
    docs = pages_of(tb)
    targets = docs.select("run_id").distinct().select("run_id", F.lit("scale").alias("target_id"), F.explode(F.array(*[F.lit(t) for t in _TERMS])).alias("term"))
    return pages.shortlist(docs, targets, 2)
