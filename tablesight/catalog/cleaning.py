"""Cleaning and reshaping queries on messy customer cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight.catalog import profiles as p
from tablesight.catalog.registry import query
from tablesight.functions import transforms
from tablesight.operators import reshape

D = ("dirty_customer",)
T = p.t


def picked(tb, plan):
    return transforms.clean(tb.input("dirty_customer"), plan).select("cust_id", *[c for c in plan if c != "cust_id"])


@query("t_clean_numeric", f"""
select cust_id, cast(case when {p.missing("balance")} then null else {p.number("balance")} end as decimal(38, 9)) as balance,
 cast({p.number("nation_code")} as bigint) as nation_code from dirty_customer
""", D)
def t_clean_numeric(tb):
    return picked(tb, {"balance": ["normalize_missing_tokens", "strip_numeric_formatting", "cast_to_decimal"], "nation_code": ["cast_to_integer"]})


@query("t_clean_dates", f"""
select cust_id, cast({p.a_date("joined")} as date) as joined from dirty_customer
""", D)
def t_clean_dates(tb):
    return picked(tb, {"joined": ["normalize_missing_tokens", "cast_to_date"]})


@query("t_clean_datetimes", """
select event_id, case when event_id % 5 = 0 then null else date_trunc('second', ts) end as stamp from events
""")
def t_clean_datetimes(tb):
    text = F.when(F.col("event_id") % 5 == 0, "2024-02-30 10:00:00").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return transforms.clean(tb.table("events").select("event_id", text.alias("stamp")), {"stamp": ["trim_whitespace", "cast_to_datetime"]})


@query("t_clean_booleans", "select cust_id, lower(active) in ('yes', 'y') as active, flag_1 = '1' as flag_1 from dirty_customer", D)
def t_clean_booleans(tb):
    return picked(tb, {"active": ["normalize_boolean_tokens"], "flag_1": ["normalize_boolean_tokens"]})


@query("t_clean_categories", f"""
select cust_id, lower({T("segment")}) as segment, case when {p.missing("name")} then null else upper({T("name")}) end as name,
 lower(email) as email from dirty_customer
""", D)
def t_clean_categories(tb):
    return picked(tb, {"segment": ["normalize_category_tokens"], "name": ["normalize_missing_tokens", "trim_whitespace", "uppercase_values"],
                       "email": ["lowercase_values"]})


@query("t_titlecase", """
select c_custkey, upper(substring(c_mktsegment, 1, 1)) || lower(substring(c_mktsegment, 2)) as c_mktsegment from customer
""")
def t_titlecase(tb):
    return transforms.clean(tb.table("customer").select("c_custkey", "c_mktsegment"), {"c_mktsegment": ["cast_to_string", "titlecase_values"]})


@query("t_units_percent", """
select cust_id, replace(weight, 'kg', '') as weight, round(cast(replace(discount, '%', '') as double) / 100, 4) as discount,
 regexp_extract(notes, '[-+]?[0-9]*\\.?[0-9]+', 0) as notes from dirty_customer
""", D)
def t_units_percent(tb):
    out = picked(tb, {"weight": ["strip_unit_suffix"], "discount": ["standardize_percent_scale", "cast_to_decimal"], "notes": ["extract_numeric_component"]})
    return out.withColumn("discount", F.round(F.col("discount").cast("double"), 4))


@query("t_decimal_separator", """
select c_custkey, cast(c_custkey as varchar) || '.' || lpad(cast(c_custkey % 100 as varchar), 2, '0') as plain,
 cast(cast(c_custkey % 9 + 1 as bigint) * case when c_custkey % 2 = 0 then 1000 else 1000000 end as varchar) as scaled from customer
""")
def t_decimal_separator(tb):
    rows = tb.table("customer").select("c_custkey", F.concat(
        F.regexp_replace(F.format_number("c_custkey", 0), ",", "."), F.lit(","), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0")).alias("plain"),
        F.concat((F.col("c_custkey") % 9 + 1).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "K").otherwise("M")).alias("scaled"))
    return transforms.clean(rows, {"plain": ["normalize_decimal_separator"], "scaled": ["strip_unit_suffix"]})


@query("t_category_aliases", f"""
with n as (select cust_id, segment, lower({T("segment")}) as alias from dirty_customer)
select cust_id, case alias when 'building' then 'construction' when 'machinery' then 'machines' else segment end as segment from n
""", D)
def t_category_aliases(tb):
    aliases = tb.spark.createDataFrame([("building", "construction"), ("machinery", "machines")], "alias string, canonical string")
    return transforms.map_aliases(tb.input("dirty_customer").select("cust_id", "segment"), "segment", aliases)


@query("h_multiselect_explode", """
select cust_id, cast(i as integer) as token_index, string_split(positions, ', ')[i] as token
from (select cust_id, positions, unnest(range(1, len(string_split(positions, ', ')) + 1)) as i from dirty_customer) q
""", D)
def h_multiselect_explode(tb):
    return reshape.split_multiselect(tb.input("dirty_customer"), ["cust_id"], "positions")


@query("h_multiselect_one_hot", """
select cust_id, list_contains(string_split(positions, ', '), 'RW')::int as positions_rw, list_contains(string_split(positions, ', '), 'ST')::int as positions_st,
 list_contains(string_split(positions, ', '), 'CF')::int as positions_cf from dirty_customer
""", D)
def h_multiselect_one_hot(tb):
    return reshape.multiselect_one_hot(tb.input("dirty_customer"), ["cust_id"], "positions", ["RW", "ST", "CF"])


@query("h_range_split", """
select cust_id, string_split(contract, ' ~ ')[1] as contract_start, string_split(contract, ' ~ ')[2] as contract_end from dirty_customer
""", D)
def h_range_split(tb):
    return reshape.split_range(tb.input("dirty_customer"), "contract").select("cust_id", "contract_start", "contract_end")


@query("h_range_review", """
select cust_id from dirty_customer where cast(string_split(contract, ' ~ ')[1] as int) > cast(string_split(contract, ' ~ ')[2] as int)
""", D)
def h_range_review(tb):
    return reshape.range_review(reshape.split_range(tb.input("dirty_customer"), "contract"), "contract").select("cust_id")


@query("h_unit_report", "select 'kg' as unit, count(*) as n from dirty_customer union all select '%', count(*) from dirty_customer", D)
def h_unit_report(tb):
    df = tb.input("dirty_customer")
    return reshape.unit_report(df, "weight").unionByName(reshape.unit_report(df, "discount"))


@query("h_start_end_violations", """
select count(*) as checked, count(case when o_orderdate > l_shipdate then 1 end) as violations from orders join lineitem on o_orderkey = l_orderkey
""")
def h_start_end_violations(tb):
    joined = tb.table("orders").join(tb.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return reshape.start_end_violations(joined, "o_orderdate", "l_shipdate")


@query("h_review_report", """
with h as (select run_id, unnest(string_split(structural_transform_hints, ',')) as hint from fleet_type where structural_transform_hints <> '')
select run_id, hint, count(*) as n_columns from h group by all
""", ("fleet_columns", "fleet_type"))
def h_review_report(tb):
    from tablesight.catalog.contracts import words

    return reshape.review_report(words(tb.input("fleet_type"), "structural_transform_hints"))
