"""Column-evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight.catalog.registry import query
from tablesight.operators import profile

DIRTY = ["cust_id", "name", "balance", "segment", "weight", "contract", "positions", "joined", "active",
         "discount", "flag_1", "flag_2", "flag_3", "nation_code", "email", "notes"]
WIDE = ["l_orderkey", *[f"Qty_{i}" for i in range(1, 8)]]
_TOKENS = "('na','n/a','null','none','nan','missing','-','?','unknown')"
TRIM = r"regexp_replace({v}, '^\s+|\s+$', '', 'g')"


def t(v="value"):
    return TRIM.replace("{v}", v)


def blank(v="value"):
    return f"({v} is null or {t(v)} = '')"


def missing(v="value"):
    return f"({v} is null or {t(v)} = '' or lower({t(v)}) in {_TOKENS})"


def number(v="value"):
    plain = t(f"regexp_replace({v}, '[$€£]', '', 'g')")
    return f"case when regexp_full_match({plain}, '[-+]?[0-9]{{1,3}}(,[0-9]{{3}})+([.][0-9]*)?') then replace({plain}, ',', '') else {plain} end"


def is_number(v="value"):
    return f"coalesce(regexp_matches({number(v)}, '^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$'), false)"


def a_date(v="value"):
    s = t(v)
    return (f"(case when regexp_matches({s}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then try_strptime({s}, '%Y-%m-%d')"
            f" when regexp_matches({s}, '^[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}$') then try_strptime({s}, '%Y/%m/%d')"
            f" when regexp_matches({s}, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') then try_strptime({s}, '%m/%d/%Y')"
            f" when regexp_matches({s}, '^[A-Z][a-z]{{2}} [0-9]{{1,2}}, [0-9]{{4}}$') then try_strptime({s}, '%b %-d, %Y')"
            f" when regexp_matches({s}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}$') then try_strptime({s}, '%Y-%m-%d %H:%M:%S')"
            f" when regexp_matches({s}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}$') then try_strptime({s}, '%Y-%m-%dT%H:%M:%S')"
            " end)")


def long_sql(table, columns, name="cells", keep=""):
    parts = [f"select {keep}'{c}' as \"column\", cast(\"{c}\" as varchar) as value from {table}" for c in columns]
    return f"{name} as ({' union all '.join(parts)})"


FLAGS = {
    "numeric": is_number(),
    "integral": f"coalesce(regexp_matches({number()}, '^[-+]?[0-9]+(\\.0*)?$'), false)",
    "datetime": f"{a_date()} is not null",
    "time_of_day": f"coalesce(regexp_matches({t()}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}$'), false)",
    "boolean": f"coalesce(lower({t()}) in ('y','yes','true','t','1','n','no','false','f','0'), false)",
    "range_like": f"coalesce(regexp_matches({t()}, '^[0-9A-Za-z.]+ *(~| to ) *[0-9A-Za-z.]+$'), false)",
    "numeric_with_unit": f"coalesce(regexp_matches({t()}, '^[-+]?[0-9.]+ ?[A-Za-z]+$'), false)",
    "categorical_multi": f"coalesce(regexp_matches({t()}, '[,;|]'), false)",
    "percent": f"coalesce(regexp_matches({t()}, '^[-+]?[0-9.]+ ?%$'), false)",
    "currency": f"coalesce(regexp_matches({t()}, '^[-+]?[$€£]'), false)",
    "email": f"coalesce(regexp_matches({t()}, '^[^@\\s]+@[^@\\s]+\\.[A-Za-z]+$'), false)",
    "url": f"coalesce(regexp_matches({t()}, '^https?://'), false)",
    "code": f"coalesce(regexp_matches({t()}, '^[A-Za-z]+[#_-]?[0-9]+$'), false)",
    "country": f"coalesce(regexp_matches({t()}, '^[A-Z]{{2}}$'), false)",
}


def shares_sql(*keys, source="cells", group='"column"'):
    keys = keys or tuple(FLAGS)
    cols = ",\n  ".join(
        f"round(coalesce(cast(sum(case when not miss and {FLAGS[k]} then 1 else 0 end) as double) / nullif(sum(case when not miss then 1 else 0 end), 0), 0), 6) as {k}_share"
        for k in keys
    )
    return (f"shares as (select {group}, count(*) as n_rows, sum(case when not miss then 1 else 0 end) as n_present,\n"
            f"  count(distinct case when not miss then value end) as unique_count,\n  {cols}\n"
            f"  from (select *, {missing()} as miss from {source}) m group by {group})")


def _hist(tb, name="dirty_customer", columns=DIRTY, run="customer"):
    return profile.cell_histogram(tb.input(name), run, columns)


_STATS = """
with {long}
select 'RUN' as run_id, "column", count(*) as n_rows,
  round(100.0 * cast(sum(case when miss then 1 else 0 end) as double) / count(*), 6) as missing_pct,
  count(distinct case when not miss then value end) as unique_count,
  round(coalesce(cast(count(distinct case when not miss then value end) as double) / nullif(sum(case when not miss then 1 else 0 end), 0), 0), 6) as unique_ratio,
  round(100.0 * cast(sum(case when miss then 1 else 0 end) as double) / count(*), 6) >= 40 as high_missingness
from (select *, {miss} as miss from cells) m group by "column"
"""


def _fill(text, **kw):
    for k, v in kw.items():
        text = text.replace("{" + k + "}", v)
    return text


@query("a2_column_stats", _fill(_STATS, long=long_sql("dirty_customer", DIRTY), miss=missing()).replace("RUN", "customer"),
       ("dirty_customer",))
def a2_column_stats(tb):
    return profile.column_stats(_hist(tb))


@query("a2_column_stats_wide", _fill(_STATS, long=long_sql("wide_orders", WIDE), miss=missing()).replace("RUN", "wide"),
       ("wide_orders",))
def a2_column_stats_wide(tb):
    return profile.column_stats(_hist(tb, "wide_orders", WIDE, "wide"))


@query("a2_column_stats_documents", _fill(_STATS, long=long_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]),
                                          miss=missing()).replace("RUN", "documents"))
def a2_column_stats_documents(tb):
    return profile.column_stats(profile.digest_histogram(tb.table("documents"), "documents"))


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_shipdate"]


@query("a2_column_stats_approx", f"""
with {long_sql("lineitem", LINE)},
counts as (select "column", count(*) as n_rows, count(case when not {missing()} then 1 end) as n_present from cells group by 1)
select 'lineitem' as run_id, "column", n_rows, round(100.0 * (n_rows - n_present) / n_rows, 6) as missing_pct, true as within_bound from counts
""")
def a2_column_stats_approx(tb):
    """The sketch must lie within four of its standard errors of the exact count."""
    line = tb.table("lineitem").select(*LINE)
    exact = profile.column_stats(profile.cell_histogram(line, "lineitem")).select("run_id", "column", F.col("unique_count").alias("exact"))
    both = profile.column_stats_approx(line, "lineitem").join(exact, ["run_id", "column"])
    within = F.abs(F.col("unique_count") - F.col("exact")) <= 4 * 0.02 * F.col("exact")
    return both.select("run_id", "column", "n_rows", "missing_pct", within.alias("within_bound"))


@query("a2_top_levels", f"""
with {long_sql("dirty_customer", DIRTY)},
counted as (select "column", value, count(*) as n from cells where not {missing()} group by all),
ranked as (select *, row_number() over (partition by "column" order by n desc, value) as level_rank from counted)
select 'customer' as run_id, "column", value, n, cast(level_rank as integer) as level_rank from ranked where level_rank <= 8
""", ("dirty_customer",))
def a2_top_levels(tb):
    return profile.top_levels(_hist(tb), 8)


@query("a2_samples", f"""
with {long_sql("dirty_customer", DIRTY)},
vals as (select distinct "column", value from cells where not {missing()}),
ranked as (select *, row_number() over (partition by "column" order by md5(value || '#7'), value) as sample_rank from vals)
select 'customer' as run_id, "column", value, cast(sample_rank as integer) as sample_rank from ranked where sample_rank <= 5
""", ("dirty_customer",))
def a2_samples(tb):
    return profile.samples(_hist(tb), 5, 7)


_LONG = {"documents": ["text", "source"], "pages": ["url", "html"]}


def _long_texts(tb, name):
    df = tb.table(name).select(*_LONG[name])
    return profile.with_texts(profile.digest_histogram(df, name), df, name)


@query("a2_top_levels_pages", f"""
with {long_sql("pages", _LONG["pages"])},
counted as (select "column", value, count(*) as n from cells where not {missing()} group by all),
ranked as (select *, row_number() over (partition by "column" order by n desc, value) as level_rank from counted)
select 'pages' as run_id, "column", value, n, cast(level_rank as integer) as level_rank from ranked where level_rank <= 8
""")
def a2_top_levels_pages(tb):
    """Whole pages that nearly all tie in count and begin alike: found by digests and heads."""
    return profile.top_levels(_long_texts(tb, "pages"), 8)


@query("a2_samples_documents", f"""
with {long_sql("documents", _LONG["documents"])},
vals as (select distinct "column", value from cells where not {missing()}),
ranked as (select *, row_number() over (partition by "column" order by md5(value || '#7'), value) as sample_rank from vals)
select 'documents' as run_id, "column", value, cast(sample_rank as integer) as sample_rank from ranked where sample_rank <= 5
""")
def a2_samples_documents(tb):
    return profile.samples(_long_texts(tb, "documents"), 5)


@query("a2_parse_shares_documents", f"""
with {long_sql("documents", _LONG["documents"])}, {shares_sql("numeric", "datetime", "categorical_multi", "range_like", "email", "code")}
select 'documents' as run_id, "column", n_rows, cast(n_present as bigint) as n_present, unique_count, numeric_share, datetime_share, categorical_multi_share,
  range_like_share, email_share, code_share from shares
""")
def a2_parse_shares_documents(tb):
    """Texts are asked before the shuffle, digests are counted after it."""
    shares = profile.parse_shares(profile.digest_histogram(tb.table("documents").select(*_LONG["documents"]), "documents"))
    return shares.select("run_id", "column", "n_rows", "n_present", "unique_count",
                         *[f"{k}_share" for k in ("numeric", "datetime", "categorical_multi", "range_like", "email", "code")])


@query("a2_missing_tokens", f"""
with {long_sql("dirty_customer", DIRTY)}
select 'customer' as run_id, "column", lower({t()}) as token, count(*) as n
from cells where lower({t()}) in {_TOKENS} group by all
""", ("dirty_customer",))
def a2_missing_tokens(tb):
    return profile.missing_tokens(_hist(tb))


@query("a4_global_tokens", f"""
with {long_sql("dirty_customer", DIRTY)},
per as (select "column", lower({t()}) as token, count(*) as n from cells where lower({t()}) in {_TOKENS} group by all)
select 'customer' as run_id, token, cast(sum(n) as bigint) as n_cells, count(*) as n_columns,
  case when count(*) > 1 then 'global' else 'column_local' end as token_classification
from per group by token
""", ("dirty_customer",))
def a4_global_tokens(tb):
    return profile.global_tokens(_hist(tb))


@query("a2_parseability", f"""
with {long_sql("dirty_customer", DIRTY)}, {shares_sql("numeric", "datetime")}
select 'customer' as run_id, "column", round(100 * numeric_share, 4) as numeric_parseable_pct,
  round(100 * datetime_share, 4) as datetime_parseable_pct from shares
""", ("dirty_customer",))
def a2_parseability(tb):
    return profile.parseability(profile.parse_shares(_hist(tb)))


_LADDER_SQL = """
 case when datetime_share >= 0.95 then 'datetime' when numeric_share >= 0.95 then 'numeric'
      when boolean_share >= 0.95 then 'boolean' when range_like_share >= 0.95 then 'range_like'
      when numeric_with_unit_share >= 0.95 then 'numeric_with_unit' when categorical_multi_share >= 0.5 then 'categorical_multi'
      when unique_count <= 50 or unique_count <= 0.2 * n_present then 'categorical' else 'text' end"""


@query("a2_candidate_type", f"""
with {long_sql("dirty_customer", DIRTY)}, {shares_sql("numeric", "datetime", "boolean", "range_like", "numeric_with_unit", "categorical_multi")}
select 'customer' as run_id, "column", {_LADDER_SQL} as candidate_type,
 case when datetime_share >= 0.95 then datetime_share when numeric_share >= 0.95 then numeric_share
      when boolean_share >= 0.95 then boolean_share when range_like_share >= 0.95 then range_like_share
      when numeric_with_unit_share >= 0.95 then numeric_with_unit_share when categorical_multi_share >= 0.5 then categorical_multi_share
      else round(1 - greatest(datetime_share, numeric_share, boolean_share, range_like_share, numeric_with_unit_share, categorical_multi_share), 6) end as confidence
from shares
""", ("dirty_customer",))
def a2_candidate_type(tb):
    return profile.candidate_types(profile.parse_shares(_hist(tb)))


@query("a2_one_hot_like", f"""
with {long_sql("dirty_customer", DIRTY)}
select 'customer' as run_id, "column",
  count(case when not {missing()} and {t()} not in ('0', '1') then 1 end) = 0
  and count(case when {t()} = '0' then 1 end) > 0 and count(case when {t()} = '1' then 1 end) > 0 as is_one_hot_like
from cells group by "column"
""", ("dirty_customer",))
def a2_one_hot_like(tb):
    return profile.one_hot_like(_hist(tb))


@query("a3t_transform_queue", f"""
with {long_sql("dirty_customer", DIRTY)}, {shares_sql("categorical_multi", "range_like", "numeric_with_unit", "percent", "currency")}
select 'customer' as run_id, "column", reason, share from (
  select "column", 'categorical_multi' as reason, categorical_multi_share as share from shares where categorical_multi_share >= 0.5
  union all select "column", 'range_like', range_like_share from shares where range_like_share >= 0.5
  union all select "column", 'numeric_with_unit', numeric_with_unit_share from shares where numeric_with_unit_share >= 0.5
  union all select "column", 'percent_possible', percent_share from shares where percent_share >= 0.5
  union all select "column", 'currency', currency_share from shares where currency_share >= 0.05) q
""", ("dirty_customer",))
def a3t_transform_queue(tb):
    return profile.transform_queue(profile.parse_shares(_hist(tb)))


@query("a3v_type_queue", f"""
with {long_sql("dirty_customer", DIRTY)}, {shares_sql("numeric", "datetime", "boolean", "range_like", "numeric_with_unit", "categorical_multi")},
readings as (
  select "column", 'numeric' as kind, numeric_share as share from shares
  union all select "column", 'datetime', datetime_share from shares
  union all select "column", 'boolean', boolean_share from shares
  union all select "column", 'range_like', range_like_share from shares
  union all select "column", 'numeric_with_unit', numeric_with_unit_share from shares
  union all select "column", 'categorical_multi', categorical_multi_share from shares),
ranked as (select *, row_number() over (partition by "column" order by share desc, kind) as rn from readings)
select 'customer' as run_id, a."column", a.kind as best_type, a.share as best_share, b.kind as second_type, b.share as second_share
from ranked a join ranked b on a."column" = b."column" and a.rn = 1 and b.rn = 2
where b.share > 0 and a.share - b.share <= 0.5
""", ("dirty_customer",))
def a3v_type_queue(tb):
    return profile.type_queue(profile.parse_shares(_hist(tb)))


@query("a4_missingness", f"""
with {long_sql("dirty_customer", DIRTY)}
select 'customer' as run_id, "column", count(*) as n_rows,
  count(case when {blank()} then 1 end) as parser_na_count,
  count(case when lower({t()}) in {_TOKENS} then 1 end) as token_na_count,
  round(100.0 * cast(count(case when {missing()} then 1 end) as double) / count(*), 6) as missing_pct
from cells group by "column"
""", ("dirty_customer",))
def a4_missingness(tb):
    return profile.missingness_catalog(_hist(tb))


@query("a4_missingness_wide", f"""
with {long_sql("wide_orders", WIDE)}
select 'wide' as run_id, "column", count(*) as n_rows,
  count(case when {blank()} then 1 end) as parser_na_count,
  count(case when lower({t()}) in {_TOKENS} then 1 end) as token_na_count,
  round(100.0 * cast(count(case when {missing()} then 1 end) as double) / count(*), 6) as missing_pct
from cells group by "column"
""", ("wide_orders",))
def a4_missingness_wide(tb):
    return profile.missingness_catalog(_hist(tb, "wide_orders", WIDE, "wide"))


def _flat_anchors(df):
    names = F.array_join(F.transform("detected_anchors", lambda a: a["anchor"]), ",")
    return df.select("run_id", "column", names.alias("anchors"))


def _anchor_sql(source, columns, run):
    return f"""
with {long_sql(source, columns)}, {shares_sql("country", "datetime", "email", "code", "url")}
select '{run}' as run_id, "column", concat_ws(',', case when country_share >= 0.5 then 'COUNTRY' end,
  case when datetime_share >= 0.5 then 'DATE' end, case when email_share >= 0.5 then 'EMAIL' end,
  case when code_share >= 0.5 then 'ID_CODE' end, case when url_share >= 0.5 then 'URL' end) as anchors
from shares"""


@query("a13_anchors", _anchor_sql("dirty_customer", DIRTY, "customer"), ("dirty_customer",))
def a13_anchors(tb):
    return _flat_anchors(profile.semantic_anchors(profile.parse_shares(_hist(tb))))


@query("a13_anchors_pages", _anchor_sql("pages", ["page_id", "url", "html"], "pages"))
def a13_anchors_pages(tb):
    hist = profile.digest_histogram(tb.table("pages"), "pages")
    return _flat_anchors(profile.semantic_anchors(profile.parse_shares(hist)))


@query("a14_quality", f"""
with {long_sql("dirty_customer", DIRTY)},
counted as (select "column", value, {missing()} as miss, count(*) as n,
   case when {is_number()} then 'number' when {a_date()} is not null then 'date'
        when regexp_matches({t()}, '^[A-Za-z][A-Za-z ]*$') then 'words' when regexp_matches({t()}, '^\\S+$') then 'code' else 'text' end as shape
   from cells group by all),
totals as (select "column", sum(n) as n_rows, sum(case when not miss then n else 0 end) as n_present from counted group by "column"),
shapes as (select "column", shape, sum(n) as n from counted where not miss group by all),
top as (select "column", max(n) as n from shapes group by "column"),
ent as (select c."column", sum(-(cast(c.n as double) / t.n_present) * ln(cast(c.n as double) / t.n_present)) as e
        from counted c join totals t on c."column" = t."column" where not miss group by all)
select 'customer' as run_id, t."column",
  round(cast(t.n_present as double) / t.n_rows * (cast(top.n as double) / t.n_present), 6) as global_quality_score,
  abs(round(ent.e, 6)) as entropy,
  round(1 - cast(top.n as double) / t.n_present, 6) as mixedness
from totals t join top on t."column" = top."column" join ent on t."column" = ent."column"
""", ("dirty_customer",))
def a14_quality(tb):
    return profile.quality(_hist(tb))


@query("a14_drift", """
with mid as (select (min(epoch_us(o_orderdate)) + max(epoch_us(o_orderdate))) / 2.0 as middle from orders),
tagged as (select o.*, epoch_us(o_orderdate) > middle as late from orders o cross join mid),
cells as (select 'o_orderstatus' as "column", o_orderstatus as value, late from tagged
          union all select 'o_orderpriority', o_orderpriority, late from tagged
          union all select 'o_custkey', cast(o_custkey as varchar), late from tagged),
hist as (select "column", value, cast(count(case when not late then 1 end) as double) as e, cast(count(case when late then 1 end) as double) as l from cells group by all),
tot as (select "column", sum(e) as et, sum(l) as lt from hist group by "column")
select 'orders' as run_id, h."column", round(sum(abs(e / et - l / lt)) / 2, 6) as drift_distance,
  round(sum(abs(e / et - l / lt)) / 2, 6) > 0.2 as drift_detected
from hist h join tot t on h."column" = t."column" group by h."column"
""")
def a14_drift(tb):
    return profile.drift(tb.table("orders"), "orders", "o_orderdate", ["o_orderstatus", "o_orderpriority", "o_custkey"])


_TIMES, _STATES, _LOADS = ("ordered", "logged"), ("state", "priority"), ("load", "noise")


def _drift_sql(t):
    cells = " union all ".join(f"select '{c}' as c, cast({c} as varchar) as v, late from h_{t}" for c in _STATES)
    ranks = " union all ".join(f"select '{c}' as c, cast({c} as double) as v, late from h_{t}" for c in _LOADS)
    return f"""h_{t} as (select *, epoch_us({t}) > (select (min(epoch_us({t})) + max(epoch_us({t}))) / 2.0 from two_times) as late from two_times),
s_{t} as (select c, v, cast(count(case when not late then 1 end) as double) as e, cast(count(case when late then 1 end) as double) as l from ({cells}) q group by all),
d_{t} as (select '{t}' as time_column, c, 'shares' as method, round(sum(abs(e / et - l / lt)) / 2, 6) as distance from (select *, sum(e) over (partition by c) as et, sum(l) over (partition by c) as lt from s_{t}) q group by c),
n_{t} as (select c, v, cast(count(case when not late then 1 end) as double) as e, cast(count(case when late then 1 end) as double) as l from ({ranks}) q group by all),
k_{t} as (select '{t}' as time_column, c, 'ranks' as method, max(abs(gap)) as distance from (
  select c, sum(e) over w / sum(e) over (partition by c) - sum(l) over w / sum(l) over (partition by c) as gap from n_{t} window w as (partition by c order by v)) q group by c)"""


@query("a14_drift_all_times", "with " + ",\n".join(_drift_sql(t) for t in _TIMES) + """
select 'orders' as run_id, time_column, c as "column", method, case when method = 'shares' then distance end as share_distance, distance > 0.2 as drift_detected
from (""" + " union all ".join(f"select * from {k}_{t}" for t in _TIMES for k in "dk") + ") u", ("two_times",))
def a14_drift_all_times(tb):
    """Distances of shares are exact; those of ranks come from a sketch, so only their verdict is compared."""
    out = profile.all_drift(tb.input("two_times"), "orders", list(_TIMES), list(_STATES), list(_LOADS))
    return out.select("run_id", "time_column", "column", "method", F.when(F.col("method") == "shares", F.col("drift_distance")).alias("share_distance"), "drift_detected")


@query("a11_glimpses", """
with base as (select event_id as row_key, event_type, cast(user_id as varchar) as user_id, props from events),
ranked as (
  select 'head' as panel, *, row_number() over (order by row_key) as panel_rank from base
  union all select 'tail', *, row_number() over (order by row_key desc) from base
  union all select 'random', *, row_number() over (order by md5(cast(row_key as varchar) || '#7'), row_key) from base)
select 'events' as run_id, panel, cast(panel_rank as integer) as panel_rank, row_key, event_type, user_id, props from ranked where panel_rank <= 3
""")
def a11_glimpses(tb):
    return profile.glimpses(tb.table("events"), "events", "event_id", ["event_type", "user_id", "props"])
