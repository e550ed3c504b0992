"""Reading, manifests, artifact storage and light-contract sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight.catalog.registry import query
from tablesight.plans.shared import scratch_folder
from tablesight.sources import sheets, store, tables


def col(df):
    return df.withColumnRenamed("column_name", "column")


@query("s_ingest_delimited", """
select cast(doc_id as varchar) as doc_id, lang, length(text) as n_text, md5(text) as digest, case when doc_id % 2 = 0 then '$1,234.50 ' else '2025-02-30' end as cell from documents
""")
def s_ingest_delimited(tb):
    folder = scratch_folder(tb.spark, "delimited")
    cell = F.when(F.col("doc_id") % 2 == 0, "$1,234.50 ").otherwise("2025-02-30")
    tb.table("documents").select("doc_id", "lang", "text", cell.alias("cell")).write.option("header", True).option("escape", '"').option(
        "quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    raw = tables.ingest_delimited(tb.spark, folder)
    return raw.select("doc_id", "lang", F.length("text").cast("bigint").alias("n_text"), F.md5("text").alias("digest"), "cell")


@query("s_manifest", """
select c_nationkey as run_id, count(*) as n_rows, cast(5 as bigint) as n_columns, 'customer' as source, 1 as n_checksums, true as order_free,
 '{"c_custkey":"bigint","c_name":"string","c_nationkey":"int","c_acctbal":"double","c_mktsegment":"string"}' as schema_json
from customer group by c_nationkey
""")
def s_manifest(tb):
    """The checksum itself is Spark's own hash, so it is compared with that of the same rows in another order."""
    customer = tb.table("customer")
    one = tables.manifest(customer, F.col("c_nationkey"), "customer")
    other = tables.manifest(customer.orderBy(F.desc("c_name")), F.col("c_nationkey"), "customer").select("run_id", F.col("content_checksum").alias("again"))
    return one.join(other, "run_id").select("run_id", "n_rows", "n_columns", "source", F.lit(1).alias("n_checksums"),
                                            (F.col("content_checksum") == F.col("again")).alias("order_free"), "schema_json")


@query("s_artifact_store", """
select c_nationkey as run_id, 'A2' as artifact_id, count(*) as n_rows from customer group by c_nationkey
union all select c_nationkey, 'A4', count(*) from customer where c_acctbal > 1000 group by c_nationkey
""")
def s_artifact_store(tb):
    folder = scratch_folder(tb.spark, "artifacts")
    rows = tb.table("customer").withColumnRenamed("c_nationkey", "run_id")
    tables.write_artifacts({"A2": rows, "A4": rows.filter("c_acctbal > 1000")}, folder)
    return tables.catalog({a: tables.read_artifact(tb.spark, folder, a) for a in ("A2", "A4")})


@query("s_artifact_meta", "select c_nationkey as run_id, 'A2' as artifact_id, count(*) as n_rows from customer where c_nationkey = 3 group by c_nationkey")
def s_artifact_meta(tb):
    rows = tb.table("customer").withColumnRenamed("c_nationkey", "run_id")
    return tables.artifact_meta({"A2": rows}, "A2", 3)


@query("s_committed_store", """
with r as (select c_nationkey as run_id, count(*) as n, count(case when c_acctbal > 1000 then 1 end) as rich from customer group by c_nationkey)
select cast(run_id as varchar) as run_id, 'A2' as artifact_id, n as n_rows, true as unchanged from r where run_id % 3 < 2
union all select cast(run_id as varchar), 'A4', rich, true from r where run_id % 3 < 2 and rich > 0
""")
def s_committed_store(tb):
    """Two commits, and one that broke off before its manifest row."""
    folder = scratch_folder(tb.spark, "store")
    rows = tb.table("customer").withColumnRenamed("c_nationkey", "run_id")
    for part in (0, 1):
        own = rows.filter(F.col("run_id") % 3 == part)
        store.commit_runs({"A2": own, "A4": own.filter("c_acctbal > 1000")}, folder)
    store.write_data({"A2": rows.filter("run_id % 3 = 2")}, folder, "broken")
    same = store.verified(tb.spark, folder, "A2").unionByName(store.verified(tb.spark, folder, "A4"))
    return store.listed(tb.spark, folder).join(same, ["run_id", "artifact_id"])


@query("s_retention", """
select o_orderkey as run_id, o_orderdate as run_ts, o_orderdate >= timestamp '2000-06-30' - interval 14 day as keep from orders
""")
def s_retention(tb):
    runs = tb.table("orders").selectExpr("o_orderkey as run_id", "o_orderdate as run_ts")
    as_of = F.lit("2000-06-30").cast("timestamp_ntz")
    return tables.retained(runs, as_of).withColumn("keep", F.lit(True)).unionByName(
        tables.expired(runs, as_of).withColumn("keep", F.lit(False)))


@query("s_compact_json", """
select n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || cast(n_regionkey as varchar) || '}' as payload from nation
""")
def s_compact_json(tb):
    return tables.compact_json(tb.table("nation"), "n_nationkey")


@query("s_normalize_rows", """
with d as (select c_custkey as k, c_custkey % 4 as s, c_name as n, c_nationkey as x from customer)
select k as run_id, r as row_index, c as column_index, header, value from (
 select k, 0 as r, 0 as c, 'name' as header, n as value from d where s = 0 union all select k, 0, 1, 'code', cast(x as varchar) from d where s = 0
 union all select k, 0, 2, 'extra', '' from d where s = 0 union all select k, 1, 0, 'name', 'other' from d where s = 0
 union all select k, 1, 1, 'code', '' from d where s = 0 union all select k, 1, 2, 'extra', cast(k as varchar) from d where s = 0
 union all select k, 0, 0, 'a', n from d where s = 1 union all select k, 0, 1, 'b', cast(x as varchar) from d where s = 1
 union all select k, 0, 0, 'h1', n from d where s = 2 union all select k, 0, 1, 'h2', cast(x as varchar) from d where s = 2
 union all select k, 0, 0, 'Col1', n from d where s = 3 union all select k, 0, 1, 'Col2', cast(x as varchar) from d where s = 3) q
""")
def s_normalize_rows(tb):
    text = """case c_custkey % 4
      when 0 then concat('[{"name":"', c_name, '","code":', c_nationkey, '},{"name":"other","extra":', c_custkey, '}]')
      when 1 then concat('{"columns":["a","b"],"rows":[["', c_name, '",', c_nationkey, ']]}')
      when 2 then concat('[["h1","h2"],["', c_name, '",', c_nationkey, ']]')
      else concat('[["', c_name, '",', c_nationkey, ']]') end as raw"""
    return sheets.normalize_rows(tb.table("customer").selectExpr("c_custkey as run_id", text))


@query("s_sheet_reader", """
select case when event_id % 3 <> 0 then event_type end as status, case when event_id % 2 = 0 then cast(event_id as varchar) else '' end as comments
from events where event_id % 3 <> 0 or event_id % 2 = 0
""")
def s_sheet_reader(tb):
    raw = tb.table("events").select(
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias(" status "),
        F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("").alias("comments"), F.lit("").alias(" "))
    return sheets.read_sheet(raw)


@query("s_contract_metadata", """
select o_orderkey as document, 'run_' || cast(o_orderkey as varchar) as run_id, o_orderstatus as generated_at, cast(null as varchar) as source_endpoint from orders
""")
def s_contract_metadata(tb):
    orders = tb.table("orders")
    section = lambda name, value: orders.select(F.col("o_orderkey").alias("document"), F.lit(name).alias("section"), value.alias("details"))
    readme = section(" run_id ", F.concat(F.lit("run_"), F.col("o_orderkey").cast("string"))).unionByName(
        section("generated_at", F.col("o_orderstatus"))).unionByName(section("about", F.lit("prose")))
    return sheets.metadata(readme)


@query("s_column_guide", """
select c.run_id, cast(c.ordinal + 1 as varchar) as column_index, c.column_name, coalesce(m.family_id, '') as family_id, '' as notes
from fleet_columns c left join fleet_members m on c.run_id = m.run_id and c.column_name = m.column_name
""", ("fleet_columns", "fleet_members"))
def s_column_guide(tb):
    guide = sheets.column_guide(col(tb.input("fleet_columns")), col(tb.input("fleet_members")))
    return sheets.sheet_rows(guide, "column_guide")


@query("s_gate_sheet", """
select run_id, column_name as trigger_column, 'No' as trigger_value, cast(seed % 9 as varchar) as affected_column_count,
 case when pick % 2 = 0 then 'a_1, q' else '' end as affected_family_ids, '' as missing_explained_pct, '' as directionality, '' as interpretation
from fleet_columns
""", ("fleet_columns",))
def s_gate_sheet(tb):
    rows = tb.input("fleet_columns").select(
        "run_id", F.col("column_name").alias("trigger_column"), F.lit("No").alias("trigger_value"), (F.col("seed") % 9).alias("affected_column_count"),
        F.when(F.col("pick") % 2 == 0, F.array(F.lit("a_1"), F.lit("q"))).alias("affected_family_ids"))
    return sheets.sheet_rows(rows, "structural_gates")


@query("s_contract_decisions", """
with g as (select run_id, min(column_name) as a, max(column_name) as b, min(seed) as s from fleet_columns group by run_id)
select run_id, 'primary' as kind, '' as target, case when s % 3 = 0 then b else a || case when s % 2 = 0 then ',' || b else '' end end as keys, 'accept' as status from g
union all select distinct run_id, 'family', family_id, case when run_id % 2 = 0 then 'mine' else family_id || '_rows' end, 'reject' from fleet_members
union all select run_id, 'reference', 'dim', a, 'unsure' from g
""", ("fleet_columns", "fleet_members"))
def s_contract_decisions(tb):
    g = tb.input("fleet_columns").groupBy("run_id").agg(F.min("column_name").alias("a"), F.max("column_name").alias("b"), F.min("seed").alias("s"))
    rows = g.select(
        "run_id", F.lit("dim").alias("table_name"), F.col("a").alias("recommended_key_1"), F.when(F.col("s") % 2 == 0, F.col("b")).otherwise(" ").alias("recommended_key_2"),
        F.lit(None).cast("string").alias("recommended_key_3"), F.when(F.col("s") % 3 == 0, F.col("b")).otherwise("").alias("your_key_1"),
        F.lit("").alias("your_key_2"), F.lit("").alias("your_key_3"), F.lit(" Accept ").alias("status"), F.lit("").alias("comments"))
    join = F.array_join("keys", ",")
    primary = sheets.grain_decision(rows).select("run_id", F.lit("primary").alias("kind"), F.lit("").alias("target"), join.alias("keys"), "status")
    dims = rows.withColumns({"recommended_key_2": F.lit(""), "your_key_1": F.lit(""), "status": F.lit("Unsure")})
    refs = sheets.reference_decisions(dims).select("run_id", F.lit("reference").alias("kind"), F.col("table_name").alias("target"), join.alias("keys"), "status")
    fams = tb.input("fleet_members").select("run_id", "family_id").distinct().select(
        "run_id", "family_id", F.concat("family_id", F.lit("_rows")).alias("recommended_table_name"),
        F.when(F.col("run_id") % 2 == 0, " mine ").otherwise("").alias("your_table_name"), F.lit("row").alias("recommended_repeat_index_name"),
        F.lit("").alias("your_repeat_index_name"), F.lit("id").alias("recommended_parent_key"), F.lit("").alias("your_parent_key"),
        F.lit("reject").alias("status"), F.lit("").alias("comments"))
    families = sheets.family_decisions(fams).select("run_id", F.lit("family").alias("kind"), F.col("family_id").alias("target"), F.col("table_name").alias("keys"), "status")
    return primary.unionByName(refs).unionByName(families)
