"""Repeat families found from column names, for one dataset or a fleet of them.

Input is the column catalogue ``(run_id, ordinal, column)``. Groups are sibling columns of one
dataset, so a group is never larger than one table is wide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesight.functions import cells

# Stem, optional repeat keyword, optional separator, running number.
MEMBER = r"(?i)^(.*?)(row|item|wave|q)?[_-]?([0-9]+)$"
PREVIEW = 8


def column_catalog(df: DataFrame, run_id: str) -> DataFrame:
    """The column names of one dataset as rows."""
    rows = [(run_id, i, c) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "run_id string, ordinal int, column string")


def parsed_names(catalog: DataFrame) -> DataFrame:
    """Name parts of each column; ``numbered`` is false when there is no trailing number."""
    name = F.col("column")
    stem, keyword = F.regexp_extract(name, MEMBER, 1), F.lower(F.regexp_extract(name, MEMBER, 2))
    return catalog.select(
        "run_id", "column",
        name.rlike(cells.EXPORT_INDEX).alias("is_export_index"),
        (F.regexp_extract(name, MEMBER, 3) != "").alias("numbered"),
        stem.alias("raw_stem"), keyword.alias("keyword"),
        F.regexp_extract(name, MEMBER, 3).try_cast("bigint").alias("repeat_index"),
    )


def _members(catalog: DataFrame) -> DataFrame:
    return parsed_names(catalog).filter(F.col("numbered") & ~F.col("is_export_index")).withColumn(
        "family_id",
        F.when(F.col("raw_stem") == "", cells.family_id(F.col("keyword"))).otherwise(
            cells.family_id(F.col("raw_stem"))),
    )


def families(catalog: DataFrame) -> DataFrame:
    """One row per family with its signature fields and ordered members.

    An id is used once per run: of families whose names come out alike, the later ones are told apart
    by their keyword, and if that is not enough by a number.
    """
    packed = F.array_sort(F.collect_list(F.struct("repeat_index", "column")))
    grouped = _members(catalog).groupBy("run_id", "raw_stem", "keyword", "family_id").agg(
        F.transform(packed, lambda m: m["column"]).alias("columns"))
    alike = Window.partitionBy("run_id", "family_id").orderBy("keyword", "raw_stem")
    place = lambda: F.row_number().over(alike)
    named = grouped.filter(F.size("columns") >= 2).withColumn("place", place()).withColumn(
        "family_id", F.when((F.col("place") > 1) & (F.col("keyword") != ""), F.concat_ws("_", "family_id", "keyword")).otherwise(F.col("family_id")))
    distinct = named.withColumn("place", place()).withColumn(
        "family_id", F.when(F.col("place") > 1, F.concat_ws("_", "family_id", F.col("place").cast("string"))).otherwise(F.col("family_id")))
    return distinct.select(
        "run_id", "family_id", "raw_stem",
        cells.family_id(F.col("raw_stem")).alias("normalized_stem"),
        F.when(F.col("keyword") != "", "suffix_keyword_numeric").otherwise("suffix_numeric").alias("pattern_kind"),
        F.col("keyword").alias("repeat_dim"),
        F.when(F.col("keyword") != "", F.col("keyword")).otherwise("index").alias("recommended_repeat_dimension_name"),
        "columns", F.slice("columns", 1, PREVIEW).alias("columns_preview"),
        F.size("columns").cast("long").alias("columns_count"),
    )


def families_index(found: DataFrame) -> DataFrame:
    return found.select("run_id", "family_id", F.array("pattern_kind").alias("patterns"), "repeat_dim",
                        "recommended_repeat_dimension_name", "columns_count")


def near_misses(catalog: DataFrame) -> DataFrame:
    """Numbered columns that stand alone, so no family was formed."""
    return _members(catalog).groupBy("run_id", "raw_stem", "keyword").agg(
        F.count(F.lit(1)).alias("n"), F.min("column").alias("column")
    ).filter(F.col("n") == 1).select("run_id", "column", "raw_stem", F.lit("single_member").alias("reason"))


def rejected_names(catalog: DataFrame) -> DataFrame:
    return parsed_names(catalog).filter("is_export_index").select(
        "run_id", "column", F.lit("export_index").alias("reason"))


def membership(found: DataFrame) -> DataFrame:
    """run_id, column, family_id and the member's running number."""
    return found.select("run_id", "family_id", F.explode("columns").alias("column")).select(
        "run_id", "column", "family_id",
        F.regexp_extract("column", MEMBER, 3).cast("bigint").alias("repeat_index"))


def coverage(catalog: DataFrame, found: DataFrame) -> DataFrame:
    """Share of each dataset's columns that belong to a family."""
    total = catalog.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_columns"))
    members = found.groupBy("run_id").agg(F.sum("columns_count").alias("n_family_columns"),
                                          F.count(F.lit(1)).alias("n_families"))
    out = total.join(members, "run_id", "left").na.fill(0, ["n_family_columns", "n_families"])
    return out.withColumn("coverage", F.round(F.col("n_family_columns") / F.col("n_columns"), 6))


def rollup(found: DataFrame, preview: int = 3) -> DataFrame:
    return found.select("run_id", "family_id", F.col("columns_count").alias("included_column_count"),
                        F.slice("columns_preview", 1, preview).alias("included_columns_preview"))


def with_signature(index: DataFrame, found: DataFrame, preview: int = 3) -> DataFrame:
    """Enrich the compact family index with a membership signature taken from the full families."""
    right = found.select(
        "run_id", "family_id", "raw_stem", "normalized_stem", F.col("pattern_kind").alias("kind"),
        F.slice("columns_preview", 1, min(preview, PREVIEW)).alias("columns_preview"),
        F.col("columns_count").alias("n"),
    )
    keyword = F.coalesce(F.when(F.col("repeat_dim") != "", F.col("repeat_dim")),
                         F.col("recommended_repeat_dimension_name"))
    kind = F.coalesce(F.col("kind"), F.element_at("patterns", 1))
    regex = F.when(kind == "suffix_keyword_numeric",
                   F.concat(F.lit("^"), "raw_stem", F.lit("("), F.initcap(keyword), F.lit("|"), keyword,
                            F.lit(")[_-]?[0-9]+$")))
    return index.join(right, ["run_id", "family_id"], "left").select(
        *index.columns,
        F.struct(
            "normalized_stem", "raw_stem", kind.alias("pattern_kind"), keyword.alias("suffix_keyword"),
            F.initcap(keyword).alias("suffix_keyword_title"), "columns_preview", F.col("n").alias("columns_count"),
            cells.fill_template(F.col("family_id"), F.col("normalized_stem")).alias("signature_label"),
            regex.alias("member_regex"),
        ).alias("family_signature"),
    )


def members_by_signature(catalog: DataFrame, signed: DataFrame) -> DataFrame:
    """Columns that match a family's member pattern.

    The pattern is a literal prefix plus a running number, so the lookup is an equi join on the
    prefix instead of testing every column against every pattern.
    """
    sig = F.col("family_signature")
    prefixes = signed.filter(sig["member_regex"].isNotNull()).select(
        "run_id", "family_id",
        F.explode(F.array_distinct(F.array(
            F.concat(sig["raw_stem"], sig["suffix_keyword_title"]),
            F.concat(sig["raw_stem"], sig["suffix_keyword"])))).alias("prefix"))
    number = r"[_-]?[0-9]+$"
    return (
        catalog.filter(F.col("column").rlike(number))
        .select("run_id", "column", F.regexp_replace("column", number, "").alias("prefix"))
        .join(prefixes, ["run_id", "prefix"]).select("run_id", "column", "family_id")
    )


def packets(found: DataFrame, stats: DataFrame, missingness: DataFrame, tests: DataFrame) -> DataFrame:
    """One evidence packet per family: members with counts and missingness, the index map, and the
    grain tests that use a member."""
    members = membership(found)
    evidence = (
        members.join(stats.select("run_id", "column", "unique_count"), ["run_id", "column"], "left")
        .join(missingness.select("run_id", "column", "missing_pct"), ["run_id", "column"], "left")
    )
    item = F.struct("repeat_index", "column", "unique_count", "missing_pct")
    packed = evidence.groupBy("run_id", "family_id").agg(
        F.array_sort(F.collect_list(item)).alias("members"),
        F.round(F.avg("missing_pct"), 6).alias("mean_missing_pct"),
    )
    touching = (
        tests.select("run_id", "keys_tested", F.explode(F.split("keys_tested", ",")).alias("column"))
        .join(members, ["run_id", "column"]).groupBy("run_id", "family_id")
        .agg(F.count_distinct("keys_tested").alias("grain_tests_touching_family"))
    )
    return packed.join(touching, ["run_id", "family_id"], "left").select(
        "run_id", "family_id", "members", "mean_missing_pct",
        F.map_from_entries(F.transform("members", lambda m: F.struct(m["column"], m["repeat_index"]))).alias("index_by_column"),
        F.coalesce("grain_tests_touching_family", F.lit(0)).alias("grain_tests_touching_family"),
    )
