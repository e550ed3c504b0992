"""Light-contract sheets as row sets: normalising, reading, parsing and projecting them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesight.functions import cells

# Sheet columns in their published order.
SHEETS: dict[str, tuple[str, ...]] = {
    "column_guide": ("column_index", "column_name", "family_id", "notes"),
    "grain_summary": ("topic", "recommendation", "why", "needs_review"),
    "primary_grain": ("item", "recommended_key_1", "recommended_key_2", "recommended_key_3", "your_key_1", "your_key_2",
                      "your_key_3", "status", "comments"),
    "dimension_tables": ("table_name", "recommended_key_1", "recommended_key_2", "recommended_key_3", "your_key_1", "your_key_2",
                         "your_key_3", "relationship_to_primary", "status", "comments"),
    "repeat_families": ("family_id", "recommended_table_name", "your_table_name", "recommended_repeat_index_name",
                        "your_repeat_index_name", "recommended_parent_key", "your_parent_key", "status", "comments"),
    "structural_gates": ("trigger_column", "trigger_value", "affected_column_count", "affected_family_ids",
                         "missing_explained_pct", "directionality", "interpretation"),
    "scale_mappings": ("target_kind", "target_id", "response_scale_kind", "ordered_labels_low_to_high",
                       "numeric_scores_low_to_high", "notes"),
    "overrides": ("field", "description", "user_input"),
}
METADATA = ("run_id", "generated_at", "source_endpoint")


def sheet_rows(df: DataFrame, sheet: str, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """A sheet's columns in fixed order with blanks for what is absent; arrays are joined by comma."""
    kinds = dict(df.dtypes)

    def cell(name: str) -> Column:
        if name not in kinds:
            return F.lit("").alias(name)
        text = F.array_join(name, ", ") if kinds[name].startswith("array") else F.col(name).cast("string")
        return F.coalesce(text, F.lit("")).alias(name)

    return df.select(*[F.col(k) for k in keys], *[cell(c) for c in SHEETS[sheet]])


def read_sheet(df: DataFrame) -> DataFrame:
    """Trim headers, drop columns without a header, skip rows with nothing in them."""
    named = [(c, c.strip()) for c in df.columns if c.strip() and not c.startswith("_c")]
    filled = F.lit(False)
    for c in df.columns:
        value = F.col(f"`{c}`")
        filled = filled | (value.isNotNull() & (value.cast("string") != ""))
    return df.filter(filled).select(*[F.col(f"`{c}`").alias(n) for c, n in named])


def metadata(readme: DataFrame, document: str = "document") -> DataFrame:
    """The identity fields of each workbook's first sheet, one row per document."""
    section = F.trim("section")
    return readme.groupBy(document).agg(*[
        F.max(F.when(section == m, F.coalesce("details", F.lit("")))).alias(m) for m in METADATA])


def column_guide(catalog: DataFrame, members: DataFrame) -> DataFrame:
    """Columns in order with the family each belongs to."""
    joined = catalog.select("run_id", "ordinal", "column").join(members.select("run_id", "column", "family_id"), ["run_id", "column"], "left")
    return joined.select("run_id", (F.col("ordinal") + 1).alias("column_index"), F.col("column").alias("column_name"),
                         F.coalesce("family_id", F.lit("")).alias("family_id"), F.lit("").alias("notes"))


def _chosen_keys() -> Column:
    """The user's keys where given, else the recommended ones, without blanks."""
    pick = lambda who: F.filter(F.array(*[cells.trimmed(F.coalesce(f"{who}_key_{i}", F.lit(""))) for i in (1, 2, 3)]), lambda k: k != "")
    return F.when(F.size(pick("your")) > 0, pick("your")).otherwise(pick("recommended"))


def grain_decision(primary: DataFrame) -> DataFrame:
    return primary.select("run_id", F.lower(F.trim("status")).alias("status"), _chosen_keys().alias("keys"), "comments")


def reference_decisions(dimensions: DataFrame) -> DataFrame:
    return dimensions.select("run_id", "table_name", F.lower(F.trim("status")).alias("status"), _chosen_keys().alias("keys"), "comments")


def family_decisions(families: DataFrame) -> DataFrame:
    choose = lambda mine, theirs: F.coalesce(F.when(F.trim(mine) != "", F.trim(mine)), F.trim(theirs))
    return families.select(
        "run_id", "family_id", F.lower(F.trim("status")).alias("status"),
        choose("your_table_name", "recommended_table_name").alias("table_name"),
        choose("your_repeat_index_name", "recommended_repeat_index_name").alias("repeat_index_name"),
        choose("your_parent_key", "recommended_parent_key").alias("parent_key"), "comments")


def normalize_rows(docs: DataFrame, raw: str = "raw", key: str = "run_id") -> DataFrame:
    """Rows of a JSON table in any of three shapes, as (key, row_index, column_index, header, value).

    A list of objects: headers are the first object's keys, then the other keys in name order, and a
    missing key reads as blank. ``{columns, rows}``: as given. A list of lists: the first list is the
    header when it is all text, else headers are Col1..ColN.
    """
    text = F.col(raw)
    value = F.try_parse_json(text)
    shape = F.schema_of_variant(value)
    first = F.try_variant_get(value, "$[0]", "variant")
    first_kind = F.schema_of_variant(first)
    tagged = docs.select(key, text.alias("raw"), value.alias("v"), first.alias("first"), F.when(
        shape.startswith("OBJECT"), "table").when(first_kind.startswith("OBJECT"), "objects").when(
        first_kind.startswith("ARRAY"), "lists").alias("shape"))
    objects = F.from_json("raw", "array<map<string,string>>")
    own = F.json_object_keys(F.get_json_object("raw", "$[0]"))
    others = F.array_sort(F.array_except(F.array_distinct(F.flatten(F.transform(objects, F.map_keys))), own))
    lists = F.from_json("raw", "array<array<string>>")
    head = F.try_variant_get("v", "$[0]", "array<variant>")
    has_head = F.coalesce(F.forall(head, lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))
    numbered = F.transform(lists[0], lambda _, i: F.concat(F.lit("Col"), (i + 1).cast("string")))
    headers = (
        F.when(F.col("shape") == "objects", F.concat(own, others))
        .when(F.col("shape") == "table", F.from_json(F.get_json_object("raw", "$.columns"), "array<string>"))
        .otherwise(F.when(has_head, lists[0]).otherwise(numbered))
    )
    body = F.when(F.col("shape") == "table", F.from_json(F.get_json_object("raw", "$.rows"), "array<array<string>>")).otherwise(
        F.when(has_head, F.slice(lists, 2, F.size(lists))).otherwise(lists))
    framed = tagged.filter("shape is not null").select(key, "shape", headers.alias("headers"), F.when(
        F.col("shape") == "objects", objects).alias("objects"), F.when(F.col("shape") != "objects", body).alias("body"))
    by_name = F.transform("objects", lambda o: F.transform("headers", lambda h: F.when(
        F.map_contains_key(o, h), F.element_at(o, h)).otherwise("")))
    rows = framed.select(key, "headers", F.posexplode(F.when(F.col("shape") == "objects", by_name).otherwise(F.col("body"))).alias("row_index", "row"))
    return rows.select(key, "row_index", F.posexplode(F.arrays_zip(F.col("headers").alias("h"), F.col("row").alias("r"))).alias("column_index", "z")).select(
        key, "row_index", "column_index", F.col("z.h").alias("header"), F.col("z.r").alias("value"))
