"""Response scales: hand-off of user rows, codebook reconciliation, inference and precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesight.functions import cells

TARGET = ["run_id", "target_kind", "target_id"]
FIELDS = [*TARGET, "mapping_status", "response_scale_kind", "ordered_labels", "label_to_ordinal_position",
          "label_to_numeric_score", "numeric_score_semantics_confirmed", "source", "notes", "confidence"]
TRAILING = r"(-?[0-9]+)$"
#: Distinct texts up to which a column may hold the steps of a scale.
MOST_LEVELS = 100


def _positions(labels: Column) -> Column:
    return F.map_from_arrays(labels, F.transform(labels, lambda _, i: (i + 1).cast("double")))


def handoff(sheet: DataFrame) -> DataFrame:
    """Scale rows of the light contract with their piped texts split; placeholders are dropped.

    A placeholder names a target and gives no labels.
    """
    labels = cells.piped_labels(F.coalesce("ordered_labels_low_to_high", F.lit("")))
    scores = F.transform(cells.piped_labels(F.coalesce("numeric_scores_low_to_high", F.lit(""))), lambda x: x.try_cast("double"))
    return sheet.select(
        *[F.lower(cells.trimmed(F.col(c))).alias(c) if c == "target_kind" else F.col(c) for c in TARGET],
        F.coalesce("response_scale_kind", F.lit("")).alias("response_scale_kind"),
        labels.alias("ordered_labels"), scores.alias("numeric_scores"), F.coalesce("notes", F.lit("")).alias("notes"),
    ).filter(F.size("ordered_labels") > 0)


def human_mappings(rows: DataFrame) -> DataFrame:
    scored = F.size("numeric_scores") == F.size("ordered_labels")
    return rows.select(
        *TARGET, F.lit("human_confirmed").alias("mapping_status"), "response_scale_kind", "ordered_labels",
        _positions(F.col("ordered_labels")).alias("label_to_ordinal_position"),
        F.when(scored, F.map_from_arrays("ordered_labels", "numeric_scores"))
        .otherwise(F.create_map().cast("map<string,double>")).alias("label_to_numeric_score"),
        scored.alias("numeric_score_semantics_confirmed"), F.lit("light_contract").alias("source"), "notes",
        F.lit(1.0).alias("confidence"),
    )


def complete_levels(hist: DataFrame, most: int = MOST_LEVELS) -> DataFrame:
    """All distinct trimmed texts of each column with at most ``most`` of them: run_id, column, value, too_many.

    A column with more gives one row without a value, ``too_many``; so each column is either complete or known
    not to be. No task takes more than ``most`` + 1 texts of a column and input part.
    """
    texts = hist.filter(~cells.is_missing(F.col("value"))).select("run_id", "column", cells.trimmed(F.col("value")).alias("value")).distinct()
    of = Window.partitionBy("run_id", "column")
    first = texts.withColumn("place", F.row_number().over(of.orderBy("value"))).filter(F.col("place") <= most + 1)
    beyond = F.max("place").over(of) > most
    return first.withColumn("too_many", beyond).filter(~F.col("too_many") | (F.col("place") == 1)).select(
        "run_id", "column", F.when(~F.col("too_many"), F.col("value")).alias("value"), "too_many")


def observed_values(levels: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct trimmed texts per mapping target: each column, and each family over its members; null where there are too many.

    ``levels`` is of ``complete_levels``, or run_id, column, value of columns with few texts.
    """
    if "too_many" not in levels.columns:
        levels = levels.withColumn("too_many", F.lit(False))
    text = levels.select("run_id", "column", cells.trimmed(F.col("value")).alias("value"), "too_many")
    single = text.select("run_id", F.lit("column").alias("target_kind"), F.col("column").alias("target_id"), "value", "too_many")
    family = text.join(members.select("run_id", "column", "family_id"), ["run_id", "column"]).select(
        "run_id", F.lit("family").alias("target_kind"), F.col("family_id").alias("target_id"), "value", "too_many")
    seen = single.unionByName(family).groupBy(*TARGET).agg(F.array_sort(F.collect_set("value")).alias("observed"), F.bool_or("too_many").alias("too_many"))
    return seen.withColumn("observed", F.when(~F.col("too_many"), F.col("observed")))


def reconcile(mappings: DataFrame, observed: DataFrame) -> DataFrame:
    """Rewrite labels such as ``No anxiety 1`` to the numbers the data really holds.

    Only when the trailing numbers of all labels are exactly the observed values; the words move to
    the notes. ``mismatch`` marks targets where neither the labels nor their numbers fit the data, be it that
    the data holds too many texts for a scale.
    """
    tokens = F.transform("ordered_labels", lambda x: F.regexp_extract(cells.trimmed(x), TRAILING, 1))
    rows = mappings.join(observed, TARGET, "left").withColumn("tokens", tokens)
    seen = F.col("observed").isNotNull() & (F.size("observed") > 0)
    same_set = lambda a: F.array_sort(F.array_distinct(a)) == F.col("observed")
    numeric = seen & ~F.exists("tokens", lambda x: x == "") & same_set(F.col("tokens"))
    rewrite = F.coalesce(numeric & (F.col("tokens") != F.col("ordered_labels")), F.lit(False))
    fits = F.coalesce(numeric, F.lit(False)) | F.coalesce(same_set(F.transform("ordered_labels", cells.trimmed)), F.lit(False))
    words = F.transform(
        F.filter(F.arrays_zip("ordered_labels", "tokens"), lambda z: cells.trimmed(z["ordered_labels"]) != z["tokens"]),
        lambda z: F.concat(z["tokens"], F.lit(" = "), F.regexp_replace(cells.trimmed(z["ordered_labels"]), r"\s*(-?[0-9]+)$", "")))
    meaning = F.concat(F.lit("Codebook meaning: "), F.array_join(words, "; "), F.lit("."))
    scores = F.map_from_entries(F.transform(
        F.filter(F.arrays_zip("ordered_labels", "tokens"), lambda z: F.map_contains_key("label_to_numeric_score", z["ordered_labels"])),
        lambda z: F.struct(z["tokens"], F.element_at("label_to_numeric_score", z["ordered_labels"]))))
    changed = {
        "notes": F.concat_ws(" ", F.when(F.col("notes") != "", F.col("notes")), meaning),
        "label_to_numeric_score": scores,
        "label_to_ordinal_position": _positions(F.col("tokens")),
        "ordered_labels": F.col("tokens"),
    }
    many = F.coalesce(F.col("too_many"), F.lit(False))
    rows = rows.withColumns({"rewrite": rewrite, "mismatch": many | (seen & ~fits)})
    return rows.withColumns({c: F.when(F.col("rewrite"), v).otherwise(F.col(c)) for c, v in changed.items()}).drop(
        "tokens", "observed", "too_many", "rewrite")


def mismatch_flags(reconciled: DataFrame) -> DataFrame:
    return reconciled.filter("mismatch").select(
        "run_id", F.concat_ws(":", "target_kind", "target_id").alias("item"),
        F.lit("scale_mapping_source_value_mismatch").alias("issue"),
        F.lit("Codebook labels do not match the observed values, so the mapping was left as it is.").alias("why"))


def infer_textual(levels: DataFrame, members: DataFrame, role_rows: DataFrame) -> DataFrame:
    """Ladders a column spells out itself (``Agree 4``); families, keys and plain numbers are skipped.

    ``levels`` is of ``complete_levels``, or holds all texts of columns with few. Every text must be a step.
    """
    if "too_many" in levels.columns:
        levels = levels.filter(~F.col("too_many"))
    text = levels.select("run_id", "column", cells.trimmed(F.col("value")).alias("value"))
    number = F.regexp_extract("value", TRAILING, 1).try_cast("double")
    per = text.groupBy("run_id", "column").agg(
        F.array_sort(F.collect_set(F.struct(number.alias("score"), "value"))).alias("steps"),
        F.bool_and(F.col("value").rlike(r"[A-Za-z].*[0-9]+$")).alias("ladder"),
    )
    # the steps hold every label with its number, so neither is counted again; 0 is added to take -0 for 0
    n_labels = F.size(F.filter("steps", lambda s: s["value"].isNotNull()))
    n_scores = F.size(F.array_distinct(F.transform(F.filter("steps", lambda s: s["score"].isNotNull()), lambda s: s["score"] + 0.0)))
    per = per.filter(F.col("ladder") & (n_labels == n_scores) & (n_labels > 1))
    keys = role_rows.filter(F.col("primary_role") == "id_key").select("run_id", "column")
    per = per.join(members.select("run_id", "column"), ["run_id", "column"], "left_anti").join(keys, ["run_id", "column"], "left_anti")
    labels, scores = F.transform("steps", lambda s: s["value"]), F.transform("steps", lambda s: s["score"])
    return per.select(
        "run_id", F.lit("column").alias("target_kind"), F.col("column").alias("target_id"),
        F.lit("deterministic_inferred").alias("mapping_status"), F.lit("textual_ladder").alias("response_scale_kind"),
        labels.alias("ordered_labels"), _positions(labels).alias("label_to_ordinal_position"),
        F.map_from_arrays(labels, scores).alias("label_to_numeric_score"),
        F.lit(False).alias("numeric_score_semantics_confirmed"), F.lit("observed_levels").alias("source"),
        F.lit("").alias("notes"), F.lit(0.6).alias("confidence"),
    )


def resolve(human: DataFrame, codebook: DataFrame, inferred: DataFrame) -> DataFrame:
    """One mapping per target: human first, then confirmed codebook, then inferred."""
    parts = human.select(*FIELDS).unionByName(
        codebook.filter(F.col("mapping_status") == "codebook_confirmed").select(*FIELDS)).unionByName(inferred.select(*FIELDS))
    rank = (F.when(F.col("mapping_status") == "human_confirmed", 0).when(F.col("mapping_status") == "codebook_confirmed", 1)
            .otherwise(2))
    order = Window.partitionBy(*TARGET).orderBy(rank, F.array_join("ordered_labels", "|"))
    return parts.withColumn("choice", F.row_number().over(order)).filter("choice = 1").drop("choice")
