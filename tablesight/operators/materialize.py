"""Executing table plans: base, child, reference and event tables, then scores and marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesight.functions.transforms import clean
from tablesight.plans.shared import left_join_lookup

# ---------------------------------------------------------------- canonical tables


def direct_select(df: DataFrame, grain: Sequence[str], attributes: Sequence[str], plan: dict[str, Sequence[str]] | None = None,
                  dedupe: bool = False) -> DataFrame:
    """Base table at the primary grain. Ask for ``dedupe`` only where the key collisions agree."""
    out = df.select(*[F.col(f"`{c}`") for c in [*grain, *attributes]])
    out = clean(out, plan) if plan else out
    return out.dropDuplicates(list(grain)) if dedupe else out


def wide_to_long(df: DataFrame, parent_key: Sequence[str], members: Sequence[str], index_name: str,
                 value_name: str = "response_value", kind: str = "string") -> DataFrame:
    """Child table of a repeat family: parent key + index, one row per member cell (nulls kept)."""
    typed = df.select(*parent_key, *[F.col(f"`{m}`").cast(kind).alias(m) for m in members])
    long = typed.unpivot(list(parent_key), [f"`{m}`" for m in members], "member", value_name)
    index = F.regexp_extract("member", r"([0-9]+)$", 1).cast("bigint")
    return long.select(*parent_key, index.alias(index_name), value_name)


def reference_extract(df: DataFrame, key: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Lookup table of distinct key and attribute values."""
    return df.select(*key, *attributes).distinct()


def reference_conflicts(reference: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that came out with more than one attribute combination."""
    return reference.groupBy(*key).agg(F.count(F.lit(1)).alias("n_versions")).filter("n_versions > 1")


def event_projection(df: DataFrame, keys: Sequence[str], time: str, attributes: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.col(time).alias("event_time"), *attributes)


def residue(assignments: DataFrame) -> DataFrame:
    """Columns that no output table carries, and why."""
    return assignments.filter(F.col("assignment_role").isin("exclude_from_outputs", "unresolved")).select(
        "run_id", "column", "assignment_role")


# ---------------------------------------------------------------- analysis tables


def merge_waves(df: DataFrame, parent_key: Sequence[str], families: dict[str, Sequence[str]], index_name: str,
                wave_column: str = "wave", kind: str = "string") -> DataFrame:
    """Sibling families in one long table, tagged by wave. All families unpivot in a single pass."""
    struct = [
        F.struct(F.lit(wave).alias(wave_column), F.lit(i).cast("bigint").alias(index_name),
                 F.col(f"`{m}`").cast(kind).alias("response_value"))
        for wave, members in families.items() for i, m in ((int(_digits(m)), m) for m in members)
    ]
    return df.select(*parent_key, F.inline(F.array(*struct)))


def _digits(name: str) -> str:
    return name[len(name.rstrip("0123456789")):]


def response_distribution(long: DataFrame, by: Sequence[str]) -> DataFrame:
    return long.groupBy(*by, "response_value").agg(F.count(F.lit(1)).alias("n"))


def score_answers(responses: DataFrame, key: DataFrame, join_keys: Sequence[str], policy: str, value: str = "response_value",
                  answer: str = "key_value") -> DataFrame:
    """Mark each response against the key.

    ``is_correct`` is 1 or 0, null where the policy gives no score; ``counted`` says whether the
    response enters the denominator. There are as few join keys as items, so the key table is looked
    up rather than shuffled to.
    """
    out = left_join_lookup(responses, key.select(*join_keys, answer), join_keys)
    given, right = F.col(value).isNotNull(), F.col(value) == F.col(answer)
    mark = F.when(right, 1).otherwise(0)
    rules: dict[str, tuple[Column, Column]] = {
        "preserve_structural_missing": (F.when(given, mark), F.lit(True)),
        "exclude_from_score": (F.when(given, mark), given),
        "treat_as_incorrect": (F.when(given, mark).otherwise(0), F.lit(True)),
        "needs_review": (F.when(given, F.lit(None).cast("int")), F.lit(False)),
    }
    is_correct, counted = rules[policy]
    return out.withColumns({"is_correct": is_correct, "counted": counted, "structural_missing": ~given}).drop(answer)


def aggregate_scores(scored: DataFrame, grouping_keys: Sequence[str]) -> DataFrame:
    """Score sums per group; preserved missing responses are counted apart."""
    return scored.groupBy(*grouping_keys).agg(
        F.sum(F.when(F.col("counted"), F.col("is_correct"))).alias("score_sum"),
        F.count_if(F.col("counted")).alias("n_items"),
        F.count(F.when(F.col("counted"), F.col("is_correct"))).alias("n_scored"),
        F.count_if("structural_missing").alias("n_missing"),
    ).withColumn("score_avg", F.round(F.try_divide("score_sum", "n_scored"), 6))


def label_scores(long: DataFrame, mapping: dict[str, float] | None, confirmed: bool) -> DataFrame:
    """Numeric score of each label; an unconfirmed mapping scores nothing."""
    if not confirmed or not mapping:
        return long.withColumn("label_score", F.lit(None).cast("double"))
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(float(v)))])
    return long.withColumn("label_score", F.try_element_at(table, F.col("response_value").cast("string")))


def analysis_mart(base: DataFrame, parts: Sequence[DataFrame], grain: Sequence[str]) -> DataFrame:
    """Base rows with each score or reference table left-joined on the same grain.

    Inputs that share the grain are moved once each; the growing left side keeps its partitioning.
    """
    out = base
    for p in parts:
        out = out.join(p, list(grain), "left")
    return out
