"""Row grain, keys, duplicates and dependencies.

Every test here is one scan: the key sets become grouping sets of a single aggregation, and
"do rows agree within a group" is answered with min and max of a fixed-width row fingerprint, which
combines before the shuffle and needs no per-group list. A group holding a third of all rows
therefore reaches the final stage as one row per input partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesight.operators.profile import _run

KeySets = Sequence[Sequence[str]]

#: Columns of ``grain_tests`` and ``key_stress``, for tables in which no set is to be tested.
GRAIN_TESTS = ("run_id string, keys_tested string, n_rows long, n_groups long, uniqueness_rate double, collision_severity_score double, "
               "non_key_conflict_group_pct double, pivot_safety boolean")
STRESS_EXAMPLES = "run_id string, key string, attribute string, key_value string, low_value string, high_value string"
KEY_STRESS = "run_id string, key string, attribute string, repeated_groups long, drift_pct double"


def _prints(columns: Sequence[str]) -> list[Column]:
    """Two independent 64-bit fingerprints of the given columns; where a null stands counts, though hashing skips nulls."""
    cols = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return [F.xxhash64(*cols).alias("print_a"), F.xxhash64(F.lit("second"), *cols).alias("print_b")]


def _key_text(keys: Sequence[str]) -> str:
    return ",".join(keys)


#: Buckets in which the spread of a column is counted, and the largest share of the rows that one of them may hold.
BUCKETS, BUCKET_SHARE = 4096, 1 / 256
#: Groups, over all sets, that one partition is to hold.
GROUPS_AT_ONCE = 1_000_000


def _shared_columns(base: DataFrame, sets: KeySets) -> tuple[dict[str, list[Sequence[str]]], int]:
    """Columns by which rows can be dealt once for several sets, with these sets, and the number of rows.

    A hot value would put its rows into one task, so only columns that spread evenly over buckets count; one pass
    that combines before the shuffle tells which.
    """
    open_ = [c for c in sorted({k for s in sets for k in s}) if sum(c in s for s in sets) > 1]
    if not open_ or len({frozenset(s) for s in sets}) < len(sets):  # a set listed twice counts twice
        return {}, 0
    bucket = F.array(*[F.struct(F.lit(i).alias("i"), F.pmod(F.xxhash64(F.col(f"`{c}`")), F.lit(BUCKETS)).alias("b")) for i, c in enumerate(open_)])
    counts = base.select(F.inline(bucket)).groupBy("i", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("i").agg(F.max("n").alias("most"), F.sum("n").alias("n")).collect()
    even, n_rows = [open_[r["i"]] for r in counts if r["most"] <= BUCKET_SHARE * r["n"]], max((r["n"] for r in counts), default=0)
    shared, left = {}, list(sets)
    while even:
        column = min(even, key=lambda c: (-sum(c in s for s in left), c))
        held = [s for s in left if column in s]
        if len(held) < 2:
            break
        shared[column], left = held, [s for s in left if column not in s]
        even.remove(column)
    return shared, n_rows


def _dealt(base: DataFrame, column: str, sets: KeySets, used: Sequence[str], n_rows: int, aggs: list[Column]) -> DataFrame:
    """Groups of ``sets``, all of which hold ``column``: rows are shuffled once, and every set is grouped where they lie."""
    kinds = dict(base.dtypes)
    rest = [k for k in used if k != column and any(k in s for s in sets)]
    tested = F.array(*[F.struct(F.lit(n).alias("set_no"), *[
        (F.col(f"`{k}`") if k in s else F.lit(None).cast(kinds[k])).alias(f"of_{i}") for i, k in enumerate(rest)]) for n, s in enumerate(sets)])
    values = [c for c in base.columns if c not in (column, *rest)]
    rows = base.repartition(max(1, math.ceil(n_rows * len(sets) / GROUPS_AT_ONCE)), F.col(f"`{column}`"))
    split = rows.select(F.col(f"`{column}`").alias("dealt_by"), *[F.col(f"`{c}`") for c in values], F.inline(tested))
    groups = split.groupBy("dealt_by", "set_no", *[f"of_{i}" for i in range(len(rest))]).agg(*aggs)
    named = groups.withColumn("keys_tested", F.get(F.array(*[F.lit(_key_text(s)) for s in sets]), F.col("set_no"))).drop("set_no")
    return named.withColumnsRenamed({"dealt_by": column, **{f"of_{i}": k for i, k in enumerate(rest)}})


def _grouped(base: DataFrame, sets: KeySets, aggs: list[Column]) -> DataFrame:
    """Groups of every key set; ``keys_tested`` says which set a row belongs to.

    Sets that share an evenly spread column are grouped after one shuffle by it, which moves each row once for
    all of them; the others are grouping sets of one aggregation, which combines before its shuffle.
    """
    used = sorted({k for s in sets for k in s})
    shared, n_rows = _shared_columns(base, sets)
    parts = [_dealt(base, c, held, used, n_rows, aggs) for c, held in shared.items()]
    left = [s for s in sets if not any(s in held for held in shared.values())]
    if left:
        parts.append(_combined(base, left, sorted({k for s in left for k in s}), aggs))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _combined(base: DataFrame, sets: KeySets, used: Sequence[str], aggs: list[Column]) -> DataFrame:
    """Groups of every key set in one pass, combined before the shuffle."""
    grouping = base.groupingSets([[F.col(f"`{k}`") for k in s] for s in sets], *[F.col(f"`{k}`") for k in used])
    out = grouping.agg(F.grouping_id(*[F.col(f"`{k}`") for k in used]).alias("set_bits"), *aggs)
    label = F.lit(None).cast("string")
    for s in sets:
        bits = sum(1 << (len(used) - 1 - i) for i, k in enumerate(used) if k not in s)
        label = F.when(F.col("set_bits") == bits, F.lit(_key_text(s))).otherwise(label)
    return out.withColumn("keys_tested", label).drop("set_bits")


def grain_tests(df: DataFrame, run_id: str, key_sets: KeySets) -> DataFrame:
    """Uniqueness, collision severity and conflict share of each candidate key set."""
    used = sorted({k for s in key_sets for k in s})
    base = df.select(*[F.col(f"`{k}`") for k in used], *_prints(df.columns))
    groups = _grouped(base, key_sets, [
        F.count(F.lit(1)).alias("n"),
        ((F.min("print_a") != F.max("print_a")) | (F.min("print_b") != F.max("print_b"))).alias("conflict"),
    ])
    tests = groups.groupBy("keys_tested").agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("n") > 1).alias("colliding_groups"),
        F.count_if((F.col("n") > 1) & F.col("conflict")).alias("conflict_groups"),
    )
    return tests.select(
        F.lit(run_id).alias("run_id"), "keys_tested", "n_rows", "n_groups",
        F.round(F.col("n_groups") / F.col("n_rows"), 6).alias("uniqueness_rate"),
        F.round((F.col("n_rows") - F.col("n_groups")) / F.col("n_rows"), 6).alias("collision_severity_score"),
        F.round(100 * F.coalesce(F.try_divide("conflict_groups", "colliding_groups"), F.lit(0.0)), 6)
        .alias("non_key_conflict_group_pct"),
        (F.col("n_groups") == F.col("n_rows")).alias("pivot_safety"),
    )


def _grain_order() -> list[Column]:
    return [
        F.col("pivot_safety").desc(), F.col("collision_severity_score"),
        F.col("non_key_conflict_group_pct"), F.col("uniqueness_rate").desc(), F.col("keys_tested"),
    ]


def ranked_grains(tests: DataFrame) -> DataFrame:
    """Tests in order of preference; rank 1 is the best candidate, the rest are runners-up."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(*_grain_order()))
    return tests.withColumn("grain_rank", rank)


def reject_fake_grains(tests: DataFrame, columns: DataFrame) -> DataFrame:
    """Drop key sets that use a family member or an export index.

    ``columns`` has run_id, column, family_id (nullable) and is_export_index.
    """
    bad = columns.filter(F.col("family_id").isNotNull() | F.col("is_export_index")).select(
        "run_id", F.col("column").alias("key"))
    parts = tests.select("run_id", "keys_tested", F.explode(F.split("keys_tested", ",")).alias("key"))
    fake = parts.join(bad, ["run_id", "key"], "left_semi").select("run_id", "keys_tested").distinct()
    return tests.join(fake, ["run_id", "keys_tested"], "left_anti")


def single_key_seeds(stats: DataFrame, k: int = 12) -> DataFrame:
    """Columns that come closest to identifying rows, from the column counts alone."""
    seeds = stats.select(
        "run_id", "column", "unique_count", "missing_pct",
        F.round(F.col("unique_count") / F.col("n_rows"), 6).alias("key_ratio"),
    )
    order = Window.partitionBy("run_id").orderBy(F.col("key_ratio").desc(), "missing_pct", "column")
    return seeds.withColumn("seed_rank", F.row_number().over(order)).filter(F.col("seed_rank") <= k)


def worthwhile_sets(columns: Sequence[str], distinct: dict[str, int], n_rows: int, size: int = 2) -> list[tuple[str, ...]]:
    """Sets of ``size`` columns that could identify rows, from column counts alone.

    A column that is unique by itself makes every set with it unique, and a set whose distinct counts
    multiply to less than the rows cannot be unique; neither needs a pass over the data.
    """
    open_ = [c for c in columns if distinct[c] < n_rows]
    return [s for s in combinations(open_, size) if math.prod(distinct[c] for c in s) >= n_rows]


def pair_key_seeds(df: DataFrame, run_id: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct share of the listed column pairs; all rows are counted for every pair."""
    groups = _grouped(df.select(*[F.col(f"`{c}`") for c in sorted({c for p in pairs for c in p})]), pairs, [F.count(F.lit(1)).alias("n")])
    return groups.groupBy("keys_tested").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest_group")
    ).select(
        F.lit(run_id).alias("run_id"), F.col("keys_tested").alias("pair"), "n_groups", "largest_group",
        F.round(F.col("n_groups") / F.col("n_rows"), 6).alias("pair_ratio"),
    )


def key_overlap_groups(seeds: DataFrame, pair_seeds: DataFrame, cut: float = 0.5) -> DataFrame:
    """Per key seed, how many strong pair seeds it takes part in and which is best."""
    parts = pair_seeds.filter(F.col("pair_ratio") >= cut).select(
        "run_id", "pair", "pair_ratio", F.explode(F.split("pair", ",")).alias("column"))
    groups = parts.groupBy("run_id", "column").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.min_by("pair", F.struct((-F.col("pair_ratio")).alias("r"), "pair")).alias("best_pair"),
    )
    return seeds.select("run_id", "column", "key_ratio").join(groups, ["run_id", "column"])


def _attribute_prints(df: DataFrame, key_sets: KeySets, attributes: Sequence[str]) -> DataFrame:
    used = sorted({k for s in key_sets for k in s})
    prints = []
    for i, a in enumerate(attributes):
        both = F.col(f"`{a}`").isNull(), F.col(f"`{a}`")
        prints += [F.xxhash64(*both).alias(f"a_{i}"), F.xxhash64(F.lit("second"), *both).alias(f"b_{i}")]
    return df.select(*[F.col(f"`{k}`") for k in used], *prints)


def key_stress(df: DataFrame, run_id: str, key_sets: KeySets, attributes: Sequence[str]) -> DataFrame:
    """Share of repeated key groups within which each attribute varies.

    An attribute with share 0 is an invariant of that key. Values are compared by 128-bit
    fingerprints, whose fixed width keeps the aggregation hash-based.
    """
    groups = _grouped(_attribute_prints(df, key_sets, attributes), key_sets, [
        F.count(F.lit(1)).alias("n"),
        *[((F.min(f"a_{i}") != F.max(f"a_{i}")) | (F.min(f"b_{i}") != F.max(f"b_{i}"))).alias(f"varies_{i}")
          for i in range(len(attributes))],
    ])
    rows = groups.filter(F.col("n") > 1).select("keys_tested", F.inline(F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(f"varies_{i}").alias("varies")) for i, a in enumerate(attributes)])))
    return rows.groupBy("keys_tested", "attribute").agg(
        F.count(F.lit(1)).alias("repeated_groups"), F.count_if("varies").alias("drifted_groups"),
    ).filter(
        ~F.array_contains(F.split("keys_tested", ","), F.col("attribute"))
    ).select(
        F.lit(run_id).alias("run_id"), F.col("keys_tested").alias("key"), "attribute", "repeated_groups",
        F.round(100 * F.col("drifted_groups") / F.col("repeated_groups"), 6).alias("drift_pct"),
    )


def conflict_examples(df: DataFrame, run_id: str, key: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """One example per attribute that varies within ``key``: the key values and two of its values.

    The example groups are chosen by fingerprint first, at most one per attribute, so the pass that
    fetches values is a broadcast lookup of a handful of rows.
    """
    where = F.xxhash64(*[F.col(f"`{k}`") for k in key])
    groups = _grouped(_attribute_prints(df, [key], attributes), [key], [
        *[((F.min(f"a_{i}") != F.max(f"a_{i}")) | (F.min(f"b_{i}") != F.max(f"b_{i}"))).alias(f"varies_{i}")
          for i in range(len(attributes))]])
    chosen = groups.agg(*[F.min(F.when(F.col(f"varies_{i}"), where)).alias(f"pick_{i}") for i in range(len(attributes))])
    picks = chosen.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(f"pick_{i}").alias("pick")) for i, a in enumerate(attributes)]))).filter("pick is not null")
    values = df.select(where.alias("pick"), F.concat_ws(",", *[F.col(f"`{k}`").cast("string") for k in key]).alias("key_value"),
                       F.map_from_arrays(F.array(*[F.lit(a) for a in attributes]),
                                         F.array(*[F.col(f"`{a}`").cast("string") for a in attributes])).alias("row"))
    hit = values.join(F.broadcast(picks), "pick").select("attribute", "key_value", F.element_at("row", F.col("attribute")).alias("value"))
    return hit.groupBy("attribute").agg(
        F.min("key_value").alias("key_value"), F.min("value").alias("low_value"), F.max("value").alias("high_value")
    ).select(F.lit(run_id).alias("run_id"), F.lit(_key_text(key)).alias("key"), "*")


def stress_examples(df: DataFrame, run_id: str, key_sets: KeySets, attributes: Sequence[str], examples: int = 3) -> DataFrame:
    """Per key and attribute the first ``examples`` repeated keys within which the attribute varies.

    Rows are run_id, key, attribute, key_value (the key's texts, joined by a bar, null as nothing), low_value
    and high_value. Conflicts are found by fingerprints; the smallest key values are ranked with a cut
    before the shuffle, and values are fetched for these alone, at most ``examples`` per key and attribute.
    """
    def value(keys: Sequence[str]) -> Column:
        return F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys])

    groups = _grouped(_attribute_prints(df, key_sets, attributes), key_sets, [
        *[((F.min(f"a_{i}") != F.max(f"a_{i}")) | (F.min(f"b_{i}") != F.max(f"b_{i}"))).alias(f"varies_{i}") for i in range(len(attributes))]])
    named = F.lit(None).cast("string")
    for k in key_sets:
        named = F.when(F.col("keys_tested") == _key_text(k), value(k)).otherwise(named)
    rows = groups.select("keys_tested", named.alias("key_value"), F.inline(F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(f"varies_{i}").alias("varies")) for i, a in enumerate(attributes)]))).filter("varies")
    order = Window.partitionBy("keys_tested", "attribute").orderBy("key_value")
    picks = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= examples).select("keys_tested", "attribute", "key_value")
    cell = F.map_from_arrays(F.array(*[F.lit(a) for a in attributes]), F.array(*[F.col(f"`{a}`").cast("string") for a in attributes]))
    every = df.select(cell.alias("row"), F.inline(F.array(*[F.struct(F.lit(_key_text(k)).alias("keys_tested"), value(k).alias("key_value")) for k in key_sets])))
    hit = every.join(F.broadcast(picks), ["keys_tested", "key_value"]).withColumn("value", F.element_at("row", F.col("attribute")))
    out = hit.groupBy("keys_tested", "attribute", "key_value").agg(F.min("value").alias("low_value"), F.max("value").alias("high_value"))
    return out.select(F.lit(run_id).alias("run_id"), F.col("keys_tested").alias("key"), "attribute", "key_value", "low_value", "high_value")


def nested_stress(stress: DataFrame, found: DataFrame) -> DataFrame:
    """One row per key: repeated_groups, drifted_attributes, and top_drifted_attributes[] with example_conflicts[] each.

    ``stress`` is of ``key_stress``, ``found`` of ``stress_examples``. Attributes come by falling drift, then by
    name, examples by key value; both lists are as long as a table is wide at most.
    """
    conflicts = found.groupBy("run_id", "key", "attribute").agg(
        F.array_sort(F.collect_list(F.struct("key_value", "low_value", "high_value"))).alias("example_conflicts"))
    rows = stress.join(conflicts, ["run_id", "key", "attribute"], "left")
    item = F.when(F.col("drift_pct") > 0, F.struct(
        (-F.col("drift_pct")).alias("minus"), "attribute", "drift_pct",
        F.coalesce("example_conflicts", F.array().cast("array<struct<key_value: string, low_value: string, high_value: string>>")).alias("example_conflicts")))
    packed = rows.groupBy("run_id", "key").agg(F.max("repeated_groups").alias("repeated_groups"), F.max("drift_pct").alias("drift_pct"),
                                               F.array_sort(F.collect_list(item)).alias("items"))
    return packed.select("run_id", "key", "repeated_groups", "drift_pct", F.size("items").alias("drifted_attributes"), F.transform(
        "items", lambda x: F.struct(x["attribute"].alias("attribute"), x["drift_pct"].alias("drift_pct"), x["example_conflicts"].alias("example_conflicts"))).alias("top_drifted_attributes"))


def invariants(stress: DataFrame) -> DataFrame:
    """Attributes that never vary within a key; that alone does not make the key a row key."""
    return stress.filter(F.col("drift_pct") == 0).select(
        "run_id", "key", "attribute", "repeated_groups", F.lit(True).alias("not_final_key"))


def duplicate_clusters(df: DataFrame, run_id: str | Column, columns: Sequence[str], id_column: str) -> DataFrame:
    """Groups of rows equal in ``columns``. Only a digest of each row is shuffled, so wide rows and
    long texts cost 64 bytes, and a hot cluster combines before the shuffle."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    keyed = df.select(_run(run_id).alias("run_id"), F.sha2(text, 256).alias("digest"), F.col(id_column).alias("row"))
    return keyed.groupBy("run_id", "digest").agg(
        F.count(F.lit(1)).alias("n_copies"), F.min("row").alias("first_row"), F.max("row").alias("last_row"),
    ).filter(F.col("n_copies") > 1).drop("digest")


def key_collisions(df: DataFrame, run_id: str, keys: Sequence[str]) -> DataFrame:
    """Key values shared by more than one row, and whether the rows behind them disagree."""
    base = df.select(*[F.col(f"`{k}`") for k in keys], *_prints(df.columns))
    return base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        ((F.min("print_a") != F.max("print_a")) | (F.min("print_b") != F.max("print_b"))).alias("conflict"),
    ).filter(F.col("n_rows") > 1).select(F.lit(run_id).alias("run_id"), *keys, "n_rows", "conflict")


def dependencies(df: DataFrame, run_id: str, determinants: Sequence[str], dependents: Sequence[str]) -> DataFrame:
    """X -> Y strength for every listed pair in one pass: the share of X groups with one Y value."""
    columns = list(dict.fromkeys([*determinants, *dependents]))
    base = df.select(*[F.col(f"`{c}`") for c in columns])
    for i, y in enumerate(dependents):
        both = F.col(f"`{y}`").isNull(), F.col(f"`{y}`")
        base = base.withColumn(f"a_{i}", F.xxhash64(*both)).withColumn(f"b_{i}", F.xxhash64(F.lit("second"), *both))
    groups = _grouped(base, [[x] for x in determinants], [
        ((F.min(f"a_{i}") == F.max(f"a_{i}")) & (F.min(f"b_{i}") == F.max(f"b_{i}"))).alias(f"one_{i}")
        for i in range(len(dependents))
    ])
    rows = groups.select(F.col("keys_tested").alias("determinant"), F.inline(F.array(*[
        F.struct(F.lit(y).alias("dependent"), F.col(f"one_{i}").alias("single"))
        for i, y in enumerate(dependents)
    ])))
    return rows.filter(F.col("determinant") != F.col("dependent")).groupBy("determinant", "dependent").agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if("single").alias("single_groups")
    ).select(
        F.lit(run_id).alias("run_id"), "determinant", "dependent", "n_groups",
        F.round(F.col("single_groups") / F.col("n_groups"), 6).alias("strength"),
        (F.col("single_groups") == F.col("n_groups")).alias("holds"),
    )


def near_duplicate_columns(df: DataFrame, run_id: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Share of rows on which two columns agree (null equals null); one aggregate row, no shuffle of rows."""
    text = {c: F.col(f"`{c}`").cast("string") for p in pairs for c in p}
    one = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(text[a].eqNullSafe(text[b])).alias(f"same_{i}") for i, (a, b) in enumerate(pairs)
    ])
    return one.select("n", F.inline(F.array(*[
        F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"same_{i}").alias("same"))
        for i, (a, b) in enumerate(pairs)
    ]))).select(
        F.lit(run_id).alias("run_id"), "left_column", "right_column",
        F.round(F.col("same") / F.col("n"), 6).alias("agreement"),
    )


def candidate_column_pairs(hist: DataFrame, columns: Sequence[str], agreement: float = 0.95) -> list[tuple[str, str]]:
    """Pairs of ``columns`` that may agree on a share ``agreement`` of their rows, from the cell histogram.

    Two columns agree on no more rows than their histograms share, the smaller count of each text summed
    up. So no pair that reaches the share is missed, and only pairs that pass are compared by row. A text
    occurs in as many histogram rows as there are columns, which bounds its list.
    """
    place = {c: i for i, c in enumerate(columns)}
    rows = hist.where(F.col("column").isin(*columns))
    totals = {r["column"]: r["n"] for r in rows.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    key = F.concat(F.lit("="), "value")
    if "digest" in hist.columns:  # long texts of a digest histogram
        key = F.coalesce(F.concat(F.lit("#"), F.hex("digest")), key)
    texts = rows.groupBy(F.sha2(F.coalesce(key, F.lit("")), 256).alias("text")).agg(
        F.array_sort(F.collect_list(F.struct("column", "n"))).alias("held")).where(F.size("held") > 1)
    left = texts.select("held", F.posexplode("held").alias("i", "a"))
    pairs = left.select("a", F.explode(F.slice("held", F.col("i") + 2, F.size("held"))).alias("b"))
    shared = pairs.groupBy(F.col("a.column").alias("x"), F.col("b.column").alias("y")).agg(F.sum(F.least("a.n", "b.n")).alias("n"))
    passed = [(r["x"], r["y"]) for r in shared.collect() if r["n"] >= agreement * max(totals[r["x"]], totals[r["y"]])]
    return sorted((tuple(sorted(p, key=place.get)) for p in passed), key=lambda p: (place[p[0]], place[p[1]]))


def one_hot_blocks(df: DataFrame, run_id: str, blocks: dict[str, Sequence[str]]) -> DataFrame:
    """Share of rows in which exactly one column of each block is 1."""
    sums = []
    for members in blocks.values():
        ones = [F.when(F.trim(F.col(f"`{c}`").cast("string")) == "1", 1).otherwise(0) for c in members]
        sums.append(sum(ones[1:], ones[0]))
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(s == 1).alias(f"hit_{i}") for i, s in enumerate(sums)])
    return one.select("n", F.inline(F.array(*[
        F.struct(F.lit(stem).alias("stem"), F.lit(len(members)).cast("long").alias("n_columns"),
                 F.col(f"hit_{i}").alias("hit"))
        for i, (stem, members) in enumerate(blocks.items())
    ]))).select(F.lit(run_id).alias("run_id"), "stem", "n_columns",
                F.round(F.col("hit") / F.col("n"), 6).alias("exclusive_share"))


def coded_categoricals(shares: DataFrame, levels: int = 12) -> DataFrame:
    """Columns that parse as numbers but hold few distinct values."""
    return shares.filter((F.col("numeric_share") >= 0.95) & (F.col("unique_count") <= levels)).select(
        "run_id", "column", "unique_count", "numeric_share")


def time_candidates(shares: DataFrame, k: int = 10, cut: float = 0.9) -> DataFrame:
    order = Window.partitionBy("run_id").orderBy(F.col("datetime_share").desc(), "column")
    return (
        shares.filter(F.col("datetime_share") >= cut).select("run_id", "column", "datetime_share")
        .withColumn("time_rank", F.row_number().over(order)).filter(F.col("time_rank") <= k)
    )


def screening_correlations(df: DataFrame, run_id: str, screen: str, levels: Sequence[str],
                           families: dict[str, Sequence[str]]) -> DataFrame:
    """Correlation between a screening level and how many members of a family are filled."""
    filled = {
        f: sum([F.col(f"`{c}`").isNotNull().cast("int") for c in members], F.lit(0)) for f, members in families.items()
    }
    pairs = [(v, f) for v in levels for f in families]
    one = df.agg(*[
        F.corr((F.col(f"`{screen}`") == v).cast("double"), filled[f].cast("double")).alias(f"c_{i}")
        for i, (v, f) in enumerate(pairs)
    ])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(screen).alias("screen"), F.lit(v).alias("level"), F.lit(f).alias("family_id"),
                 F.round(F.col(f"c_{i}"), 6).alias("correlation"))
        for i, (v, f) in enumerate(pairs)
    ]))).select(F.lit(run_id).alias("run_id"), "screen", "level", "family_id", "correlation")


def all_screening_correlations(df: DataFrame, run_id: str, screens: Sequence[str], families: dict[str, Sequence[str]]) -> DataFrame:
    """As ``screening_correlations`` for every level of all ``screens``, in one scan.

    A correlation needs no more than counts and sums: per screen and level the rows, their filled members
    and the squares of these. Levels of a screen add up to its totals, so nothing is read twice. Rows
    without a level take no part; a correlation without variance is null.
    """
    names = list(families)
    filled = [sum([F.col(f"`{c}`").isNotNull().cast("long") for c in families[f]], F.lit(0)).alias(f"f_{i}") for i, f in enumerate(names)]
    levels = F.array(*[F.struct(F.lit(s).alias("screen"), F.col(f"`{s}`").cast("string").alias("level")) for s in screens])
    rows = df.select(*filled, F.inline(levels)).where("level is not null")
    sums = rows.groupBy("screen", "level").agg(F.count(F.lit(1)).alias("n"), *[
        F.struct(F.sum(f"f_{i}").alias("s"), F.sum(F.col(f"f_{i}") * F.col(f"f_{i}")).alias("q")).alias(f"of_{i}") for i in range(len(names))])
    each = sums.select("screen", "level", "n", F.inline(F.array(*[
        F.struct(F.lit(f).alias("family_id"), F.col(f"of_{i}.s").alias("s"), F.col(f"of_{i}.q").alias("q")) for i, f in enumerate(names)])))
    whole = Window.partitionBy("screen", "family_id")
    n, s, total = (F.col(x).cast("double") for x in ("n", "s", "total"))
    every = each.withColumn("total", F.sum("n").over(whole)).withColumn("all_s", F.sum("s").over(whole)).withColumn("all_q", F.sum("q").over(whole))
    spread = n * (total - n) * (total * F.col("all_q") - F.col("all_s").cast("double") * F.col("all_s"))
    return every.select(F.lit(run_id).alias("run_id"), "screen", "level", "family_id",
                        F.when(spread > 0, F.round((total * s - n * F.col("all_s")) / F.sqrt(spread), 6)).alias("correlation"))


def constraints(df: DataFrame, run_id: str, orderings: Sequence[tuple[str, str]],
                sums: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """Share of rows that satisfy a <= b, and a + b = c, for the listed column tuples."""
    col = lambda name: F.col(f"`{name}`")
    tests = [(f"{a} <= {b}", col(a) <= col(b)) for a, b in orderings]
    tests += [(f"{a} + {b} = {c}", F.abs(col(a) + col(b) - col(c)) < 1e-9) for a, b, c in sums]
    one = df.agg(*[
        F.struct(F.count(cond).alias("checked"), F.count_if(cond).alias("held")).alias(f"t_{i}")
        for i, (_, cond) in enumerate(tests)
    ])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("constraint"), F.col(f"t_{i}.checked").alias("checked"),
                 F.col(f"t_{i}.held").alias("held"))
        for i, (name, _) in enumerate(tests)
    ]))).select(
        F.lit(run_id).alias("run_id"), "constraint", "checked",
        F.round(F.coalesce(F.try_divide("held", "checked"), F.lit(0.0)), 6).alias("held_share"),
        ((F.col("checked") > 0) & (F.col("held") == F.col("checked"))).alias("deterministic"),
    )
