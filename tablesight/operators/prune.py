"""Selecting compact evidence views.

All frames here are column-grain: ``run_id`` plus one row per column, family or test. Caps are
``row_number() <= k`` filters, which Spark applies per input partition before shuffling.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.operators.families import MEMBER

# ---------------------------------------------------------------- dropping keys


def _without(col: Column, kind: T.DataType, path: str, drop: Callable[[str, str, T.DataType], bool]) -> Column:
    if isinstance(kind, T.StructType):
        kept = [
            _without(col[f.name], f.dataType, f"{path}.{f.name}", drop).alias(f.name)
            for f in kind.fields if not drop(f.name, f"{path}.{f.name}", f.dataType)
        ]
        return F.when(col.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(col, lambda x: _without(x, kind.elementType, f"{path}[]", drop))
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StructType):
        return F.transform_values(col, lambda _, v: _without(v, kind.valueType, path, drop))
    return col


def _drop_where(df: DataFrame, drop: Callable[[str, str, T.DataType], bool], root: str) -> DataFrame:
    return df.select(*[
        _without(F.col(f"`{f.name}`"), f.dataType, f"{root}{f.name}", drop).alias(f.name)
        for f in df.schema.fields if not drop(f.name, f"{root}{f.name}", f.dataType)
    ])


def drop_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Remove the named keys wherever they sit in the schema."""
    return _drop_where(df, lambda name, _path, _kind: name in keys, "")


def drop_guarded(df: DataFrame, key: str, path_hints: Sequence[str] = (), list_of_objects: bool = False,
                 root: str = "") -> DataFrame:
    """Remove ``key`` only where every given guard agrees: it holds a list of objects, and it sits
    under one of the hinted paths. ``root`` names the array the frame's rows came from."""

    def drop(name: str, path: str, kind: T.DataType) -> bool:
        if name != key:
            return False
        objects = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
        hinted = any(path == h or path.endswith("." + h) for h in path_hints)
        return (objects or not list_of_objects) and (hinted or not path_hints)

    return _drop_where(df, drop, root)


# ---------------------------------------------------------------- reshaping fields


def drop_when_empty(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Null out empty maps and arrays, so that JSON output omits them."""
    return df.withColumns({f: F.when(F.size(f) > 0, F.col(f)) for f in fields})


def compact_keyed_arrays(df: DataFrame, name: str, max_items: int, max_chars: int) -> DataFrame:
    """Cap the items kept per map key and the characters kept per item."""
    short = F.transform_values(name, lambda _, v: F.transform(
        F.slice(v, 1, max_items), lambda s: F.substring(s, 1, max_chars)))
    return df.withColumn(name, short)


def role_preview(df: DataFrame, k: int = 2) -> DataFrame:
    """Keep the k best role candidates in place of the full list."""
    ranked = F.array_sort("role_candidates", lambda a, b: F.when(a["score"] > b["score"], -1)
                          .when(a["score"] < b["score"], 1).when(a["role"] < b["role"], -1).otherwise(1))
    return df.withColumn("role_candidate_preview", F.slice(ranked, 1, k)).drop("role_candidates")


def first_k(df: DataFrame, k: int, order: str = "ordinal") -> DataFrame:
    """First k rows of each run's array, in original order."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def slice_nested(df: DataFrame, path: str, k: int) -> DataFrame:
    """First k items of a nested array such as ``a[].b[].c``; the head must be a column."""
    head, *rest = path.split("[].")

    def cut(col: Column, kind: T.DataType, names: list[str]) -> Column:
        if not names:
            return F.slice(col, 1, k)
        inner = kind.elementType
        return F.transform(col, lambda x: x.withField(names[0], cut(x[names[0]], inner[names[0]].dataType, names[1:])))

    return df.withColumn(head, cut(F.col(head), df.schema[head].dataType, rest))


# ---------------------------------------------------------------- scope selection


def inferred_group(name: Column) -> Column:
    """Family stem of a column name, or the name itself when it carries no running number."""
    stem = F.concat(F.regexp_extract(name, MEMBER, 1), F.lower(F.regexp_extract(name, MEMBER, 2)))
    return F.when(name.rlike(r"[0-9]$"), stem).otherwise(name)


@dataclass(frozen=True)
class Scope:
    """Which rows of an artifact a worker sees: any listed reason admits a row, then caps apply."""

    lists: tuple[str, ...] = ()
    seeds: tuple[str, ...] = ()
    true: tuple[str, ...] = ()
    nonempty: tuple[str, ...] = ()
    at_least: dict[str, float] = field(default_factory=dict)
    at_most: dict[str, float] = field(default_factory=dict)
    per_group: int | None = None
    seeds_per_group: int | None = None
    standalone_per_group: int | None = None
    sample_extremes: bool = False
    total: int | None = None


def scope_select(df: DataFrame, spec: Scope, buckets: DataFrame | None = None, name: str = "column",
                 order: str = "ordinal", severity: str | None = None) -> DataFrame:
    """Apply ``spec``. ``buckets`` has run_id, bucket, name, rank (its position in the bucket)."""
    wanted = [*spec.seeds, *spec.lists]
    hit, seeded, position = F.lit(False), F.lit(False), F.lit(None).cast("long")
    out = df
    if wanted and buckets is not None:
        place = F.lit(None).cast("int")
        for i, b in reversed(list(enumerate(wanted))):
            place = F.when(F.col("bucket") == b, F.lit(i)).otherwise(place)
        best = (
            buckets.filter(F.col("bucket").isin(*wanted))
            .groupBy("run_id", F.col("name").alias(name))
            .agg(F.min(F.struct(place.alias("place"), F.col("rank").cast("long").alias("rank"))).alias("best_scope"))
        )
        out = out.join(best, ["run_id", name], "left")
        hit = F.col("best_scope").isNotNull()
        seeded = F.coalesce(F.col("best_scope.place") < len(spec.seeds), F.lit(False))
        position = F.col("best_scope.place") * F.lit(1_000_000) + F.col("best_scope.rank")
    reasons = [F.col(c) for c in spec.true]
    reasons += [F.coalesce(F.size(c) > 0, F.lit(False)) for c in spec.nonempty]
    reasons += [F.col(c) >= v for c, v in spec.at_least.items()]
    reasons += [F.col(c) <= v for c, v in spec.at_most.items()]
    admit = hit
    for r in reasons:
        admit = admit | F.coalesce(r, F.lit(False))
    out = out.withColumns({"scope_seed": seeded, "scope_place": position}).filter(admit)
    out = out.withColumn("scope_group", inferred_group(F.col(name)))
    line = [F.col("scope_place").asc_nulls_last(), F.col(order), F.col(name)]
    if spec.sample_extremes and severity is not None:
        group = Window.partitionBy("run_id", "scope_group", "scope_seed")
        out = out.withColumns({
            "scope_low": F.row_number().over(group.orderBy(F.col(severity), name)),
            "scope_high": F.row_number().over(group.orderBy(F.col(severity).desc(), name)),
        })
        line = [(F.col("scope_low") > 1) & (F.col("scope_high") > 1), *line]
    for cap, only in ((spec.per_group, None), (spec.seeds_per_group, True), (spec.standalone_per_group, False)):
        if cap is None:
            continue
        rank = F.row_number().over(Window.partitionBy("run_id", "scope_group", "scope_seed").orderBy(*line)
                                   if only is not None else Window.partitionBy("run_id", "scope_group").orderBy(*line))
        applies = F.lit(True) if only is None else F.col("scope_seed") == only
        out = out.withColumn("rank", rank).filter(~applies | (F.col("rank") <= cap)).drop("rank")
    if spec.total is not None:
        rank = F.row_number().over(Window.partitionBy("run_id").orderBy(
            F.col("scope_place").asc_nulls_last(), F.col(order), F.col(name)))
        out = out.withColumn("rank", rank).filter(F.col("rank") <= spec.total).drop("rank")
    return out.select(*df.columns)


def representative_and_outlier(df: DataFrame, severity: str, name: str = "column") -> DataFrame:
    """Per inferred group: the least and the most severe row (ties by name)."""
    keyed = df.withColumn("scope_group", inferred_group(F.col(name)))
    row = F.struct(*df.columns)
    picks = keyed.groupBy("run_id", "scope_group").agg(
        F.min_by(row, F.struct(F.col(severity), F.col(name))).alias("low"),
        F.min_by(row, F.struct((-F.col(severity)).alias("s"), F.col(name))).alias("high"),
    )
    return picks.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("row")).select("row.*")


# ---------------------------------------------------------------- ranked selection


def best_safe_topk(tests: DataFrame, best: DataFrame, k: int = 15) -> DataFrame:
    """The k preferred grain tests of each run, always keeping the best candidate's own test.

    ``best`` has run_id and keys; keys match in any order.
    """
    wanted = best.select("run_id", F.array_sort("keys").alias("best_keys"))
    same = F.coalesce(F.array_sort(F.split("keys_tested", ",")) == F.col("best_keys"), F.lit(False))
    order = Window.partitionBy("run_id").orderBy(
        F.col("must_keep").desc(), F.col("pivot_safety").desc(), "collision_severity_score",
        "non_key_conflict_group_pct", F.col("uniqueness_rate").desc(), "keys_tested")
    return (
        tests.join(wanted, "run_id", "left").withColumn("must_keep", same).drop("best_keys")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    )


@dataclass(frozen=True)
class RoleBuckets:
    """Role-aware column selection."""

    all_of: dict[str, int]
    top: dict[str, int] = field(default_factory=dict)
    review_top: int = 0
    exclude: tuple[str, ...] = ()
    per_group: int | None = None
    total: int = 120
    overflow_role: str | None = None


def role_buckets(df: DataFrame, spec: RoleBuckets) -> DataFrame:
    """Keep whole roles up to a cap, the top of other roles, and rows under review, in that priority.

    Adds ``bucket`` and ``overflow`` (the run has more rows of the overflow role than its cap).
    """
    caps = {**spec.all_of, **spec.top}
    role = F.col("primary_role")
    cap = F.lit(0)
    for r, c in caps.items():
        cap = F.when(role == r, c).otherwise(cap)
    in_role = Window.partitionBy("run_id", "primary_role").orderBy("column")
    rows = df.withColumn("role_rank", F.row_number().over(in_role))
    if spec.overflow_role is not None:
        limit = spec.all_of[spec.overflow_role]
        over = df.groupBy("run_id").agg((F.count_if(role == spec.overflow_role) > limit).alias("overflow"))
        rows = rows.join(over, "run_id")
    else:
        rows = rows.withColumn("overflow", F.lit(False))
    by_role = (F.col("role_rank") <= cap) & ~role.isin(*spec.exclude or ("",))
    bucket = F.when(by_role & role.isin(*spec.all_of), 0).when(by_role, 1)
    rows = rows.withColumn("bucket", bucket)
    review = F.col("review_required") & F.col("bucket").isNull() & ~role.isin(*spec.exclude or ("",))
    rank = F.row_number().over(Window.partitionBy("run_id", review).orderBy("column"))
    rows = rows.withColumn("review_rank", rank).withColumn(
        "bucket", F.coalesce("bucket", F.when(review & (F.col("review_rank") <= spec.review_top), 2)))
    rows = rows.filter(F.col("bucket").isNotNull())
    if spec.per_group is not None:
        group = Window.partitionBy("run_id", inferred_group(F.col("column"))).orderBy("bucket", "column")
        rows = rows.withColumn("rank", F.row_number().over(group)).filter(F.col("rank") <= spec.per_group).drop("rank")
    total = F.row_number().over(Window.partitionBy("run_id").orderBy("bucket", "column"))
    return rows.withColumn("rank", total).filter(F.col("rank") <= spec.total).drop("role_rank", "review_rank", "rank")


def reviewer_focus(a17: DataFrame, budget: int = 40) -> DataFrame:
    """Columns with at least two independent risk signals, worst first, up to the budget."""
    signals = [
        (F.col("confidence") <= 0.65, 3), (F.col("quality_score") <= 0.7, 3), (F.col("drift_detected"), 2),
        (F.col("skip_logic_protected"), 2), (F.col("type_review_required"), 1), (F.col("missingness_review_required"), 1),
    ]
    severity = sum([F.when(c, w).otherwise(0) for c, w in signals], F.lit(0))
    count = sum([F.when(c, 1).otherwise(0) for c, _ in signals], F.lit(0))
    order = Window.partitionBy("run_id").orderBy(F.col("severity").desc(), "column")
    return (
        a17.select("run_id", "column", severity.alias("severity"), count.alias("signals"))
        .filter(F.col("signals") >= 2)
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= budget)
    )


# ---------------------------------------------------------------- projections


def a2_grounding(a2: DataFrame, max_levels: int, preview_cap: int, levels: int,
                 priority: DataFrame | None = None) -> dict[str, DataFrame]:
    """Full name index, and value previews of low-cardinality columns with priority names first."""
    index = a2.select("run_id", "ordinal", "column")
    rows = a2.filter(F.col("unique_count") <= max_levels)
    first = F.lit(1)
    if priority is not None:
        names = priority.select("run_id", F.col("name").alias("column"), F.lit(0).alias("first")).distinct()
        rows, first = rows.join(names, ["run_id", "column"], "left"), F.coalesce("first", F.lit(1))
    order = Window.partitionBy("run_id").orderBy(first, "ordinal")
    preview = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= preview_cap).select(
        "run_id", "column", "unique_count", F.slice("top_levels", 1, levels).alias("top_levels"))
    return {"columns_index": index, "low_cardinality_value_preview": preview}


def a12_grounding(layouts: DataFrame, preferred: DataFrame, top: int = 2, placements: int = 12,
                  ambiguities: int = 8) -> DataFrame:
    """Best layouts, those on the preferred grain first, with their lists shortened."""
    want = preferred.select("run_id", F.array_sort("keys").alias("want"))
    match = F.coalesce(F.array_sort("grain_keys") == F.col("want"), F.lit(False))
    order = Window.partitionBy("run_id").orderBy(F.col("preferred_grain_match").desc(), F.col("score").desc(), "layout_id")
    return (
        layouts.join(want, "run_id", "left").withColumn("preferred_grain_match", match).drop("want")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        .withColumns({"column_placements": F.slice("column_placements", 1, placements),
                      "ambiguities": F.slice("ambiguities", 1, ambiguities)})
    )


def family_scope(df: DataFrame, accepted: DataFrame, cap: int = 40) -> DataFrame:
    """Rows of accepted families only, capped per run."""
    kept = df.join(accepted.select("run_id", "family_id").distinct(), ["run_id", "family_id"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("family_id"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= cap).drop("rank")


def accounting(views: dict[str, DataFrame]) -> DataFrame:
    """Rows and compact-JSON bytes per run and artifact."""
    parts = [
        df.select("run_id", F.lit(name).alias("artifact"),
                  F.octet_length(F.to_json(F.struct(*[c for c in df.columns if c != "run_id"]))).alias("size"))
        for name, df in views.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("run_id", "artifact").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))


def accounting_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change in rows and bytes between two bundles; an artifact may exist in one of them only."""
    a = before.select("run_id", "artifact", F.col("n_rows").alias("rows_before"), F.col("n_bytes").alias("bytes_before"))
    b = after.select("run_id", "artifact", F.col("n_rows").alias("rows_after"), F.col("n_bytes").alias("bytes_after"))
    joined = a.join(b, ["run_id", "artifact"], "full").na.fill(0)
    return joined.withColumns({"rows_delta": F.col("rows_after") - F.col("rows_before"),
                               "bytes_delta": F.col("bytes_after") - F.col("bytes_before")})


# ---------------------------------------------------------------- scope buckets


def force_include(grain: DataFrame, references: DataFrame, family_parents: DataFrame, a2: DataFrame) -> DataFrame:
    """Structural columns that must survive pruning: grain keys, reference keys, family parent keys."""
    names = grain.select("run_id", F.explode("keys").alias("column")).unionByName(
        references.select("run_id", F.explode("keys").alias("column"))).unionByName(
        family_parents.select("run_id", F.col("parent_key").alias("column")))
    return names.distinct().join(a2.select("run_id", "column"), ["run_id", "column"], "left_semi")


def auto_scope(transform_items: DataFrame, type_items: DataFrame, role_rows: DataFrame, skip_rules: DataFrame,
               focus: DataFrame, preview: int = 5) -> DataFrame:
    """Server-side scope buckets as rows ``(run_id, bucket, name, rank)``; rank keeps insertion order."""
    def rows(df: DataFrame, bucket: str, name: str, rank: Column) -> DataFrame:
        return df.select("run_id", F.lit(bucket).alias("bucket"), F.col(name).alias("name"), rank.cast("long").alias("rank"))

    zero, one = F.lit(0), F.lit(1)
    affected = Window.partitionBy("run_id", "trigger_column").orderBy("affected_column")
    parts = [
        rows(transform_items, "review_columns", "column", zero),
        rows(type_items, "review_columns", "column", one),
        rows(role_rows.filter(F.col("primary_role").isin("id_key", "time_index", "repeat_index")),
             "structural_columns", "column", zero),
        rows(skip_rules, "skip_trigger_columns", "trigger_column", zero),
        rows(skip_rules.withColumn("n", F.row_number().over(affected)).filter(F.col("n") <= preview),
             "skip_affected_preview_columns", "affected_column", F.col("n")),
        rows(focus, "reviewer_focus_columns", "column", F.col("rank")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("run_id", "bucket", "name").agg(F.min("rank").alias("rank"))


def known_columns(*frames: DataFrame) -> DataFrame:
    """Distinct (run_id, column) over several sources."""
    out = frames[0].select("run_id", "column")
    for f in frames[1:]:
        out = out.unionByName(f.select("run_id", "column"))
    return out.distinct()


def review_scope(explicit: DataFrame, *sources: DataFrame) -> DataFrame:
    """The explicit list of a run when it has one, else the union of the sources."""
    listed = explicit.select("run_id").distinct()
    return explicit.select("run_id", "column").distinct().unionByName(
        known_columns(*sources).join(listed, "run_id", "left_anti"))
