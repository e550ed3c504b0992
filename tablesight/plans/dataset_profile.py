"""The whole evidence bundle of one dataset."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesight import vocab
from tablesight.functions import cells
from tablesight.operators import claims, families, keys, lattice, profile, structure
from tablesight.plans.shared import cut
from tablesight.sources import tables


@dataclass(frozen=True)
class Options:
    """What the bundle reports. ``key_columns`` is how many of the best key seeds have their pairs reported as
    runner-up grains and their stress tested. Keys are sought in all columns, of up to ``key_parts`` where no
    narrower ones identify rows; every other search takes all columns that its rule admits."""

    key_columns: int = 12
    key_parts: int = 4
    glimpse_rows: int = 3
    preferred_grain: Sequence[str] | None = None


#: Key sets, attributes and claims of one aggregation; more are taken in turn.
KEY_SETS_AT_ONCE, ATTRIBUTES_AT_ONCE, CLAIMS_AT_ONCE = 40, 40, 400


def _chunked(items: Sequence, size: int, run: Callable[[Sequence], DataFrame], none: DataFrame | None = None) -> DataFrame:
    """The union of ``run`` over parts of ``items``, each part computed and cut off before the next; ``none`` if there are no items."""
    parts = [cut(run(items[a : a + size])) for a in range(0, len(items), size)]
    return reduce(DataFrame.unionByName, parts) if parts else none


def profile_dataset(df: DataFrame, run_id: str, source: str = "", options: Options = Options()) -> dict[str, DataFrame]:
    """Artifact frames by id. ``df`` is read once for the histogram, once for the long texts it shows and once per structural test.

    Column-grain results (one row per column) are brought to the driver to pick candidate columns;
    dataset rows never are.
    """
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    hist = profile.with_texts(cut(profile.digest_histogram(text, run_id)), text, run_id)
    shares = cut(profile.parse_shares(hist))
    stats = cut(profile.column_stats(hist))
    catalog = families.column_catalog(df, run_id)
    found = cut(families.families(catalog))
    members = families.membership(found)
    role_rows = cut(structure.roles(shares, members))
    missingness = profile.missingness_catalog(hist)
    anchors, quality = profile.semantic_anchors(shares), profile.quality(hist)

    facts = {r["column"]: r for r in stats.join(shares.select("run_id", "column", "numeric_share", "datetime_share", "integral_share"), ["run_id", "column"]).collect()}
    member_names = {r["column"] for r in members.select("column").collect()}
    indexes = {r["column"] for r in families.rejected_names(catalog).collect()}
    usable = [c for c in df.columns if c not in indexes]
    by_key = sorted((c for c in usable if c not in member_names), key=lambda c: (-facts[c]["unique_ratio"], facts[c]["missing_pct"], c))
    seeds = by_key[: options.key_columns]
    few = [c for c in usable if 2 <= facts[c]["unique_count"] <= vocab.LOW_CARDINALITY]
    gaps = [c for c in usable if facts[c]["missing_pct"] > 0]
    triggers = [c for c in usable if 2 <= facts[c]["unique_count"] <= vocab.CODED_LEVELS and facts[c]["missing_pct"] < 50]
    linked = list(dict.fromkeys([*(c for c in few if c not in member_names), *seeds]))

    levels, n_rows = lattice.level_counts(hist)  # null and missing texts are values of a key
    known = lattice.sampled_witnesses(text, usable, levels, n_rows)
    minimal = lattice.minimal_keys(text, by_key, levels, n_rows, known, options.key_parts, narrowest=True)
    pairs = keys.worthwhile_sets(seeds, levels, n_rows)
    sets = [list(s) for s in [*((c,) for c in seeds), *pairs] if s not in minimal]
    spark = df.sparkSession
    proven = spark.createDataFrame([(run_id, ",".join(k), n_rows, n_rows, 1.0, 0.0, 0.0, True) for k in minimal], keys.GRAIN_TESTS)
    tested = _chunked(sets, KEY_SETS_AT_ONCE, lambda part: keys.grain_tests(text, run_id, part), proven.limit(0)).unionByName(proven)
    tests = cut(keys.ranked_grains(keys.reject_fake_grains(
        tested,
        catalog.join(members, ["run_id", "column"], "left").withColumn("is_export_index", F.col("column").isin(*indexes) if indexes else F.lit(False)))))
    best = [r["keys_tested"].split(",") for r in tests.filter("grain_rank = 1").collect()]
    stress = _chunked(usable if seeds else [], ATTRIBUTES_AT_ONCE, lambda part: keys.key_stress(text, run_id, [[c] for c in seeds], part),
                      spark.createDataFrame([], keys.KEY_STRESS))
    examples = _chunked(usable if seeds else [], ATTRIBUTES_AT_ONCE, lambda part: keys.stress_examples(text, run_id, [[c] for c in seeds if levels[c] < n_rows] or [seeds[:1]], part),
                        spark.createDataFrame([], keys.STRESS_EXAMPLES))
    out: dict[str, DataFrame] = {
        "A1": tables.manifest(df, run_id, source),
        "A2": profile.a2_rows(hist, shares).join(catalog, ["run_id", "column"]),
        "A3-T.items": profile.with_snippets(profile.transform_queue(shares), profile.sample_maps(hist)),
        "A3-V.items": profile.type_queue(shares),
        "A4.per_column": missingness.join(profile.missing_token_maps(hist), ["run_id", "column"], "left"),
        "A4.global_tokens": profile.global_tokens(hist),
        "A5.single_column_key_seed_candidates": keys.single_key_seeds(stats),
        # the pairs are among the tested grains, so their seeds are read off those tests
        "A5.pair_key_seed_candidates": tests.filter(F.size(F.split("keys_tested", ",")) == 2).select(
            "run_id", F.col("keys_tested").alias("pair"), "n_groups", F.col("uniqueness_rate").alias("pair_ratio")),
        "A5.candidate_key_stress_tests": keys.nested_stress(stress, examples),
        "A5.invariant_candidates_checked": keys.invariants(stress),
        "A6.tests": tests,
        "A6.minimal_keys": lattice.key_rows(text, run_id, minimal),
        "A7.exact_duplicate_clusters": keys.duplicate_clusters(text, run_id, usable, (best[0] if best else usable)[0]),
        "A8.families": found,
        "A8.families_index": families.families_index(found),
        "A8.near_misses": families.near_misses(catalog),
        "A8.rejected_candidates": families.rejected_names(catalog),
        "A8.coverage": families.coverage(catalog, found),
        "A9.columns": role_rows,
        "A10.coded_categorical_flags": keys.coded_categoricals(shares),
        "A10.time_column_candidates": keys.time_candidates(shares),
        "A11": profile.glimpses(text, run_id, (best[0] if best else usable)[0], usable, options.glimpse_rows),
        "A12.layout_candidates": structure.layout_candidates(
            tests, role_rows, members, df.sparkSession.createDataFrame(
                [(run_id, list(options.preferred_grain))], "run_id string, keys array<string>") if options.preferred_grain else None),
        "A13.columns": anchors,
        "B1": families.packets(found, stats, missingness, tests),
    }
    if best:
        out["A7.key_collisions"] = keys.key_collisions(text, run_id, best[0])
    out["A10.functional_dependencies"] = lattice.dependency_rows(text, run_id, lattice.functional_dependencies(text, usable, levels, n_rows, minimal, known))
    if len(linked) > 1:
        out["A10.dependency_candidates"] = _chunked(linked, KEY_SETS_AT_ONCE, lambda xs: _chunked(
            linked, ATTRIBUTES_AT_ONCE, lambda ys: keys.dependencies(text, run_id, xs, ys)))
        twins = keys.candidate_column_pairs(hist, usable)
        if twins:
            out["A10.near_duplicate_candidates"] = _chunked(twins, CLAIMS_AT_ONCE, lambda part: keys.near_duplicate_columns(
                text, run_id, part)).where(F.col("agreement") >= 0.95)
    hot = [r["column"] for r in profile.one_hot_like(hist).filter("is_one_hot_like").collect()]
    blocks = {r["family_id"]: r["columns"] for r in found.select("family_id", "columns").collect()}
    hot_blocks = {f: c for f, c in blocks.items() if set(c) <= set(hot)}
    if hot_blocks:
        out["A10.one_hot_blocks"] = keys.one_hot_blocks(text, run_id, hot_blocks)
    time = [c for c in usable if facts[c]["datetime_share"] >= vocab.TYPE_SHARE]
    numeric = [c for c in usable if facts[c]["numeric_share"] >= vocab.TYPE_SHARE and c not in member_names]
    spread = [c for c in numeric if levels[c] > vocab.LOW_CARDINALITY and c not in time]
    shared = [c for c in usable if c not in spread and 2 <= levels[c] <= max(vocab.LOW_CARDINALITY, n_rows // 10)]  # beyond, nearly every value is new
    timed = text.select(*[(cells.as_datetime(F.col(f"`{c}`")).alias(c) if c in time else F.col(f"`{c}`")) for c in text.columns])
    out["A14.drift"] = drift = cut(profile.all_drift(timed, run_id, time, shared, spread))
    drift_rows = drift.groupBy("run_id", "column").agg(F.max("drift_distance").alias("drift_distance"), F.bool_or("drift_detected").alias("drift_detected"))
    out["A14.columns"] = quality.join(drift_rows, ["run_id", "column"], "left")  # null: not tested for drift
    entities = [c for c in seeds if levels[c] < n_rows and c not in time]
    typed = text.select(*[cells.as_double(F.col(f"`{c}`")).alias(c) for c in numeric], *[cells.as_datetime(F.col(f"`{c}`")).alias(c) for c in time],
                        *[F.col(f"`{c}`") for c in entities if c not in numeric])
    out["A10.deterministic_constraints"] = claims.deterministic_constraints(typed, run_id, numeric, time, n_rows)
    whole = [c for c in numeric if facts[c]["integral_share"] >= vocab.TYPE_SHARE]
    out["A9.columns"] = structure.refined_roles(role_rows, structure.repeat_indexes(text, run_id, entities, whole), shares)
    out["A10.audit_trail_signals"] = claims.audit_signals(typed, run_id, [c for c in numeric if (c,) in minimal], entities, time, time)
    if blocks and triggers:
        screens = [c for c in triggers if c not in member_names]
        if screens:
            out["A10.family_screening_correlations"] = keys.all_screening_correlations(text, run_id, screens, blocks).filter("correlation is not null")
    none = "run_id string, trigger_column string, trigger_value string, trigger_test string, affected_column string, missing_explained_pct double, directionality string"
    rules = structure.all_skip_logic(text, run_id, triggers, gaps) if triggers and gaps else df.sparkSession.createDataFrame([], none)
    out["A16.detected_skip_logic"] = rules = cut(rules)
    out["A16.summary"] = structure.skip_summary(rules, members)
    out["A16.master_switch_candidates"] = structure.master_switches(rules)
    out["A17.columns"] = structure.baseline_resolution(
        out["A2"].drop("ordinal"), role_rows, missingness, anchors, quality,
        out["A14.columns"].select("run_id", "column", "drift_detected"), rules, out["A3-T.items"], out["A3-V.items"])
    return out
