"""Column evidence: counts, levels, samples, parse shares, candidate types, anchors, quality.

Everything here starts from one shared frame, the *cell histogram*: one row per run, column and
distinct cell text with its count. Building it costs one scan and one shuffle with map-side
combine, and every later metric reads each distinct text once instead of each cell.

Of columns with long texts ``digest_histogram`` moves digests only: what the metrics ask of a long text is
answered in one number before the shuffle, and ``with_texts`` reads back the few texts that results show.
All functions take either histogram.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesight import vocab
from tablesight.functions import cells
from tablesight.plans.shared import left_join_lookup, stored

KEY = ["run_id", "column"]
DIGEST_KEY = [*KEY, "digest"]


def _run(run_id: str | Column) -> Column:
    return F.lit(run_id) if isinstance(run_id, str) else run_id


def long_cells(df: DataFrame, run_id: str | Column, columns: list[str] | None = None) -> DataFrame:
    """One row per cell: run_id, column, value (text)."""
    columns = columns or df.columns
    narrow = df.select(
        _run(run_id).alias("run_id"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    )
    return narrow.unpivot("run_id", [f"`{c}`" for c in columns], "column", "value")


def cell_histogram(df: DataFrame, run_id: str | Column, columns: list[str] | None = None) -> DataFrame:
    """run_id, column, value, n. Constant columns collapse before the shuffle."""
    return long_cells(df, run_id, columns).groupBy("run_id", "column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def _text_flags(value: Column) -> dict[str, Column]:
    """What the metrics ask of a text, null for some questions about a null one."""
    text = cells.trimmed(value)
    return {
        "missing": cells.is_missing(value),
        "blank": cells.is_blank(value),
        "zero": text == "0",
        "one": text == "1",
        "solid": text.rlike(r"^\S+$"),
        "numeric": cells.as_double(value).isNotNull(),
        "integral": cells.read_number(value).rlike(cells.INTEGRAL),
        "datetime": cells.as_datetime(value).isNotNull(),
        "time_of_day": text.rlike(cells.DATETIME_FORMATS[0][0]) | text.rlike(cells.DATETIME_FORMATS[1][0]),
        "boolean": cells.as_boolean(value).isNotNull(),
        "range_like": text.rlike(cells.RANGE),
        "numeric_with_unit": text.rlike(cells.UNIT),
        "categorical_multi": text.rlike(cells.MULTI),
        "percent": text.rlike(cells.PERCENT),
        "currency": text.rlike(cells.CURRENCY),
        "email": text.rlike(cells.EMAIL),
        "url": text.rlike(cells.URL),
        "code": text.rlike(cells.CODE),
        "country": text.rlike(cells.COUNTRY),
        "words": text.rlike(cells.WORDS),
        "prose": text.rlike(cells.PROSE),
    }


#: Longest text, in characters, that a histogram key holds as it is, and by how much heads grow while too many texts tie.
HEAD, GROWTH = 64, 8
#: Most digests looked up by broadcast where more than those of the results tie.
LOOKUP_ROWS = 10_000
SAMPLE_SEED = 7
_TOKEN_SHIFT = 40


def _draw(value: Column, seed: int = SAMPLE_SEED) -> Column:
    return F.md5(F.concat(value, F.lit(f"#{seed}")))


def _bits(value: Column) -> Column:
    """The flags of a text and the place of the placeholder it spells, as one long."""
    flags = [F.when(flag, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, flag in enumerate(_text_flags(value).values())]
    token = F.coalesce(F.array_position(F.array(*map(F.lit, vocab.MISSING_TOKENS)), cells.missing_token(value)), F.lit(0))
    return reduce(lambda a, b: a.bitwiseOR(b), flags, F.shiftleft(token.cast("long"), _TOKEN_SHIFT))


def _long_keys(df: DataFrame, run_id: str | Column, columns: list[str] | None) -> DataFrame:
    """``long_cells`` with the digest of long texts, which is also their draw for samples; null for short ones."""
    value = F.col("value")
    return long_cells(df, run_id, columns).withColumn("digest", F.when(F.length(value) > HEAD, F.unhex(_draw(value))))


def digest_histogram(df: DataFrame, run_id: str | Column, columns: list[str] | None = None) -> DataFrame:
    """run_id, column, value, digest, n, bits: the cell histogram without moving long texts.

    A text above ``HEAD`` characters is known by a 128-bit digest; ``value`` holds its head, and ``bits`` what the
    metrics ask of it. Shorter texts are as in ``cell_histogram``, with null digest and bits.
    """
    value = F.col("value")
    keyed = _long_keys(df, run_id, columns)
    narrow = keyed.select(*KEY, F.substring(value, 1, HEAD).alias("value"), "digest", F.when(F.col("digest").isNotNull(), _bits(value)).alias("bits"))
    return narrow.groupBy(*KEY, "value", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("bits").alias("bits"))


def _heads(df: DataFrame, run_id: str | Column, wanted: DataFrame, columns: list[str], width: int | None, few: bool) -> DataFrame:
    """run_id, column, digest, text of ``wanted`` (run_id, column, digest): the first ``width`` characters, or all."""
    keyed = _long_keys(df, run_id, columns).where(F.col("digest").isNotNull())
    text = F.col("value") if width is None else F.substring("value", 1, width)
    rows = keyed.select(*DIGEST_KEY, text.alias("text"))
    # not a semi join, which would be moved before the cut to heads
    return rows.join(F.broadcast(wanted) if few else wanted, DIGEST_KEY).groupBy(*DIGEST_KEY).agg(F.min("text").alias("text"))


def with_texts(hist: DataFrame, df: DataFrame, run_id: str | Column, k: int = 8, n: int = 5, seed: int = SAMPLE_SEED) -> DataFrame:
    """``hist`` of ``digest_histogram``, with the whole texts of all ``top_levels(k)`` and ``samples(n)`` in ``value``.

    Levels are ordered by text where counts tie, and heads may tie as well. All that tie at the edge are looked
    up; while these are many, longer heads are read for them, and only heads move. ``hist`` is made once; ``df`` is
    read once where columns hold long texts and once more per such round. ``whole`` tells texts from heads; no text that is only
    a head is among the levels up to ``k``. A null cell and an empty table have nothing to look up.
    """
    made = stored(hist, "narrow-histogram")  # heads and digests, read several times
    long = made.where("digest is not null").select(*KEY).distinct().collect()
    columns = sorted({r["column"] for r in long})
    if not long:
        return hist
    hist = made
    shown = hist.where(F.col("column").isin(*columns))
    levels, width = shown.where(~_flag(hist, "missing")).select(*DIGEST_KEY, "value", "n"), HEAD
    drawn = samples(shown, n, seed, keep=("digest",)).where("digest is not null").select(*DIGEST_KEY)
    edge = Window.partitionBy(*KEY).orderBy(F.col("n").desc(), F.col("value"))
    while True:
        levels = stored(levels.withColumn("rank", F.rank().over(edge)).where(F.col("rank") <= k).drop("rank"), "levels")
        wanted = stored(levels.where("digest is not null").select(*DIGEST_KEY).unionByName(drawn).distinct(), "wanted")
        if wanted.count() <= max(LOOKUP_ROWS, (k + n) * len(long)):
            break
        width *= GROWTH
        longer = _heads(df, run_id, wanted, columns, width, few=False)
        levels = levels.join(longer, DIGEST_KEY, "left").select(*DIGEST_KEY, F.coalesce("text", "value").alias("value"), "n")
    texts = stored(_heads(df, run_id, wanted, columns, None, few=True), "texts")
    named = hist.join(F.broadcast(wanted), DIGEST_KEY, "left_semi").drop("value").join(texts.withColumnRenamed("text", "value"), DIGEST_KEY)
    rest = hist.join(F.broadcast(wanted), DIGEST_KEY, "left_anti").withColumn("whole", F.col("digest").isNull())
    return stored(rest.unionByName(named.withColumn("whole", F.lit(True))), "histogram")


def _flags(hist: DataFrame) -> dict[str, Column]:
    """The flags of the rows of either histogram."""
    plain = _text_flags(F.col("value"))
    if "digest" not in hist.columns:
        return plain
    return {k: F.when(F.col("digest").isNull(), c).otherwise(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0) for i, (k, c) in enumerate(plain.items())}


def _flag(hist: DataFrame, name: str) -> Column:
    return _flags(hist)[name]


def _token(hist: DataFrame) -> Column:
    """The placeholder a row's text spells, or null."""
    plain = cells.missing_token(F.col("value"))
    if "digest" not in hist.columns:
        return plain
    place = F.shiftright("bits", _TOKEN_SHIFT).cast("int") - 1
    return F.when(F.col("digest").isNull(), plain).otherwise(F.get(F.array(*map(F.lit, vocab.MISSING_TOKENS)), place))


def _tagged(hist: DataFrame) -> DataFrame:
    return hist.withColumn("missing", _flag(hist, "missing"))


def _weight(cond: Column) -> Column:
    return F.sum(F.when(cond & ~F.col("missing"), F.col("n")).otherwise(0))


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 6)


def column_stats(hist: DataFrame) -> DataFrame:
    """Row, missing and distinct counts per column."""
    present = F.sum(F.when(~F.col("missing"), F.col("n")).otherwise(0))
    counts = _tagged(hist).groupBy(*KEY).agg(
        F.sum("n").alias("n_rows"),
        present.alias("n_present"),
        F.count_if(~F.col("missing")).alias("unique_count"),
    )
    missing_pct = F.round(100 * (F.col("n_rows") - F.col("n_present")) / F.col("n_rows"), 6)
    return counts.select(
        *KEY,
        "n_rows",
        missing_pct.alias("missing_pct"),
        "unique_count",
        _share(F.col("unique_count"), F.col("n_present")).alias("unique_ratio"),
        (missing_pct >= vocab.HIGH_MISSING_PCT).alias("high_missingness"),
    )


def column_stats_approx(df: DataFrame, run_id: str | Column, columns: list[str] | None = None,
                        rsd: float = 0.02) -> DataFrame:
    """As ``column_stats`` with sketch-based distinct counts: one scan, no data-sized shuffle."""
    rows = long_cells(df, run_id, columns).withColumn("missing", cells.is_missing(F.col("value")))
    counts = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("missing")).alias("n_present"),
        F.approx_count_distinct(F.when(~F.col("missing"), F.col("value")), rsd).alias("unique_count"),
    )
    missing_pct = F.round(100 * (F.col("n_rows") - F.col("n_present")) / F.col("n_rows"), 6)
    return counts.select(
        *KEY, "n_rows", missing_pct.alias("missing_pct"), "unique_count",
        _share(F.col("unique_count"), F.col("n_present")).alias("unique_ratio"),
        (missing_pct >= vocab.HIGH_MISSING_PCT).alias("high_missingness"),
    )


def top_levels(hist: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent non-missing texts of each column, ties by text."""
    order = Window.partitionBy(*KEY).orderBy(F.col("n").desc(), F.col("value"))
    if "whole" in hist.columns:  # heads, which were ruled out by longer ones
        hist = hist.filter("whole")
    return (
        hist.filter(~_flag(hist, "missing"))
        .select(*KEY, "value", "n")
        .withColumn("level_rank", F.row_number().over(order))
        .filter(F.col("level_rank") <= k)
    )


def top_level_arrays(hist: DataFrame, k: int = 8) -> DataFrame:
    """top_levels folded to one ordered array per column (at most k items)."""
    packed = F.array_sort(F.collect_list(F.struct("level_rank", "value")))
    return top_levels(hist, k).groupBy(*KEY).agg(
        F.transform(packed, lambda x: x["value"]).alias("top_levels")
    )


def samples(hist: DataFrame, n: int = 5, seed: int = SAMPLE_SEED, keep: Sequence[str] = ()) -> DataFrame:
    """n pseudo-random distinct texts per column; the same every time for one seed. ``keep`` names more columns of ``hist``."""
    draw = _draw(F.col("value"), seed)
    if "digest" in hist.columns:
        known = F.lower(F.hex("digest"))  # the draw of the usual seed
        draw = F.when(F.col("digest").isNull(), draw).otherwise(known if seed == SAMPLE_SEED else _draw(known, seed))
    order = Window.partitionBy(*KEY).orderBy("draw", "value")
    return (
        hist.filter(~_flag(hist, "missing"))
        .select(*KEY, "value", *keep, draw.alias("draw"))
        .withColumn("sample_rank", F.row_number().over(order))
        .filter(F.col("sample_rank") <= n)
        .drop("draw")
    )


def sample_maps(hist: DataFrame, n: int = 5, seed: int = 7) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct("sample_rank", "value")))
    return samples(hist, n, seed).groupBy(*KEY).agg(
        F.create_map(F.lit("random"), F.transform(packed, lambda x: x["value"])).alias("a2_samples")
    )


def missing_tokens(hist: DataFrame) -> DataFrame:
    """Placeholder texts seen per column with their counts."""
    return (
        hist.withColumn("token", _token(hist))
        .filter(F.col("token").isNotNull())
        .groupBy(*KEY, "token")
        .agg(F.sum("n").alias("n"))
    )


def missing_token_maps(hist: DataFrame) -> DataFrame:
    """token -> count per column; at most one entry per known token."""
    return missing_tokens(hist).groupBy(*KEY).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "n")))).alias("token_breakdown")
    )


def missingness_catalog(hist: DataFrame) -> DataFrame:
    """Missing share per column, split into blank or null cells and placeholder cells."""
    tagged = hist.select(
        *KEY, "n",
        _flag(hist, "blank").alias("blank"),
        _token(hist).isNotNull().alias("token"),
    )
    counts = tagged.groupBy(*KEY).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("parser_na_count"),
        F.sum(F.when(F.col("token"), F.col("n")).otherwise(0)).alias("token_na_count"),
    )
    missing = F.col("parser_na_count") + F.col("token_na_count")
    return counts.select(
        *KEY, "n_rows", "parser_na_count", "token_na_count",
        F.round(100 * missing / F.col("n_rows"), 6).alias("missing_pct"),
    )


def global_tokens(hist: DataFrame) -> DataFrame:
    """Per run and placeholder: cells, columns it appears in, and whether it is dataset-wide."""
    return missing_tokens(hist).groupBy("run_id", "token").agg(
        F.sum("n").alias("n_cells"),
        F.count(F.lit(1)).alias("n_columns"),
    ).withColumn(
        "token_classification",
        F.when(F.col("n_columns") > 1, "global").otherwise("column_local"),
    )


def parse_shares(hist: DataFrame) -> DataFrame:
    """Share of non-missing cells that fit each textual shape."""
    flags = {k: c for k, c in _flags(hist).items() if k not in ("missing", "blank", "zero", "one", "solid")}
    tagged = _tagged(hist).select(*KEY, "n", "missing", *[c.alias(k) for k, c in flags.items()])
    counts = tagged.groupBy(*KEY).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(~F.col("missing"), F.col("n")).otherwise(0)).alias("n_present"),
        F.count_if(~F.col("missing")).alias("unique_count"),
        *[_weight(F.col(k)).alias(k) for k in flags],
    )
    return counts.select(
        *KEY, "n_rows", "n_present", "unique_count",
        *[_share(F.col(k), F.col("n_present")).alias(f"{k}_share") for k in flags],
    )


def parseability(shares: DataFrame) -> DataFrame:
    return shares.select(
        *KEY,
        F.round(100 * F.col("numeric_share"), 4).alias("numeric_parseable_pct"),
        F.round(100 * F.col("datetime_share"), 4).alias("datetime_parseable_pct"),
    )


# First reading that enough cells support wins.
_LADDER = (
    ("datetime", "datetime_share", vocab.TYPE_SHARE),
    ("numeric", "numeric_share", vocab.TYPE_SHARE),
    ("boolean", "boolean_share", vocab.TYPE_SHARE),
    ("range_like", "range_like_share", vocab.TYPE_SHARE),
    ("numeric_with_unit", "numeric_with_unit_share", vocab.TYPE_SHARE),
    ("categorical_multi", "categorical_multi_share", vocab.MULTI_SHARE),
)


def candidate_types(shares: DataFrame) -> DataFrame:
    """Best reading of each column with the share of cells behind it."""
    ratio = _share(F.col("unique_count"), F.col("n_present"))
    few = (F.col("unique_count") <= vocab.LOW_CARDINALITY) | (ratio <= vocab.LOW_UNIQUE_RATIO)
    kind, confidence = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, share, cut in reversed(_LADDER):
        kind = F.when(F.col(share) >= cut, F.lit(name)).otherwise(kind)
        confidence = F.when(F.col(share) >= cut, F.col(share)).otherwise(confidence)
    plain = F.when(few, F.lit("categorical")).otherwise(F.lit("text"))
    best_typed = F.greatest(*[F.col(s) for _, s, _ in _LADDER])
    return shares.select(
        *KEY,
        F.coalesce(kind, plain).alias("candidate_type"),
        F.coalesce(confidence, F.round(1 - best_typed, 6)).alias("confidence"),
    )


def transform_queue(shares: DataFrame, cut: float = 0.5) -> DataFrame:
    """Columns whose cells need reshaping before they can be typed, one row per reason."""
    reasons = ("categorical_multi", "range_like", "numeric_with_unit", "percent", "currency")
    items = F.array_compact(F.array(*[
        F.when(F.col(f"{r}_share") >= (0.05 if r == "currency" else cut),
               F.struct(F.lit("percent_possible" if r == "percent" else r).alias("reason"),
                        F.col(f"{r}_share").alias("share")))
        for r in reasons
    ]))
    return shares.select(*KEY, F.explode(items).alias("item")).select(*KEY, "item.reason", "item.share")


def with_snippets(items: DataFrame, sample_rows: DataFrame) -> DataFrame:
    """Queue items with a few sample cells behind each, keyed by reason."""
    joined = items.join(sample_rows, KEY, "left")
    return joined.withColumn("evidence_snippets", F.create_map("reason", F.coalesce(
        F.element_at("a2_samples", "random"), F.array().cast("array<string>")))).drop("a2_samples")


def type_queue(shares: DataFrame, margin: float = 0.5) -> DataFrame:
    """Columns with two readings close together; the runner-up is within ``margin`` of the best."""
    scored = F.array_sort(
        F.array(*[
            F.struct((-F.col(s)).alias("minus"), F.lit(k).alias("kind")) for k, s, _ in _LADDER
        ])
    )
    ranked = shares.select(*KEY, scored.alias("scored"))
    best, second = F.col("scored")[0], F.col("scored")[1]
    return ranked.select(
        *KEY,
        best["kind"].alias("best_type"), F.abs(best["minus"]).alias("best_share"),
        second["kind"].alias("second_type"), F.abs(second["minus"]).alias("second_share"),
    ).filter((F.col("second_share") > 0) & (F.col("best_share") - F.col("second_share") <= margin))


def one_hot_like(hist: DataFrame) -> DataFrame:
    """True for columns whose only non-missing texts are 0 and 1, both present."""
    zero, one = _flag(hist, "zero"), _flag(hist, "one")
    return _tagged(hist).groupBy(*KEY).agg(
        (
            (F.count_if(~F.col("missing") & ~(zero | one)) == 0)
            & (F.count_if(zero) > 0)
            & (F.count_if(one) > 0)
        ).alias("is_one_hot_like")
    )


_ANCHORS = (("COUNTRY", "country_share"), ("DATE", "datetime_share"), ("EMAIL", "email_share"),
            ("ID_CODE", "code_share"), ("URL", "url_share"))


def semantic_anchors(shares: DataFrame) -> DataFrame:
    """Recognised meanings per column, as an array of {anchor, share}."""
    found = F.array_compact(F.array(*[
        F.when(F.col(s) >= vocab.ANCHOR_SHARE,
               F.struct(F.lit(a).alias("anchor"), F.col(s).alias("share")))
        for a, s in _ANCHORS
    ]))
    return shares.select(*KEY, found.alias("detected_anchors"))


def quality(hist: DataFrame) -> DataFrame:
    """Quality score, entropy of values, and how mixed the textual shapes are."""
    flags = _flags(hist)
    shape = (
        F.when(flags["numeric"], "number")
        .when(flags["datetime"], "date")
        .when(flags["words"], "words")
        .when(flags["solid"], "code")
        .otherwise("text")
    )
    shapes = ("number", "date", "words", "code", "text")
    tagged = _tagged(hist).select(*KEY, "n", "missing", shape.alias("shape"))
    n = F.col("n").cast("double")
    counts = tagged.groupBy(*KEY).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(~F.col("missing"), F.col("n")).otherwise(0)).alias("n_present"),
        F.sum(F.when(~F.col("missing"), n * F.ln(n)).otherwise(0.0)).alias("n_ln_n"),
        *[_weight(F.col("shape") == s).alias(s) for s in shapes],
    )
    total = F.col("n_present").cast("double")
    dominant = F.coalesce(F.try_divide(F.greatest(*shapes), total), F.lit(0.0))
    entropy = F.when(F.col("n_present") > 0, F.ln(total) - F.col("n_ln_n") / total).otherwise(0.0)
    return counts.select(
        *KEY,
        F.round(F.col("n_present") / F.col("n_rows") * dominant, 6).alias("global_quality_score"),
        F.abs(F.round(entropy, 6)).alias("entropy"),
        F.round(1 - dominant, 6).alias("mixedness"),
    )


def drift(df: DataFrame, run_id: str | Column, order_by: str, columns: list[str]) -> DataFrame:
    """Total-variation distance between the value shares of the early and the late half.

    The halves split the range of ``order_by`` at its midpoint, so no global sort is needed. For one
    dataset the boundary is a scalar; for a fleet it is looked up by run.
    """
    run = _run(run_id)
    at = F.unix_micros(F.col(order_by).cast("timestamp")) if dict(df.dtypes)[order_by].startswith(
        ("timestamp", "date")) else F.col(order_by).cast("double")
    keyed = df.select(run.alias("run_id"), at.alias("at"), *[F.col(c).cast("string") for c in columns])
    middle = ((F.min("at") + F.max("at")) / 2).alias("middle")
    if isinstance(run_id, str):
        split = keyed.withColumn("late", F.col("at") > keyed.agg(middle).scalar()).drop("at")
    else:
        bounded = left_join_lookup(keyed, keyed.groupBy("run_id").agg(middle), ["run_id"])
        split = bounded.withColumn("late", F.col("at") > F.col("middle")).drop("at", "middle")
    long = split.unpivot(["run_id", "late"], columns, "column", "value")
    hist = long.groupBy(*KEY, "value").agg(
        F.count_if(~F.col("late")).alias("early_n"), F.count_if(F.col("late")).alias("late_n")
    )
    # Both totals come from the already reduced histogram, so the distance needs no second pass
    # over the rows: sum |e/E - l/L| with E and L joined back at column grain.
    totals = hist.groupBy(*KEY).agg(F.sum("early_n").alias("early_total"), F.sum("late_n").alias("late_total"))
    gap = F.abs(F.try_divide("early_n", "early_total") - F.try_divide("late_n", "late_total"))
    return (
        left_join_lookup(hist, totals, KEY)
        .groupBy(*KEY)
        .agg(F.round(F.coalesce(F.sum(gap), F.lit(0.0)) / 2, 6).alias("drift_distance"))
        .withColumn("drift_detected", F.col("drift_distance") > vocab.DRIFT_DISTANCE)
    )


def _bin(value: Column, points: Sequence[float], first: int = 0) -> Column:
    """How many of the ascending cut points lie below ``value``, by halving; null counts as below all."""
    if not points:
        return F.lit(first).cast("long")
    half = len(points) // 2
    above = _bin(value, points[half + 1 :], first + half + 1)
    return F.when(value > F.lit(float(points[half])), above).otherwise(_bin(value, points[:half], first))


DRIFT = "run_id string, time_column string, column string, method string, drift_distance double, drift_detected boolean"


def all_drift(df: DataFrame, run_id: str, times: Sequence[str], levels: Sequence[str], numbers: Sequence[str], bins: int = 64) -> DataFrame:
    """Distance between the early and the late half of every time column, for every other column.

    ``levels`` are compared by the shares of their values (total variation), ``numbers`` by their distributions
    (the largest gap between the two, at ``bins`` cut points that a mergeable quantile sketch gives). The
    halves split each time's range at its midpoint; rows without that time take no part, nor do missing
    cells of numbers. One pass finds midpoints and cut points; one expansion counts (column, digest of a
    value or its bin) for the halves of all times at once, so the shuffled rows are as wide for a long text
    as for a digit. ``times`` are dates or timestamps.
    """
    spark = df.sparkSession
    if not times or not (levels or numbers):
        return spark.createDataFrame([], DRIFT)
    micros = {t: F.unix_micros(F.col(f"`{t}`").cast("timestamp")) for t in times}
    number = {c: cells.as_double(F.col(f"`{c}`").cast("string")) for c in numbers}
    ranks = F.array(*[F.lit((i + 1) / (bins + 1)) for i in range(bins)])
    # a text is read as a number once per row, and not once per cut point
    parsed = df.select(*[m.alias(f"at_{i}") for i, m in enumerate(micros.values())], *[n.alias(f"number_{j}") for j, n in enumerate(number.values())],
                       *[F.col(f"`{c}`").alias(f"level_{j}") for j, c in enumerate(levels)])
    one = parsed.agg(*[((F.min(f"at_{i}") + F.max(f"at_{i}")) / 2).alias(f"m_{i}") for i in range(len(times))],
                     *[F.percentile_approx(f"number_{j}", ranks, F.lit(10_000)).alias(f"q_{j}") for j in range(len(numbers))]).first()
    late = [F.when(F.col(f"at_{i}").isNotNull(), F.col(f"at_{i}") > F.lit(one[f"m_{i}"])).alias(f"late_{i}") for i in range(len(times))]
    entries = []
    for j, c in enumerate(levels):
        both = F.col(f"level_{j}").isNull(), F.col(f"level_{j}")
        entries.append(F.struct(F.lit(c).alias("column"), F.xxhash64(*both).alias("a"), F.xxhash64(F.lit("second"), *both).alias("b")))
    for j, c in enumerate(number):
        n, points = F.col(f"number_{j}"), sorted(set(one[f"q_{j}"] or []))
        place = _bin(n, points)
        entries.append(F.when(n.isNotNull(), F.struct(F.lit(c).alias("column"), place.alias("a"), F.lit(0).cast("long").alias("b"))))
    rows = parsed.select(*late, F.inline(F.array_compact(F.array(*entries))))
    counted = rows.groupBy("column", "a", "b").agg(*[
        F.struct(F.count_if(~F.col(f"late_{i}")).alias("e"), F.count_if(F.col(f"late_{i}")).alias("l")).alias(f"of_{i}") for i in range(len(times))])
    halves = counted.select("column", "a", "b", F.inline(F.array(*[
        F.struct(F.lit(t).alias("time_column"), F.col(f"of_{i}.e").alias("e"), F.col(f"of_{i}.l").alias("l")) for i, t in enumerate(times)])))
    halves = halves.where(F.col("column") != F.col("time_column"))
    # totals come from the reduced counts; a column has few bins, and values of a column combine before the shuffle
    totals = halves.groupBy("time_column", "column").agg(F.sum("e").alias("all_e"), F.sum("l").alias("all_l"))
    shared = left_join_lookup(halves, totals, ["time_column", "column"]).withColumn("gap", F.col("e") / F.col("all_e") - F.col("l") / F.col("all_l"))
    parts = []
    if levels:
        varied = shared.where(F.col("column").isin(*levels)).groupBy("time_column", "column").agg((F.sum(F.abs("gap")) / 2).alias("distance"))
        parts.append(varied.withColumn("method", F.lit("shares")))
    if numbers:
        upto = Window.partitionBy("time_column", "column").orderBy("a").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per bin
        gaps = shared.where(F.col("column").isin(*numbers)).withColumn("upto", F.abs(F.sum("gap").over(upto)))
        parts.append(gaps.groupBy("time_column", "column").agg(F.max("upto").alias("distance")).withColumn("method", F.lit("ranks")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    distance = F.round(F.coalesce("distance", F.lit(0.0)), 6)
    return out.select(F.lit(run_id).alias("run_id"), "time_column", "column", "method", distance.alias("drift_distance"), (distance > vocab.DRIFT_DISTANCE).alias("drift_detected"))


def glimpses(df: DataFrame, run_id: str | Column, key: str, columns: list[str], n: int = 3, seed: int = 7) -> DataFrame:
    """Head, tail and random panels of n rows each, ranked by key; top-k per run is taken before
    the shuffle, so no task sees more than n rows per run and input partition."""
    row = F.struct(*[F.col(c).cast("string").alias(c) for c in columns])
    base = df.select(_run(run_id).alias("run_id"), F.col(key).alias("row_key"), row.alias("row"))
    draw = F.md5(F.concat(F.col("row_key").cast("string"), F.lit(f"#{seed}")))
    panels = {"head": F.col("row_key").asc(), "tail": F.col("row_key").desc(), "random": draw.asc()}
    parts = None
    for panel, order in panels.items():
        window = Window.partitionBy("run_id").orderBy(order, "row_key")
        part = base.withColumn("panel_rank", F.row_number().over(window)).filter(F.col("panel_rank") <= n)
        part = part.select("run_id", F.lit(panel).alias("panel"), "panel_rank", "row_key", "row.*")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def a2_rows(hist: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """The per-column evidence row with its nested parts."""
    shares = parse_shares(hist) if shares is None else shares
    kinds = candidate_types(shares)
    pieces = [
        kinds.select(*KEY, F.struct(F.col("candidate_type").alias("type"), "confidence").alias("top_candidate"),
                     "confidence"),
        missing_token_maps(hist).withColumnRenamed("token_breakdown", "missing_tokens_observed"),
        top_level_arrays(hist),
        sample_maps(hist),
        shares.select(
            *KEY,
            F.struct((100 * F.col("numeric_share")).alias("parseable_pct")).alias("numeric_profile"),
            F.struct((100 * F.col("datetime_share")).alias("parseable_pct")).alias("datetime_profile"),
            "integral_share", "time_of_day_share", "prose_share",
        ),
        one_hot_like(hist),
    ]
    out = column_stats(hist)
    for piece in pieces:
        out = out.join(piece, KEY, "left")
    return out
