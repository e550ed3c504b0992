"""Constraints between columns that hold on every row, and columns that trace how a table was written.

All pairs ``a <= b`` and all triples ``a + b = c`` of the numeric and time columns are claims at first. Most
are refuted by a few witness rows on the driver, and only what survives is verified on all rows, in one
aggregation per ``CLAIMS_AT_ONCE``:

* the rows fall into patterns of filled columns. Of every pattern some rows are witnesses, so each pair or
  triple that is ever filled together has one; patterns are taken ``PATTERNS_AT_ONCE`` at a time until none
  is left;
* sums are looked up, not tried: on one witness of a pattern the values of the columns are sorted, and each
  pair's sum is sought among them. Other witnesses thin out what was found.

Audit trails: a column that never falls along an order of the rows (``monotone_with_order``), and one
whose greatest value in a repeated key belongs to a single row, so that a latest version exists
(``last_writer``).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesight.operators import keys

#: Claims of one aggregation, patterns of one round, further witnesses, and how far a sum may be off.
CLAIMS_AT_ONCE, PATTERNS_AT_ONCE, SAMPLE, NEAR = 400, 2_000, 400, 1e-9
#: Bits of one word of a pattern.
_WORD = 60


@dataclass(frozen=True)
class Witness:
    """A row's pattern, as bits of its filled columns, and its values by column place."""

    pattern: int
    values: dict[int, float]


def _numbers(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The columns as doubles; times as microseconds."""
    kinds = dict(df.dtypes)
    return [(F.unix_micros(F.col(f"`{c}`").cast("timestamp")) if kinds[c].startswith(("timestamp", "date")) else F.col(f"`{c}`")).cast("double").alias(f"v_{i}")
            for i, c in enumerate(columns)]


def _patterned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values v_i, the words w_j of the row's pattern, and two hashes of the row."""
    rows = df.select(*_numbers(df, columns))
    filled = [F.when(F.col(f"v_{i}").isNotNull() & ~F.isnan(f"v_{i}"), F.lit(1 << i % _WORD)).otherwise(F.lit(0)) for i in range(len(columns))]
    words = [sum(filled[a : a + _WORD][1:], filled[a]).cast("long").alias(f"w_{a // _WORD}") for a in range(0, len(columns), _WORD)]
    values = [x for i in range(len(columns)) for x in (F.col(f"v_{i}").isNull(), F.col(f"v_{i}"))]
    return rows.select("*", *words, F.xxhash64(*values).alias("row"), F.xxhash64(F.lit("second"), *values).alias("second"))


def witnesses(df: DataFrame, columns: Sequence[str], n_rows: int) -> list[list[Witness]]:
    """Witness rows of every pattern of filled columns, in rounds of ``PATTERNS_AT_ONCE`` patterns; two scans a round.

    A pattern gives the rows of its smallest and greatest hashes; about ``SAMPLE`` more rows come by hash.
    """
    if not columns or not n_rows:
        return []
    rows = _patterned(df, columns)
    words = [f"w_{j}" for j in range(-(-len(columns) // _WORD))]
    known, rounds = [], []
    while True:
        waiting = rows
        if known:  # patterns of earlier rounds are counts by now; what is left is matched by their words
            seen = df.sparkSession.createDataFrame(known, ", ".join(f"{w} long" for w in words))
            waiting = rows.join(seen, words, "left_anti")
        picks = waiting.groupBy(*words).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("row", "second")])
        taken = picks.orderBy(F.desc("n"), *words).limit(PATTERNS_AT_ONCE).collect()
        if not taken:
            return rounds
        known += [tuple(r[w] for w in words) for r in taken]
        by_row = {r[k] for r in taken for k in ("min_row", "max_row")}
        by_second = {r[k] for r in taken for k in ("min_second", "max_second")}
        chosen = F.col("row").isin(*by_row) | F.col("second").isin(*by_second)
        if not rounds:
            chosen = chosen | (F.pmod("row", F.lit(max(1, n_rows // SAMPLE))) == 0)
        found = waiting.where(chosen).drop("row", "second").distinct().limit(4 * PATTERNS_AT_ONCE + 4 * SAMPLE).collect()
        rounds.append([Witness(sum(r[w] << _WORD * j for j, w in enumerate(words)), {i: v for i in range(len(columns)) if (v := r[f"v_{i}"]) is not None and v == v}) for r in found])
        if len(taken) < PATTERNS_AT_ONCE:
            return rounds


def orders_left(rows: Sequence[Witness], columns: Sequence[int]) -> list[tuple[int, int]]:
    """Pairs (a, b) of ``columns`` filled together in some witness, of which none has a > b."""
    left = []
    for a in columns:
        for b in columns:
            if a != b:
                both = 1 << a | 1 << b
                held = [w.values[a] <= w.values[b] for w in rows if w.pattern & both == both]
                if held and all(held):
                    left.append((a, b))
    return left


def _sums_of(row: Witness) -> list[tuple[int, int, int]]:
    """Triples (a, b, c), a before b, with a + b = c in one row, by looking sums up among the sorted values."""
    places = sorted(row.values, key=lambda i: row.values[i])
    values = [row.values[i] for i in places]
    out = []
    columns = sorted(row.values)
    for k, a in enumerate(columns):
        for b in columns[k + 1 :]:
            total = row.values[a] + row.values[b]
            at = bisect_left(values, total - NEAR)
            while at < len(values) and values[at] < total + NEAR:
                if places[at] not in (a, b):
                    out.append((a, b, places[at]))
                at += 1
    return out


def sums_left(rows: Sequence[Witness]) -> list[tuple[int, int, int]]:
    """Triples filled together in some witness, with a + b = c in all of these.

    Each pattern is looked up on its row with most different values, so that zeros give few chance hits.
    """
    by_pattern: dict[int, list[Witness]] = {}
    for w in rows:
        by_pattern.setdefault(w.pattern, []).append(w)
    earlier: list[int] = []
    left = []
    for pattern in sorted(by_pattern, key=lambda p: -p.bit_count()):
        best = max(by_pattern[pattern], key=lambda w: len(set(w.values.values())))
        for a, b, c in _sums_of(best):
            bits = 1 << a | 1 << b | 1 << c
            if any(bits & p == bits for p in earlier):
                continue
            if all(abs(w.values[a] + w.values[b] - w.values[c]) < NEAR for w in rows if w.pattern & bits == bits):
                left.append((a, b, c))
        earlier.append(pattern)
    return left


def deterministic_constraints(df: DataFrame, run_id: str, numbers: Sequence[str], times: Sequence[str], n_rows: int) -> DataFrame:
    """Claims that hold on every row on which all their columns are filled: constraint, checked, held_share, deterministic.

    Orders are sought within ``numbers`` and within ``times``, sums within ``numbers``. A claim whose columns
    are never filled together is none.
    """
    columns = [*numbers, *times]
    rounds = witnesses(df, columns, n_rows)
    every = [w for r in rounds for w in r]
    of_number, of_time = range(len(numbers)), range(len(numbers), len(columns))
    orders = [*orders_left(every, of_number), *orders_left(every, of_time)]
    numeric = (1 << len(numbers)) - 1
    sums = sums_left([Witness(w.pattern & numeric, {i: v for i, v in w.values.items() if i < len(numbers)}) for w in every])
    claims = [("order", (columns[a], columns[b])) for a, b in orders] + [("sum", tuple(columns[i] for i in s)) for s in sums]
    out = None
    for a in range(0, len(claims), CLAIMS_AT_ONCE):
        part = claims[a : a + CLAIMS_AT_ONCE]
        held = keys.constraints(df, run_id, [c for kind, c in part if kind == "order"], [c for kind, c in part if kind == "sum"]).where("deterministic")
        out = held if out is None else out.unionByName(held)
    return out if out is not None else df.sparkSession.createDataFrame([], "run_id string, constraint string, checked long, held_share double, deterministic boolean")


def monotone_rows(df: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """Per column: rows checked and rows that fall below an earlier one, where earlier means smaller in ``order``.

    ``order`` and columns are numbers or times; rows without an order, and cells without a value, are left
    out, and rows equal in ``order`` may come in any order. Ranges of the order are looked at apart; one row
    per range carries the greatest values so far over to the next.
    """
    at, *values = _numbers(df, [order, *columns])
    ranged = df.select(at, *values).where("v_0 is not null").repartitionByRange("v_0").withColumn("part", F.spark_partition_id())
    names = [f"v_{i + 1}" for i in range(len(columns))]
    place = F.dense_rank().over(Window.partitionBy("part").orderBy("v_0"))
    inside = Window.partitionBy("part").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("place", place).select("part", *names, *[F.max(v).over(inside).alias(f"before_{v}") for v in names])
    tops = ranged.groupBy("part").agg(*[F.max(v).alias(f"top_{v}") for v in names])
    along = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carried = tops.select("part", *[F.max(f"top_{v}").over(along).alias(f"carried_{v}") for v in names])
    joined = local.join(F.broadcast(carried), "part")  # as many rows as shuffle partitions
    one = joined.agg(*[F.struct(F.count(v).alias("checked"), F.count_if(F.col(v) < F.greatest(f"before_{v}", f"carried_{v}")).alias("fell")).alias(f"of_{v}") for v in names])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"of_{v}.checked").alias("checked"), F.col(f"of_{v}.fell").alias("fell")) for c, v in zip(columns, names)])))


def last_writers(df: DataFrame, entities: Sequence[str], versions: Sequence[str]) -> DataFrame:
    """Per entity and version column: keys with several versioned rows, and those whose greatest version is a single row's.

    Rows combine per key and version first, so a key that holds a third of all rows is as many rows as it
    has versions in a task.
    """
    numbers = [v.alias(f"t_{j}") for j, v in enumerate(_numbers(df, versions))]
    rows = df.select(*[F.col(f"`{e}`").cast("string").alias(f"e_{i}") for i, e in enumerate(entities)], *numbers)
    pairs = F.array(*[F.struct(F.lit(e).alias("entity"), F.lit(t).alias("version"), F.col(f"e_{i}").alias("key"), F.col(f"t_{j}").alias("at"))
                      for i, e in enumerate(entities) for j, t in enumerate(versions) if e != t])
    each = rows.select(F.inline(pairs)).where("key is not null and at is not null")
    counted = each.groupBy("entity", "version", "key", "at").agg(F.count(F.lit(1)).alias("n"))
    keyed = counted.groupBy("entity", "version", "key").agg(F.sum("n").alias("n"), F.max_by("n", "at").alias("last"))
    return keyed.where("n > 1").groupBy("entity", "version").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("last") == 1).alias("single"))


def audit_signals(df: DataFrame, run_id: str, orders: Sequence[str], entities: Sequence[str], times: Sequence[str], versions: Sequence[str],
                  cut: float = 0.99) -> DataFrame:
    """Audit-trail signals that hold on at least ``cut`` of what was checked: run_id, signal, along, column, checked, held_share.

    ``orders`` number the rows, ``entities`` name what is written several times, ``times`` and ``versions``
    are the columns tested for the first and second signal.
    """
    schema = "run_id string, signal string, along string, column string, checked long, held_share double"
    parts = [df.sparkSession.createDataFrame([], schema)]
    share = lambda part: F.round(F.col(part) / F.col("checked"), 6)
    for order in orders:
        columns = [t for t in times if t != order]
        if columns:
            found = monotone_rows(df, order, columns).where("checked > 1").withColumn("kept", F.col("checked") - F.col("fell"))
            parts.append(found.select(F.lit(run_id).alias("run_id"), F.lit("monotone_with_order").alias("signal"), F.lit(order).alias("along"), "column", "checked", share("kept").alias("held_share")))
    if entities and versions:
        found = last_writers(df, entities, versions)
        parts.append(found.select(F.lit(run_id).alias("run_id"), F.lit("last_writer").alias("signal"), F.col("entity").alias("along"), F.col("version").alias("column"), "checked", share("single").alias("held_share")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("held_share") >= cut)
