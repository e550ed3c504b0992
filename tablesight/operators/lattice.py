"""Minimal keys and functional dependencies over all columns of a table, nulls included.

Column sets are searched level by level, and most are ruled out before any pass over all rows:

* **counts.** A set whose distinct counts multiply to less than the rows is no key, and a set that holds
  a key is not minimal;
* **witnesses.** Two rows that agree on a set of columns refute every key inside that set, and every
  dependency from columns inside it to one outside. Pairs come from a bounded sample of rows that share a
  value of some column. A sample can only rule out: what survives is checked on all rows;
* **whole groups of some hashes.** While very many sets are open, or there are many rows, passes look at those
  groups of each set whose hash falls in a fraction of the range. Every group is complete, so a repeat there is a
  fact, and only sets without one there meet all rows;
* **repeats found.** A set that fails its check on all rows yields rows of one repeated group, which become
  witnesses against the wider sets still to come.

Groups are known by a 64-bit hash and 32 bits of an independent one; on all rows, the dependents of a side
by one 64-bit hash. Null is a value here, as it is in grouping. Only column
sets, counts and agreement patterns reach the driver, at most ``PATTERNS`` of the last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Copies of a row that one pass makes on average, and column sets that it looks at.
COPIES, SETS_AT_ONCE = 40, 400
#: Largest divisors of the hashes that a pass over some of them may use, the first pass first, and rows it is to see at least.
SHARES, ROWS_SEEN = (64, 8), 50_000
#: Sampled groups per column, rows per group, and agreement patterns kept.
GROUPS, ROWS, PATTERNS = 32, 8, 20_000


def _print(column: str, salt: str = "") -> Column:
    """64-bit hash of a cell; null differs from every value."""
    c = F.col(f"`{column}`")
    return F.xxhash64(*([F.lit(salt)] if salt else []), c.isNull(), c)


@dataclass
class Witnesses:
    """Sets of columns, as bits in the order of ``columns``, on which some two rows agree and on no others."""

    columns: Sequence[str]
    patterns: set[int] = field(default_factory=set)
    widest: list[int] = field(default_factory=list)

    def bits(self, columns: Sequence[str]) -> int:
        return sum(1 << self.columns.index(c) for c in columns)

    def add(self, patterns: Sequence[int]) -> None:
        """Take in patterns; ``widest`` keeps those that lie in no other, the largest first."""
        fresh = set(patterns) - self.patterns
        self.patterns |= fresh
        kept: list[int] = []
        for p in sorted([*self.widest, *fresh], key=lambda p: -p.bit_count()):
            if not any(p & k == p for k in kept):
                kept.append(p)
        self.widest = kept

    def refute_key(self, columns: int) -> bool:
        return any(columns & p == columns for p in self.widest)

    def determined(self, columns: int) -> int:
        """The columns that may depend on ``columns``: those on which all rows known to agree there agree too."""
        left = (1 << len(self.columns)) - 1
        for p in self.patterns:
            if columns & p == columns:
                left &= p
        return left


def _patterns(rows: DataFrame, columns: Sequence[str]) -> list[int]:
    """Agreement of pairs of rows in a group (``probe``, ``at``); ``rows`` has a hash p_i per column and ``row``.

    ``ROWS`` rows of a group are compared, those of smallest hash; the rest is cut before the shuffle.
    """
    order = Window.partitionBy("probe", "at").orderBy("row")
    few = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ROWS)
    both = few.alias("l").join(few.alias("r"), ["probe", "at"]).where("l.rank < r.rank")
    same = F.concat(*[F.when(F.col(f"l.p_{i}") == F.col(f"r.p_{i}"), "1").otherwise("0") for i in range(len(columns))])
    found = both.select(same.alias("same")).distinct().limit(PATTERNS).collect()
    return [int(r["same"][::-1], 2) for r in found]


def _prints(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    prints = df.select(*[_print(c).alias(f"p_{i}") for i, c in enumerate(columns)])
    return prints.withColumn("row", F.xxhash64(F.lit("row"), *[F.col(f"p_{i}") for i in range(len(columns))]))


def sampled_witnesses(df: DataFrame, columns: Sequence[str], levels: dict[str, int], n_rows: int) -> Witnesses:
    """Agreement of sampled pairs of rows that share a value of at least one column; one scan.

    About ``GROUPS`` values of each column are taken by hash, and ``ROWS`` rows of each. ``levels`` has the
    distinct counts, null as a value.
    """
    known = Witnesses(columns)
    shared = [i for i, c in enumerate(columns) if levels[c] < n_rows]
    if not shared or n_rows < 2:
        return known
    entries = []
    for i in shared:
        count = max(1, levels[columns[i]])
        near = (F.pmod(F.col(f"p_{i}"), F.lit(max(1, count // GROUPS))) == 0) & (F.pmod("row", F.lit(max(1, n_rows // (count * ROWS)))) == 0)
        entries.append(F.when(near, F.struct(F.lit(i).alias("probe"), F.col(f"p_{i}").alias("at"))))
    rows = _prints(df, columns).select("*", F.inline(F.array_compact(F.array(*entries))))
    known.add(_patterns(rows, columns))
    return known


def _shares(n_rows: int) -> list[int]:
    """Divisors of the hashes for the passes before the one over all rows; none where these would see few rows."""
    return [s for s in SHARES if s * ROWS_SEEN <= n_rows]


def _entry(place: dict[str, int], number: int, columns: Sequence[str], *more: Column) -> Column:
    """What a row says of its group in a set: probe, the set's number; at and also, the group's hashes; ``more``."""
    second = F.xxhash64(*[F.col(f"q_{place[c]}") for c in columns])
    return F.struct(F.lit(number).alias("probe"), F.xxhash64(*[F.col(f"p_{place[c]}") for c in columns]).alias("at"),
                    F.shiftright(second, 32).cast("int").alias("also"), *more)


def _groups(df: DataFrame, sets: Sequence[Sequence[str]], modulus: int, others: Sequence[str] = ()) -> DataFrame:
    """A row per group of each set (probe: its number; at, also: its hashes), with n and whether each of ``others`` varies.

    With a modulus above 1, only groups whose hash it divides; those are whole.
    """
    used = sorted({c for s in sets for c in s} | set(others))
    place = {c: i for i, c in enumerate(used)}
    base = df.select(*[_print(c).alias(f"p_{i}") for c, i in place.items()], *[_print(c, "second").alias(f"q_{i}") for c, i in place.items()])
    entries = F.array(*[_entry(place, k, s) for k, s in enumerate(sets)])
    if modulus > 1:
        entries = F.filter(entries, lambda e: F.pmod(e["at"], F.lit(modulus)) == 0)
    kept = [f"{x}_{place[c]}" for c in others for x in "pq"]
    varies = [((F.min(f"p_{place[c]}") != F.max(f"p_{place[c]}")) | (F.min(f"q_{place[c]}") != F.max(f"q_{place[c]}"))).alias(f"v_{j}") for j, c in enumerate(others)]
    return base.select(*kept, F.inline(entries)).groupBy("probe", "at", "also").agg(F.count(F.lit(1)).alias("n"), *varies)


def _unique(df: DataFrame, sets: Sequence[tuple[str, ...]], modulus: int) -> tuple[list[tuple[str, ...]], dict[int, int]]:
    """Those of ``sets`` without a repeat in the groups looked at, and a repeated group's hash for each of the others."""
    repeats = _groups(df, sets, modulus).where("n > 1").groupBy("probe").agg(F.min("at").alias("at")).collect()
    failed = {r["probe"]: r["at"] for r in repeats}
    return [s for k, s in enumerate(sets) if k not in failed], failed


def _learn(df: DataFrame, known: Witnesses, sets: Sequence[tuple[str, ...]], failed: dict[int, int]) -> None:
    """Take rows of one repeated group of every failed set as witnesses; one scan."""
    place = {c: i for i, c in enumerate(known.columns)}
    hits = [(k, at, F.xxhash64(*[F.col(f"p_{place[c]}") for c in sets[k]])) for k, at in failed.items()]
    entries = F.array_compact(F.array(*[F.when(h == at, F.struct(F.lit(k).alias("probe"), h.alias("at"))) for k, at, h in hits]))
    known.add(_patterns(_prints(df, known.columns).select("*", F.inline(entries)), known.columns))


def _open_sets(columns: Sequence[str], size: int, levels: dict[str, int], n_rows: int, keys: Sequence[tuple[str, ...]], known: Witnesses) -> Iterator[tuple[str, ...]]:
    """Sets of ``size`` columns that may be minimal keys; parts that cannot reach the number of rows are not built up."""
    held = [known.bits(k) for k in keys]
    best = sorted((levels[c] for c in columns), reverse=True)

    def grow(prefix: tuple[str, ...], start: int, product: int) -> Iterator[tuple[str, ...]]:
        missing = size - len(prefix)
        if product * math.prod(best[:missing]) < n_rows:
            return
        if not missing:
            bits = known.bits(prefix)
            if not known.refute_key(bits) and not any(bits & k == k for k in held):
                yield prefix
            return
        for i in range(start, len(columns)):
            yield from grow((*prefix, columns[i]), i + 1, product * levels[columns[i]])

    return grow((), 0, 1)


def minimal_keys(df: DataFrame, columns: Sequence[str], levels: dict[str, int], n_rows: int, known: Witnesses, largest: int = 4,
                 narrowest: bool = False) -> list[tuple[str, ...]]:
    """All minimal column sets of up to ``largest`` of ``columns`` that identify every row of ``df``.

    ``levels`` has the distinct counts with null as a value; ``known`` is added to. With ``narrowest``, wider
    sets are sought only where no narrower one is a key. A table without rows has no keys.
    """
    if not n_rows:
        return []
    keys: list[tuple[str, ...]] = [(c,) for c in columns if levels[c] >= n_rows]
    open_ = [c for c in columns if levels[c] < n_rows]
    for size in range(2, largest + 1):
        if keys and narrowest:
            break
        waiting = list(_open_sets(open_, size, levels, n_rows, keys, known))
        thin = True  # passes over some hashes still rule sets out
        shares = _shares(n_rows)
        while waiting:
            take = waiting[:SETS_AT_ONCE] if thin else waiting[:COPIES]
            modulus = max([-(-len(take) // COPIES), *shares])
            passed, failed = _unique(df, take, modulus)
            if modulus == 1:
                keys += passed
            if failed:
                _learn(df, known, take, dict(list(failed.items())[:COPIES]))
            thin = modulus == 1 or len(failed) * 2 >= len(take)
            if not thin and shares:
                thin, shares = len(shares) > 1, shares[1:]
            elif modulus == 1 and len(waiting) > COPIES:
                shares = _shares(n_rows)
            gone = {take[k] for k in failed} | (set(passed) if modulus == 1 else set())
            waiting = [s for s in waiting if s not in gone and not known.refute_key(known.bits(s))]
    return sorted(keys, key=lambda k: (len(k), k))


def _holding(df: DataFrame, claims: dict[tuple[str, ...], list[str]], modulus: int) -> dict[tuple[str, ...], list[str]]:
    """Of ``claims`` (left side: dependents) those without a group that varies."""
    sets, others = list(claims), sorted({y for ys in claims.values() for y in ys})
    groups = _groups(df, sets, modulus, others)
    rows = groups.groupBy("probe").agg(*[F.max(f"v_{j}").alias(f"v_{j}") for j in range(len(others))]).collect()
    varied = {sets[r["probe"]]: {y for j, y in enumerate(others) if r[f"v_{j}"]} for r in rows}
    left = {x: [y for y in ys if y not in varied.get(x, ())] for x, ys in claims.items()}
    return {x: ys for x, ys in left.items() if ys}


def _counted(df: DataFrame, claims: Sequence[tuple[tuple[str, ...], list[str]]]) -> list[tuple[int, bool]]:
    """For each of ``claims`` the number of groups of its left side, and whether its dependents, as one value, vary in some."""
    used = sorted({c for x, ys in claims for c in (*x, *ys)})
    place = {c: i for i, c in enumerate(used)}
    base = df.select(*[_print(c).alias(f"p_{i}") for c, i in place.items()], *[_print(c, "second").alias(f"q_{i}") for c, i in place.items()])
    entries = F.array(*[_entry(place, k, x, F.xxhash64(*[F.col(f"p_{place[y]}") for y in ys]).alias("y")) for k, (x, ys) in enumerate(claims)])
    groups = base.select(F.inline(entries)).groupBy("probe", "at", "also").agg((F.min("y") != F.max("y")).alias("varies"))
    rows = {r["probe"]: (r["n"], r["varies"]) for r in groups.groupBy("probe").agg(F.count(F.lit(1)).alias("n"), F.max("varies").alias("varies")).collect()}
    return [rows[k] for k in range(len(claims))]


def _held(df: DataFrame, claims: dict[tuple[str, ...], list[str]]) -> dict[tuple[str, ...], tuple[list[str], int]]:
    """``claims`` that hold on all rows, with the number of groups. A side's dependents are judged together, and one by one where they vary."""
    out: dict[tuple[str, ...], tuple[list[str], int]] = {}
    open_ = list(claims.items())
    while open_:
        take, open_ = open_[:COPIES], open_[COPIES:]
        for (x, ys), (groups, varies) in zip(take, _counted(df, take), strict=True):
            if not varies:
                out[x] = ([y for y in claims[x] if y in ys or y in out.get(x, ((),))[0]], groups)
            elif len(ys) > 1:
                open_ += [(x, [y]) for y in ys]
    return out


def _verified(df: DataFrame, claims: dict[tuple[str, ...], list[str]], n_rows: int) -> dict[tuple[str, ...], tuple[list[str], int]]:
    """``claims`` that hold on all rows, with the number of groups of their left side."""
    out: dict[tuple[str, ...], tuple[list[str], int]] = {}
    open_ = list(claims)
    for a in range(0, len(open_), SETS_AT_ONCE):
        part = {x: claims[x] for x in open_[a : a + SETS_AT_ONCE]}
        for share in _shares(n_rows) or SHARES[-1:]:  # first on some of the groups, fewer if there are many sets
            if len(part) > 1:
                part = _holding(df, part, max(share, -(-len(part) // COPIES)))
        out |= _held(df, part)
    return out


def functional_dependencies(df: DataFrame, columns: Sequence[str], levels: dict[str, int], n_rows: int, keys: Sequence[tuple[str, ...]], known: Witnesses,
                            largest: int = 2) -> list[tuple[tuple[str, ...], str, int]]:
    """All minimal dependencies that hold on every row, from up to ``largest`` of ``columns`` to one of them.

    Rows are (left side, dependent, number of groups). Left sides that hold a key determine everything and
    are left out, as are dependents of one level and left sides of which one part determines the other.
    """
    if not n_rows:
        return []
    held_keys = [known.bits(k) for k in keys]
    constant = known.bits([c for c in columns if levels[c] <= 1])
    implied: dict[int, int] = {}
    found: list[tuple[tuple[str, ...], str, int]] = []
    for size in range(1, largest + 1):
        claims = {}
        for x in combinations([c for c in columns if levels[c] > 1], size):
            bits = known.bits(x)
            if any(bits & k == k for k in held_keys):
                continue
            parts = [implied.get(known.bits(p), 0) for k in range(1, size) for p in combinations(x, k)]
            told = constant | bits
            for p in parts:
                told |= p
            if any(p & bits for p in parts):
                continue
            may = known.determined(bits) & ~told
            ys = [c for c in columns if may >> known.columns.index(c) & 1]
            if ys:
                claims[x] = ys
        for x, (ys, groups) in _verified(df, claims, n_rows).items():
            implied[known.bits(x)] = implied.get(known.bits(x), 0) | known.bits(ys)
            found += [(x, y, groups) for y in ys]
    return sorted(found)


def level_counts(hist: DataFrame) -> tuple[dict[str, int], int]:
    """Distinct counts of each column with null and missing texts as values, and the number of rows, from the cell histogram."""
    rows = hist.groupBy("column").agg(F.count(F.lit(1)).alias("levels"), F.sum("n").alias("n")).collect()
    return {r["column"]: r["levels"] for r in rows}, max((r["n"] for r in rows), default=0)


def key_rows(df: DataFrame, run_id: str, keys: Sequence[tuple[str, ...]]) -> DataFrame:
    """``keys`` as rows: run_id, keys, n_parts."""
    rows = [(run_id, ",".join(k), len(k)) for k in keys]
    return df.sparkSession.createDataFrame(rows, "run_id string, keys string, n_parts int")


def dependency_rows(df: DataFrame, run_id: str, found: Sequence[tuple[tuple[str, ...], str, int]]) -> DataFrame:
    """``found`` as rows: run_id, determinant, dependent, n_parts, n_groups."""
    rows = [(run_id, ",".join(x), y, len(x), groups) for x, y, groups in found]
    return df.sparkSession.createDataFrame(rows, "run_id string, determinant string, dependent string, n_parts int, n_groups long")
