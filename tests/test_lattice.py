"""Minimal keys and dependencies against a search of every column set."""

import random
from itertools import combinations

import pytest

from tablesight.operators import lattice, profile


def groups(rows, columns):
    return len({tuple(r[c] for c in columns) for r in rows})


def every_key(rows, width, largest=4):
    found = []
    for size in range(1, largest + 1):
        for s in combinations(range(width), size):
            if not any(set(k) <= set(s) for k in found) and groups(rows, s) == len(rows):
                found.append(s)
    return found


def every_dependency(rows, width, largest=2):
    keys, found, single = every_key(rows, width, largest), [], {}
    wide = [c for c in range(width) if groups(rows, [c]) > 1]
    for size in range(1, largest + 1):
        for x in combinations(wide, size):
            if any(set(k) <= set(x) for k in keys) or any(single.get((a, b)) for a in x for b in x if a != b):
                continue
            for y in wide:
                if y not in x and groups(rows, x) == groups(rows, [*x, y]) and not any(single.get((a, y)) for a in x):
                    found.append((x, y))
        if size == 1:
            single = {(x[0], y): True for x, y in found}
    return sorted(found)


def search(spark, rows, width):
    names = [f"c{i:02d}" for i in range(width)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    levels, n = lattice.level_counts(profile.cell_histogram(df, "r"))
    known = lattice.sampled_witnesses(df, names, levels, n)
    keys = lattice.minimal_keys(df, names, levels, n, known)
    found = lattice.functional_dependencies(df, names, levels, n, keys, known)
    number = {name: i for i, name in enumerate(names)}
    return sorted(tuple(number[c] for c in k) for k in keys), sorted((tuple(number[c] for c in x), number[y]) for x, y, _ in found)


@pytest.mark.parametrize("seed", range(6))
def test_small_random_tables(spark, seed):
    rng = random.Random(seed)
    width, n = rng.randint(3, 6), rng.choice([1, 12, 60])
    rows = [tuple(rng.choice([None, *"abcdef"[: 1 + i]]) if i else rng.choice("pqrst") for i in range(width)) for _ in range(n)]
    rows = [(*r[:-1], f"{r[0]}{r[1]}") for r in rows] if seed % 2 else list(dict.fromkeys(rows))
    keys, found = search(spark, rows, width)
    assert keys == sorted(every_key(rows, width))
    assert found == every_dependency(rows, width)


def test_four_parts_among_forty_columns(spark, monkeypatch):
    monkeypatch.setattr(lattice, "COPIES", 10)
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        parts = (None if i % 5 == 0 else f"a{i % 5}", f"b{i // 5 % 6}", f"c{i // 30 % 8}", f"d{i // 240}")
        rest = [str(rng.randrange(2 + c % 3)) for c in range(34)]
        rows.append((*parts, *rest, str(i // 3), str(i % 3)))
    keys, found = search(spark, rows, 40)
    assert (0, 1, 2, 3) in keys and (38, 39) in keys
    assert keys == sorted(every_key_by_bits(rows, 40))
    assert ((38,), 3) in found


def every_key_by_bits(rows, width):
    """As ``every_key``, with each column's values as numbers so that wide tables take little."""
    import numpy as np

    codes = [np.unique([str(r[c]) for r in rows], return_inverse=True)[1] for c in range(width)]
    found = []

    def unique(columns):
        mixed = np.zeros(len(rows), np.int64)
        for c in columns:
            mixed = mixed * (codes[c].max() + 1) + codes[c]
        return len(np.unique(mixed)) == len(rows)

    for size in range(1, 5):
        for s in combinations(range(width), size):
            if not any(set(k) <= set(s) for k in found):
                product = np.prod([float(codes[c].max() + 1) for c in s])
                if product >= len(rows) and unique(s):
                    found.append(s)
    return found


def test_no_rows_and_equal_rows(spark):
    assert search(spark, [("a", "b")] * 3, 2) == ([], [])
    empty = spark.createDataFrame([], "c00 string, c01 string")
    levels, n = lattice.level_counts(profile.cell_histogram(empty, "r"))
    known = lattice.sampled_witnesses(empty, ["c00", "c01"], {"c00": 0, "c01": 0}, n)
    assert lattice.minimal_keys(empty, ["c00", "c01"], levels, n, known) == []


def test_a_null_part_and_a_hot_value(spark):
    rows = [(x, y) for x in ("x", "y", None) for y in ("p", "q")]
    assert search(spark, rows, 2)[0] == [(0, 1)]
    hot = [("hot" if i < 400 else str(i), str(i % 400), str(i // 2)) for i in range(1200)]
    keys, found = search(spark, hot, 3)
    assert keys == [(0, 1), (1, 2)] and found == every_dependency(hot, 3)
