"""Constraints and audit trails against a trial of every pair and triple, on wide and gappy tables."""

import random

import pytest

from tablesight.operators import claims


def every_claim(rows, names):
    out = set()
    n = len(names)
    both = lambda *cs: [r for r in rows if all(r[c] is not None for c in cs)]
    for a in range(n):
        for b in range(n):
            if a != b and both(a, b) and all(r[a] <= r[b] for r in both(a, b)):
                out.add(f"{names[a]} <= {names[b]}")
    for a in range(n):
        for b in range(a + 1, n):
            for c in range(n):
                if c not in (a, b) and both(a, b, c) and all(abs(r[a] + r[b] - r[c]) < 1e-9 for r in both(a, b, c)):
                    out.add(f"{names[a]} + {names[b]} = {names[c]}")
    return out


@pytest.mark.parametrize("at_once", [3, claims.PATTERNS_AT_ONCE])
def test_claims_of_gappy_tables(spark, monkeypatch, at_once):
    monkeypatch.setattr(claims, "PATTERNS_AT_ONCE", at_once)
    rng = random.Random(at_once)
    names = list("abcdefg")
    rows = []
    for _ in range(120):
        a, b, c = rng.randrange(5), rng.randrange(50), rng.randrange(9)
        row = [float(x) for x in (a, b, a + b, c, a + c, 0, b + 60)]
        rows.append(tuple(None if rng.random() < 0.3 else x for x in row))
    df = spark.createDataFrame(rows, ", ".join(f"{x} double" for x in names))
    got = claims.deterministic_constraints(df, "r", names, [], len(rows)).collect()
    assert {r["constraint"] for r in got} == every_claim(rows, names)
    assert all(r["checked"] > 0 and r["deterministic"] for r in got)


def test_two_hundred_columns_take_five_scans(spark, tmp_path):
    rng = random.Random(1)
    rows = [[float(rng.randrange(10**6)) for _ in range(198)] for _ in range(300)]
    rows = [(*r, r[0] + r[1], r[2] + r[3]) for r in rows]
    names = [f"c{i}" for i in range(200)]
    spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    found = {r["constraint"] for r in claims.deterministic_constraints(df, "r", names, [], 300).collect()}
    assert {"c0 + c1 = c198", "c2 + c3 = c199"} <= found and not any("+" in x for x in found - {"c0 + c1 = c198", "c2 + c3 = c199"})
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before <= 10  # a scan is two jobs here at most


def test_no_rows_and_no_columns(spark):
    none = spark.createDataFrame([], "a double, b double")
    assert claims.deterministic_constraints(none, "r", ["a", "b"], [], 0).count() == 0
    assert claims.deterministic_constraints(none, "r", [], [], 0).count() == 0


def test_orders_that_tie_or_fall(spark):
    rows = [(1, 5, 1), (1, 3, 2), (2, 5, None), (3, 4, 3), (4, 9, 2), (None, 0, 0)]
    df = spark.createDataFrame(rows, "at long, x long, y long")
    got = {r["column"]: (r["checked"], r["fell"]) for r in claims.monotone_rows(df, "at", ["x", "y"]).collect()}
    assert got == {"x": (5, 1), "y": (4, 1)}


def test_the_last_writer_of_a_hot_key(spark):
    rows = [("hot", i // 2 if i < 998 else i) for i in range(1000)] + [("twice", 7), ("twice", 7), ("once", 1)]
    got = claims.last_writers(spark.createDataFrame(rows, "k string, at long"), ["k"], ["at"]).collect()
    assert [(r["checked"], r["single"]) for r in got] == [(2, 1)]
