"""Runs against a search of every period, and the block convolution against plain sums."""

import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesight.llm import runs


def every_run(words):
    """All runs by trying every period from the shortest."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q) and not any(s <= i and i + length <= s + n and q % p == 0 for s, n, p in found):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    words = []
    for _ in range(rng.randint(0, 5)):
        letters = rng.choice([1, 2, 3, 30])
        base = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 9, 17, 40, 130]))]
        size = rng.randint(0, 90) + 3 * len(base) * rng.randint(0, 1)
        words += (base * (size // len(base) + 1))[:size] + [rng.randrange(letters) for _ in range(rng.randint(0, 4))]
    return words


def test_runs_of_random_repetitive_words():
    rng = random.Random(5)
    for _ in range(300):
        docs = [repetitive(rng) for _ in range(rng.randint(1, 4))]
        bounds = np.cumsum([0, *map(len, docs)])
        got = runs.find_runs(np.array([w for d in docs for w in d], np.int32), bounds)
        assert got == sorted(((s + int(a), n, p) for d, a in zip(docs, bounds) for s, n, p in every_run(d)), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("size", [8, 64, 512, 16_384])
def test_squared_differences_are_exact(size):
    rng = np.random.default_rng(size)
    top = int(((runs.PRIME - 1) / size) ** 0.5)
    block, window = rng.integers(0, top, (2, size)).astype(float), rng.integers(0, top, (2, 2 * size)).astype(float)
    got = runs.squared_differences(block, window)
    for lag in (0, 1, size // 2, size):
        assert (got[:, lag] == ((block - window[:, lag : lag + size]) ** 2).sum(axis=1)).all()


def test_blocks_of_the_last_size_reach_longer_periods(monkeypatch):
    monkeypatch.setattr(runs, "LAST_BLOCK", 16)
    base = np.random.default_rng(1).integers(0, 1000, 300)
    words = np.concatenate([[1001, 1002], np.tile(base, 4)[:1000], [1003]]).astype(np.int32)
    assert runs.find_runs(words, np.array([0, len(words)])) == [(2, 1000, 300)]


def test_one_word_and_long_texts_take_little():
    assert runs.find_runs(np.zeros(200_000, np.int32), np.array([0, 200_000])) == [(0, 200_000, 1)]


def expected(doc, text):
    """The contract of the query, written out."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else None
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = every_run(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda b: sha256(b).hexdigest()
    return (
        doc, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def digests(docs):
    planted = docs.select("doc_id", runs.planted_text(F.col("text"), F.col("doc_id")).alias("text"))
    key = lambda r: [(x is None, x) for x in r]
    return sorted((tuple(r) for r in runs.run_digests(runs.periodic_runs(planted)).collect()), key=key)


def test_query_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " \n".join(f"wä{w}" for w in repetitive(rng))) for i in range(200)]
    got = digests(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == sorted(expected(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 20


def test_edge_rows(edge, nothing):
    key = lambda r: [(x is None, x) for x in r]
    rows = [(r["doc_id"], r["text"]) for r in edge.collect() if r["doc_id"] != 4]
    assert digests(edge.where("doc_id is null or doc_id <> 4")) == sorted((expected(*r) for r in rows), key=key)
    long = digests(edge.where("doc_id = 4"))[0]
    assert (long[1], long[2], long[3], long[4]) == (1, 0, 60_000, 3)
    assert digests(nothing) == []
