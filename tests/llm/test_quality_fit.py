"""The classifier's fit: its memory, and its optimum against a plain solver."""

import numpy as np
import pytest

from tablesight.llm import quality


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 60_000])
def test_packed_rows_come_back(n):
    found = np.sort(np.random.default_rng(n).choice(quality.BUCKETS, n, replace=False)).astype(np.int32)
    raw = quality.packed(found)
    assert len(raw) <= quality.BUCKETS // 8
    assert np.array_equal(quality.PackedRows([raw])[0], found)


def drawn(n=80, buckets=256):
    draw = np.random.default_rng(1)
    good = draw.random(n) < 0.4
    rows = [np.flatnonzero(draw.random(buckets) < (0.06 + 0.1 * ((np.arange(buckets) % 2) == g))).astype(np.int32) for g in good]
    return rows, good, buckets


def test_packed_and_plain_rows_give_one_model():
    rows, good, buckets = drawn()
    plain = quality.fit(rows, good, buckets)
    tight = quality.fit(quality.PackedRows([quality.packed(r, buckets) for r in rows], buckets), good, buckets)
    assert np.array_equal(plain.push, tight.push) and (plain.bias, plain.slope, plain.shift) == (tight.bias, tight.slope, tight.shift)


def test_descent_reaches_the_optimum(monkeypatch):
    """Dual and primal values of the hinge-loss problem meet, which they do at the optimum alone."""
    monkeypatch.setattr(quality, "PASSES", 400)
    rows, good, buckets = drawn()
    scale = quality.log_ratios(rows, good, buckets)
    weights, bias = quality.hinge_weights(rows, scale, good)
    x = np.zeros((len(rows), buckets + 1))
    for i, f in enumerate(rows):
        x[i, f] = scale[f] / np.sqrt((scale[f] ** 2).sum())
    x[:, -1] = 1
    signs = np.where(good, 1.0, -1.0)
    cost = quality.PENALTY * np.where(good, len(rows) / (2 * good.sum()), len(rows) / (2 * (~good).sum()))

    def loss(w):
        return w @ w / 2 + cost @ np.maximum(0, 1 - signs * (x @ w))

    best, alpha = np.append(weights, bias), np.zeros(len(rows))
    gram = (x * signs[:, None]) @ (x * signs[:, None]).T
    rate = 1 / np.linalg.norm(gram, 2)
    for _ in range(200_000):  # projected gradient ascent on the dual
        alpha, last = np.clip(alpha + rate * (1 - gram @ alpha), 0, cost), alpha
        if np.abs(alpha - last).max() < 1e-10:
            break
    dual = alpha.sum() - alpha @ gram @ alpha / 2
    assert loss(best) == pytest.approx(dual, rel=1e-3)
