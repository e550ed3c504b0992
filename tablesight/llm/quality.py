"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Each document is the set of its byte 3-grams, words and word pairs (case and marks kept), hashed into
``BUCKETS``. An indicator is scaled by its class log-count ratio, each document's vector is
brought to length one, and a linear hinge-loss model is fitted by dual coordinate descent. A sigmoid,
fitted on a fifth of the sample left out for that, turns margins into scores from 0 to 1.

The fit reads at most ``SAMPLE`` labelled documents, those with the smallest hash of their doc_id; that
is the only bound. However long they are, each reaches the driver as at most ``BUCKETS`` bits, and is unpacked
only while it is looked at. Scoring reads whole texts and nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SAMPLE = 6_000
THRESHOLD = 0.3
#: Fitting: pseudo-count of the ratios, penalty of the hinge loss, passes of the descent.
SMOOTHING, PENALTY, PASSES = 1.0, 1.0, 12


class Features:
    """The indicator buckets of a text, all n-grams hashed at once.

    Byte 3-grams, words, pairs of adjacent words, and three n-gram rates in ten steps each:
    words equal to the one before, words seen before, bits of the word count.
    """

    STEPS = 64

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.shift = buckets, np.uint64(64 - (buckets - 1).bit_length())
        self.powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))

    def _bucket(self, codes: np.ndarray, kind: int) -> np.ndarray:
        mixed = (codes + np.uint64(kind)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)) >> self.shift

    def __call__(self, text: str | None) -> np.ndarray:
        data = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass") + b" ", np.uint8)
        blank = data <= 32
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        if not len(starts):
            return np.empty(0, np.int32)
        seen = np.zeros(self.buckets, bool)
        wide = data.astype(np.uint64)
        pairs = wide[:-1] | wide[1:] << np.uint64(8)
        seen[self._bucket(pairs[:-1] | wide[2:] << np.uint64(16), 3)] = True
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        lengths = ends - starts
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        letters = wide[~blank] * self.powers[place % 64] + np.uint64(1)
        words = np.add.reduceat(letters, np.cumsum(lengths) - lengths)
        seen[self._bucket(words, 1)] = True
        seen[self._bucket(words[:-1] * np.uint64(31) + words[1:], 2)] = True
        again, distinct = (words[1:] == words[:-1]).mean() if len(words) > 1 else 0.0, len(np.unique(words)) / len(words)
        seen[: self.STEPS] = False
        seen[[int(9.99 * again), 10 + int(9.99 * distinct), 20 + min(len(words).bit_length(), 40)]] = True
        return np.flatnonzero(seen).astype(np.int32)


def packed(found: np.ndarray, buckets: int = BUCKETS) -> bytes:
    """Sorted buckets (65,536 at most) as two bytes each, or as ``buckets`` bits where that is not more."""
    if 2 * len(found) < buckets // 8:
        return found.astype(np.uint16).tobytes()
    bits = np.zeros(buckets, bool)
    bits[found] = True
    return np.packbits(bits).tobytes()


class PackedRows(Sequence):
    """Feature rows held packed; each is unpacked when it is taken."""

    def __init__(self, rows: Sequence[bytes], buckets: int = BUCKETS):
        self.rows, self.buckets = rows, buckets

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        raw = self.rows[i]
        if len(raw) < self.buckets // 8:
            return np.frombuffer(raw, np.uint16).astype(np.int32)
        return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))).astype(np.int32)

    def part(self, index: np.ndarray) -> PackedRows:
        return PackedRows([self.rows[i] for i in index], self.buckets)


@dataclass
class Model:
    """Per bucket the weight times ratio, and the squared ratio; the bias; slope and shift of the sigmoid."""

    push: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        size = np.sqrt(self.square[found].sum()) or 1.0
        return float(self.push[found].sum() / size + self.bias)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -40, 40))))


def log_ratios(rows: Sequence[np.ndarray], good: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Class log-count ratios of the indicators, with a pseudo-count."""
    counts = np.full((2, buckets), SMOOTHING)
    for found, label in zip(rows, good, strict=True):
        counts[int(label), found] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def hinge_weights(rows: Sequence[np.ndarray], scale: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model, by dual coordinate descent over unit vectors."""
    weights, bias, order = np.zeros(len(scale)), 0.0, np.random.default_rng(0)
    sizes = np.array([np.sqrt((scale[f] ** 2).sum()) or 1.0 for f in rows])
    norms = np.array([((scale[f] / size) ** 2).sum() + 1 for f, size in zip(rows, sizes, strict=True)])  # the bias is a constant feature
    signs, alpha = np.where(good, 1.0, -1.0), np.zeros(len(rows))
    cost = PENALTY * np.where(good, len(rows) / max(2 * good.sum(), 1), len(rows) / max(2 * (~good).sum(), 1))
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            found = rows[i]
            values = scale[found] / sizes[i]
            gradient = signs[i] * (weights[found] @ values + bias) - 1
            step = np.clip(alpha[i] - gradient / norms[i], 0, cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                weights[found] += step * signs[i] * values
                bias += step * signs[i]
    return weights, bias


def sigmoid(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, by Newton steps on softened targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.stack([margins, np.ones_like(margins)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -40, 40)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, x @ (p - target) + 1e-3 * theta)
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit(rows: Sequence[np.ndarray], good: np.ndarray, buckets: int = BUCKETS) -> Model:
    """Fit on feature rows and their boolean labels; with one class or none every score is that class's share, or 0.5."""
    zero = np.zeros(buckets, np.float32)
    if not len(rows) or good.all() or not good.any():
        share = (good.sum() + 0.5) / (len(good) + 1) if len(rows) else 0.5
        return Model(zero, zero, 0.0, 1.0, float(np.log(share / (1 - share))))

    def trained(part: np.ndarray) -> Model:
        own, labels = rows.part(part) if isinstance(rows, PackedRows) else [rows[i] for i in part], good[part]
        scale = log_ratios(own, labels, buckets)
        weights, bias = hinge_weights(own, scale, labels)
        return Model((weights * scale).astype(np.float32), (scale**2).astype(np.float32), bias, 1.0, 0.0)

    index = np.arange(len(rows))
    out = index[index % 5 == 0]
    if len(set(good[out])) == 2 and len(set(good[index % 5 != 0])) == 2:
        trial = trained(index[index % 5 != 0])
        slope, shift = sigmoid(np.array([trial.margin(rows[i]) for i in out]), good[out])
    else:
        slope, shift = 2.0, 0.0
    model = trained(index)
    model.slope, model.shift = slope, shift
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on up to ``sample`` documents (doc_id, text) that ``labels`` (doc_id, quality 0 or 1) covers.

    Documents whose crc32 of the doc_id as text is divisible by 5 are never learned from. Null ids and
    null labels are left out; of repeated labels the lower counts, of repeated documents the smallest text.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            rows = [packed(features(t.as_py())) for t in batch.column(0)]
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(rows, pa.binary())], ["quality", "doc_id", "found"])

    texts = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    ones = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    known = ones.join(F.broadcast(chosen), "doc_id").select("text", F.col("quality").cast("int"), F.col("doc_id").cast("long"))
    rows = known.mapInArrow(found, "quality int, doc_id long, found binary").toPandas()  # at most ``sample`` rows of ``BUCKETS`` bits
    rows = rows.sort_values(["doc_id", "found"])
    return fit(PackedRows(rows["found"].tolist()), rows["quality"].to_numpy() == 1)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id is not held out, and has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column, from 0 to 1; a null or empty text has no indicators and gets the bias."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features(len(model.push))
        for texts in batches:
            yield pd.Series([model.score(features(t if isinstance(t, str) else None)) for t in texts], dtype="float64")

    return score(text.cast("string"))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 from ``threshold``). Other columns are not read."""
    model = learn(docs, labels, sample)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns as they are."""
    return docs.where(score_column(learn(docs, labels, sample), F.col("text")) >= threshold)
