import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesight.llm import language, quality


@pytest.fixture
def taken(monkeypatch):
    """The sizes of all frames that reach the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    sizes, plain = [], DataFrame.toPandas

    def counted(self):
        out = plain(self)
        sizes.append((len(out), int(out["text"].str.len().sum()) if "text" in out else 0))
        return out

    monkeypatch.setattr(DataFrame, "toPandas", counted)
    return sizes


def learned_ids(spark, n):
    """Ids that are not held out, in the order of the draw."""
    ids = [i for i in range(1, 5 * n) if zlib.crc32(str(i).encode()) % 5][:n]
    return [r["id"] for r in spark.createDataFrame([(i,) for i in ids], "id long").orderBy(F.xxhash64("id")).collect()]


def test_a_repeated_id_is_one_document_of_its_language(spark, taken):
    first, *others = learned_ids(spark, 20)
    docs = [(first, f"again and again number{'abcdefghij'[i % 10]}", "en") for i in range(300)]
    docs += [(i, f"other words of text {'klmnopqrstuvwxyz'[k % 16] * 5}", "en") for k, i in enumerate(others)]
    raw = language.dictionaries(spark.createDataFrame(docs, "doc_id long, text string, lang string"), sample=5)
    assert raw["en"].count(b"again and again") == 1 and raw["en"].count(b"other words") == 4
    assert max(n for n, _ in taken) <= 5


def test_only_learned_languages_are_ranked_and_long_texts_give_spread_parts(spark, taken, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    ids = learned_ids(spark, 40)
    long = " ".join(["start"] * 4000 + ["middle"] * 4000 + ["end"] * 4000)
    docs = [(i, long if k == 0 else f"short text {'ab'[k % 2]}", "xyz"[min(k // 14, 2)]) for k, i in enumerate(ids)]
    raw = language.dictionaries(spark.createDataFrame(docs, "doc_id long, text string, lang string"), size=5_000)
    assert len(raw) == 2 and all(w in raw["x"] for w in (b"start", b"middle", b"end")) and 4_500 <= len(raw["x"]) <= 5_000
    assert max(c for _, c in taken) <= 2 * 5_000 + 200


def test_shares_fill_the_bound():
    assert language._share(np.array([10, 20, 1000, 2000]), 100) == 35
    assert language._share(np.array([10, 20]), 100) == 20


def test_a_repeated_labelled_id_is_learned_once(spark, taken):
    first, *others = learned_ids(spark, 12)
    docs = [(first, f"one id many rows {i}") for i in range(200)] + [(i, f"text {i}") for i in others]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate([first, *others])], "doc_id long, quality int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = quality.learn(frame, labels)
    assert max(n for n, _ in taken) <= 12
    single = quality.learn(frame.groupBy("doc_id").agg(F.min("text").alias("text")), labels)
    assert np.array_equal(found.push, single.push)
