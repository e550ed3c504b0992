"""The digest histogram gives what the plain one gives, without moving long texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tablesight.operators import keys, profile


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(3)
    same = "<html><head><title>" + "x" * 90
    pages = [same + "y" * draw.randrange(600) + str(draw.randrange(40)) for _ in range(120)]
    odd = [" " * 90, " " * 80 + "N/A" + " " * 9, "0" + " " * 70 + "x", " " * 70 + "1", "7" * 80, "2020-01-02" + " " * 70, "a" * 64, "a" * 65, "a" * 64 + "b", None, "",
           "na", "5", "word " * 20, "a,b" * 40, "https://" + "h" * 80, "é" * 64, "é" * 70]
    rows = [(pages[i], odd[i % len(odd)], str(i % 3), "z" * 70 if i % 4 else None, pages[(i * 7) % 120] if i % 2 else pages[i]) for i in range(120)] * 2
    return spark.createDataFrame(rows, "page string, odd string, short string, `a.b` string, other string").cache()


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("most", [profile.LOOKUP_ROWS, 0])
def test_equal_to_the_plain_histogram(texts, monkeypatch, most):
    """Also where heads tie and grow round by round."""
    monkeypatch.setattr(profile, "LOOKUP_ROWS", most)
    plain = profile.cell_histogram(texts, "r")
    hist = profile.with_texts(profile.digest_histogram(texts, "r"), texts, "r")
    assert rows(hist.groupBy("column", "n").count()) == rows(plain.groupBy("column", "n").count())
    for fn in (profile.column_stats, profile.top_levels, profile.samples, profile.missing_tokens, profile.missingness_catalog, profile.parse_shares,
               profile.one_hot_like, profile.quality, profile.global_tokens):
        assert rows(fn(hist)) == rows(fn(plain)), fn.__name__
    assert keys.candidate_column_pairs(hist, ["page", "odd", "other"], 0.3) == keys.candidate_column_pairs(plain, ["page", "odd", "other"], 0.3) != []


def test_another_seed_is_steady(texts):
    hist = profile.with_texts(profile.digest_histogram(texts, "r"), texts, "r", seed=11)
    first = rows(profile.samples(hist, seed=11))
    assert first == rows(profile.samples(hist, seed=11)) and all("html" not in r or len(r) > 100 for r in first)


def test_tables_without_long_texts_and_without_rows(spark, texts):
    short = profile.digest_histogram(texts.select("short"), "r")
    assert profile.with_texts(short, texts.select("short"), "r") is short
    none = texts.limit(0)
    assert profile.with_texts(profile.digest_histogram(none, "r"), none, "r").count() == 0


def test_no_exchange_moves_long_texts(spark):
    """A column of 30 MB: the shuffles of histogram and look-up stay far below it."""
    df = spark.range(0, 3000, 1, 6).select(F.repeat(F.sha2(F.col("id").cast("string"), 256), 160).alias("body"))

    def written():
        time.sleep(1)
        executors = spark._jsc.sc().statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.length()))

    before = written()
    hist = profile.with_texts(profile.digest_histogram(df, "r"), df, "r")
    assert profile.column_stats(hist).first()["unique_count"] == 3000 and profile.top_levels(hist).agg(F.min(F.length("value"))).first()[0] == 10_240
    assert 0 < written() - before < 1_500_000
    plan = profile.digest_histogram(df, "r")._jdf.queryExecution().executedPlan().toString()
    assert "substring" in plan.split("Exchange", 1)[1]
