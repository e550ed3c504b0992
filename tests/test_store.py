"""Commits of artifacts: what the manifest lacks is not there."""

import pytest

from tablesight.sources import store


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "store")


def rows(spark, *runs):
    return spark.createDataFrame([(r, i, None if i % 2 else "x") for r in runs for i in range(3)], "run_id string, i long, v string")


def test_an_interrupted_write_is_invisible(spark, folder):
    assert store.listed(spark, folder).count() == 0
    store.commit_runs({"A2": rows(spark, "a"), "A4": rows(spark, "a")}, folder)
    store.write_data({"A2": rows(spark, "b")}, folder, "broken")
    assert store.read(spark, folder, "A2").select("run_id").distinct().collect() == [("a",)]
    assert sorted(map(tuple, store.listed(spark, folder).collect())) == [("a", "A2", 3), ("a", "A4", 3)]
    store.commit_data(spark, folder, "broken", ["A2"])
    assert store.read(spark, folder, "A2", "b").count() == 3 and store.read(spark, folder, "A2").count() == 6
    with pytest.raises(KeyError):
        store.read(spark, folder, "A9")
    with pytest.raises(KeyError):
        store.read(spark, folder, "A4", "b")


def test_runs_are_written_once_and_the_first_commit_counts(spark, folder):
    first = store.commit_runs({"A2": rows(spark, "a")}, folder)
    with pytest.raises(ValueError):
        store.commit_runs({"A2": rows(spark, "a", "c")}, folder)
    store.write_data({"A2": rows(spark, "a", "a")}, folder, "zz")  # a writer that raced past the check
    store.commit_data(spark, folder, "zz", ["A2"])
    assert store.meta(spark, folder, "A2", "a").first()["commit"] == first
    assert store.read(spark, folder, "A2").count() == 3
    assert [r["unchanged"] for r in store.verified(spark, folder, "A2").collect()] == [True]


def test_changed_rows_are_noticed(spark, folder):
    commit = store.commit_runs({"A2": rows(spark, "a")}, folder)
    rows(spark, "a").limit(1).write.mode("append").parquet(f"{folder}/data/A2/{commit}")
    assert [r["unchanged"] for r in store.verified(spark, folder, "A2").collect()] == [False]


def test_listing_reads_the_manifest_alone(spark, folder):
    store.commit_runs({"A2": rows(spark, "a")}, folder)
    files = store.listed(spark, folder).inputFiles()
    assert files and all("/manifest/" in f for f in files)
