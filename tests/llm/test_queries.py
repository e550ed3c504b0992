import duckdb
import pytest

import corpus_pipeline
from tablesight.catalog import check
from tablesight.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = check.duck(FOLDER)
    ok, note = check.compare(spark, con, queries.QUERIES[name], queries.ORACLES[name], FOLDER)
    assert ok, note


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_pipeline_stages_bear_edge_rows(spark, edge, nothing):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, FOLDER)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == edge.columns, name
        out.count()
        assert stage(spark, nothing, FOLDER).count() == 0, name


def test_pipeline_equals_its_stages_done_plainly(spark):
    """Each stage against a plain version over the rows that went into it."""
    from tablesight.llm import mixing, packing, quality, secrets
    from test_simhash import plain_components, plain_fingerprint

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    model = quality.learn(docs, labels)
    features = quality.Features()
    first = [r for r in docs.collect() if model.score(features(r["text"])) >= quality.THRESHOLD]
    good = stages["quality_classifier"](spark, docs, FOLDER)
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, first))
    label = plain_components([int(plain_fingerprint(r["text"]), 16) for r in sorted(first)])
    seen, second = set(), []
    for r, c in zip(sorted(first), label, strict=True):
        if c not in seen:
            seen.add(c)
            second.append(r)
    single = stages["near_dedup"](spark, spark.createDataFrame(first, docs.schema), FOLDER)
    assert sorted(map(tuple, single.collect())) == sorted(map(tuple, second))
    third = []
    for r in second:
        text = secrets.redacted(r["text"])
        third.append((r["doc_id"], text, r["lang"], r["source"], len(text) if text != r["text"] else r["n_chars"]))
    clean = stages["secret_scan"](spark, spark.createDataFrame(second, docs.schema), FOLDER)
    assert sorted(map(tuple, clean.collect())) == sorted(third)
    frame = spark.createDataFrame(third, docs.schema)
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    kept = {r[0] for r in con.sql(f"select doc_id from ({mixing.oracle()}) where kept").fetchall()}
    mixed = stages["mixing_weights"](spark, frame, FOLDER).collect()
    assert {r["doc_id"] for r in mixed} == kept
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == kept
    sequences = len({r["sequence_id"] for r in rows})
    assert sequences <= -(-sum(r["length"] for r in rows) // packing.LIMIT) * 1.03 + 2
