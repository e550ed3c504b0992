"""The registered query of each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesight.llm import (
    bpe, knn, language, merkle, mixing, packing, quality, runs, secrets, sharding, simhash, sketch, url_reputation,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """The labels give the outcome of the page of the same number."""
    outcomes = _table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_reputation.judge(_table(spark, folder, "pages"), outcomes)


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(_table(spark, folder, "documents"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(_table(spark, folder, "documents"))


def op5_voronoi_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return knn.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op6_raked_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(_table(spark, folder, "documents"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(_table(spark, folder, "documents"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op9_balanced_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"))


def op10_threshold_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.edited_fingerprints(_table(spark, folder, "documents"), scale=sketch.SCALE, least=sketch.LEAST)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", runs.planted_text(F.col("text"), F.col("doc_id")).alias("text"))
    return runs.run_digests(runs.periodic_runs(docs))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.tamper_check(_table(spark, folder, "documents"))


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(_table(spark, folder, "documents"), digests=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_reputation, op2_best_fit_packing, op3_simhash, op4_secrets, op5_voronoi_top_k, op6_raked_mixture, op7_language,
        op8_quality, op9_balanced_shards, op10_threshold_sketch, op11_periodic_runs, op12_merkle_manifest, op13_byte_bpe,
    )
}
#: The other queries train models, compress, tokenize or iterate to a fixed point; tests hold them against brute force.
ORACLES = {
    "op1_url_reputation": url_reputation.oracle(),
    "op5_voronoi_top_k": knn.oracle(),
    "op6_raked_mixture": mixing.oracle(),
    "op12_merkle_manifest": merkle.oracle(),
}
