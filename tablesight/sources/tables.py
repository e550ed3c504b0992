"""Reading datasets as text and keeping immutable artifacts per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesight import vocab


def ingest_delimited(spark: SparkSession, path: str | Sequence[str], delimiter: str = ",", multi_line: bool = True) -> DataFrame:
    """Every cell as the text it was written with; no type inference, quoted newlines kept.

    Quoted newlines make one file unsplittable, so give Spark many files rather than one large one, or
    set ``multi_line`` to false where no cell holds a newline, and large files are split.
    """
    return (
        spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("sep", delimiter)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("inferSchema", False).csv(path)
    )


def manifest(df: DataFrame, run_id: str | Column, source: str, schema_of: Sequence[str] | None = None) -> DataFrame:
    """One identity row per run: counts, schema and an order-free content checksum."""
    columns = list(schema_of or df.columns)
    schema = "{" + ",".join(f'"{f.name}":"{f.dataType.simpleString()}"' for f in df.schema.fields if f.name in columns) + "}"
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    digest = F.xxhash64(*[x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]).cast("decimal(38,0)")
    return df.groupBy(run.alias("run_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(digest).cast("string").alias("content_checksum")
    ).withColumns({"n_columns": F.lit(len(columns)).cast("bigint"), "schema_json": F.lit(schema), "source": F.lit(source)})


def _laid_out(df: DataFrame, buckets: int | None) -> tuple[DataFrame, str]:
    if buckets is None:
        return df.hint("rebalance", "run_id"), "run_id"
    keyed = df.withColumn("run_bucket", F.pmod(F.xxhash64(F.col("run_id").cast("string")), F.lit(buckets)).cast("int"))
    return keyed.hint("rebalance", "run_bucket").sortWithinPartitions("run_bucket", "run_id"), "run_bucket"


def write_artifacts(artifacts: dict[str, DataFrame], folder: str, buckets: int | None = None) -> None:
    """One Parquet table per artifact id. An existing artifact is never replaced.

    Few runs get a folder each. A fleet of many runs is written with ``buckets`` folders instead,
    sorted by run, so that neither the listing nor the file count grows with the runs.
    ``rebalance`` gathers each folder's rows but lets Spark split one that holds most of them.
    """
    for artifact, df in artifacts.items():
        laid, part = _laid_out(df, buckets)
        laid.write.mode("errorifexists").partitionBy(part).parquet(f"{folder}/{artifact}")


def append_run(df: DataFrame, folder: str, artifact: str) -> None:
    """Add further runs to an artifact; the runs must not be there yet."""
    spark, path = df.sparkSession, f"{folder}/{artifact}"
    there = spark.read.parquet(path).select(F.col("run_id").cast("string")).distinct()
    clash = df.select(F.col("run_id").cast("string")).distinct().join(there, "run_id", "left_semi").limit(1).count()
    if clash:
        raise ValueError(f"{artifact} already holds one of these runs; artifacts are immutable")
    if "run_bucket" in spark.read.parquet(path).columns:
        raise ValueError(f"{artifact} is bucketed; write further runs of a fleet as an artifact of their own")
    df.hint("rebalance", "run_id").write.mode("append").partitionBy("run_id").parquet(path)


def read_artifact(spark: SparkSession, folder: str, artifact: str) -> DataFrame:
    stored = spark.read.parquet(f"{folder}/{artifact}")
    return stored.drop("run_bucket")


def read_run(spark: SparkSession, folder: str, artifact: str, run_id, buckets: int | None = None) -> DataFrame:
    """Rows of one run; the filter prunes to its folder."""
    stored = spark.read.parquet(f"{folder}/{artifact}").filter(F.col("run_id") == run_id)
    if buckets is None:
        return stored
    return stored.filter(F.col("run_bucket") == F.pmod(F.xxhash64(F.lit(str(run_id))), F.lit(buckets)).cast("int")).drop("run_bucket")


def read_or_build(spark: SparkSession, folder: str, artifact: str, build) -> DataFrame:
    """A stored artifact, or the frame ``build()`` gives when it was never written."""
    from pyspark.errors import AnalysisException

    try:
        return read_artifact(spark, folder, artifact)
    except AnalysisException:
        return build()


def catalog(artifacts: dict[str, DataFrame]) -> DataFrame:
    """What is stored: rows per run and artifact."""
    parts = [df.select("run_id", F.lit(a).alias("artifact_id")) for a, df in artifacts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("run_id", "artifact_id").agg(F.count(F.lit(1)).alias("n_rows"))


def artifact_meta(artifacts: dict[str, DataFrame], artifact: str, run_id) -> DataFrame:
    return catalog({artifact: artifacts[artifact].filter(F.col("run_id") == run_id)})


def retained(runs: DataFrame, as_of: Column, days: int = vocab.RETENTION_DAYS) -> DataFrame:
    """Runs young enough to keep; the filter reaches the scan because ``as_of`` is a constant."""
    return runs.filter(F.col("run_ts") >= as_of - F.make_dt_interval(F.lit(days)))


def expired(runs: DataFrame, as_of: Column, days: int = vocab.RETENTION_DAYS) -> DataFrame:
    return runs.filter(F.col("run_ts") < as_of - F.make_dt_interval(F.lit(days)))


def drop_expired(artifact: DataFrame, runs: DataFrame, as_of: Column, days: int = vocab.RETENTION_DAYS) -> DataFrame:
    """Rows of an artifact whose run is still retained."""
    return artifact.join(retained(runs, as_of, days).select("run_id"), "run_id", "left_semi")


def compact_json(df: DataFrame, *keys: str) -> DataFrame:
    """Each row as one compact JSON text beside its keys."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("payload"))
