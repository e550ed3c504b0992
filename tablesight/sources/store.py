"""A store of immutable artifacts with a manifest: what is not in the manifest does not exist.

A commit writes its artifacts into folders of its own and its manifest rows last, in one append. A write
that breaks off leaves files that no reader looks at. Listing and meta read the manifest alone. Of two
commits of one run that race each other, every reader takes the one written first.

``<folder>/data/<artifact>/<commit>`` holds rows, ``<folder>/manifest`` one row per commit, artifact and run.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = ("commit string, artifact_id string, run_id string, n_rows long, content_checksum string, schema_json string, written_at timestamp")


def _data(folder: str, artifact: str, commit: str) -> str:
    return f"{folder}/data/{artifact}/{commit}"


def write_data(artifacts: dict[str, DataFrame], folder: str, commit: str) -> None:
    """The first half of a commit: rows of all artifacts, invisible so far. Frames have a column ``run_id``."""
    for artifact, df in artifacts.items():
        df.hint("rebalance", "run_id").write.mode("errorifexists").parquet(_data(folder, artifact, commit))


def _checksum(df: DataFrame) -> Column:
    """Sum of row hashes, whatever the order of rows; null differs from every value."""
    cells = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.to_json(F.struct(F.col(f"`{c}`"))))]
    return F.sum(F.xxhash64(*cells).cast("decimal(38,0)")).cast("string")


def commit_data(spark: SparkSession, folder: str, commit: str, artifacts: Sequence[str]) -> None:
    """The second half: counts and checksums of what was written, appended to the manifest in one write."""
    rows = None
    for artifact in artifacts:
        df = spark.read.parquet(_data(folder, artifact, commit))
        one = df.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count(F.lit(1)).alias("n_rows"), _checksum(df).alias("content_checksum"))
        one = one.select(F.lit(commit).alias("commit"), F.lit(artifact).alias("artifact_id"), "run_id", "n_rows", "content_checksum",
                         F.lit(df.schema.json()).alias("schema_json"), F.current_timestamp().alias("written_at"))
        rows = one if rows is None else rows.unionByName(one)
    rows.write.mode("append").parquet(f"{folder}/manifest")


def commit_runs(artifacts: dict[str, DataFrame], folder: str) -> str:
    """Store ``artifacts`` as one commit and return its name; a run that the store holds already is refused."""
    spark = next(iter(artifacts.values())).sparkSession
    there = manifest(spark, folder).select("artifact_id", "run_id")
    for artifact, df in artifacts.items():
        runs = df.select(F.lit(artifact).alias("artifact_id"), F.col("run_id").cast("string")).distinct()
        if not runs.join(there, ["artifact_id", "run_id"], "left_semi").isEmpty():
            raise ValueError(f"{artifact} already holds one of these runs; artifacts are immutable")
    commit = uuid.uuid4().hex
    write_data(artifacts, folder, commit)
    commit_data(spark, folder, commit, list(artifacts))
    return commit


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per artifact and run, of the commit that came first; no rows where nothing was committed."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)
    first = F.min_by(F.struct("commit", "n_rows", "content_checksum", "schema_json", "written_at"), F.struct("written_at", "commit"))
    return rows.groupBy("artifact_id", "run_id").agg(first.alias("of")).select("of.commit", "artifact_id", "run_id", "of.n_rows", "of.content_checksum", "of.schema_json", "of.written_at")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """What is stored: run_id, artifact_id, n_rows; reads the manifest only."""
    return manifest(spark, folder).select("run_id", "artifact_id", "n_rows")


def meta(spark: SparkSession, folder: str, artifact: str, run_id) -> DataFrame:
    """The manifest row of one artifact of a run."""
    return manifest(spark, folder).where((F.col("artifact_id") == artifact) & (F.col("run_id") == str(run_id)))


def read(spark: SparkSession, folder: str, artifact: str, run_id=None) -> DataFrame:
    """Committed rows of an artifact, of all runs or of one, whose commit alone is then read.

    Fails for an artifact, or a run of it, that was never committed.
    """
    held = manifest(spark, folder).where(F.col("artifact_id") == artifact)
    if run_id is not None:
        held = held.where(F.col("run_id") == str(run_id))
    commits = sorted(r["commit"] for r in held.select("commit").distinct().collect())  # as many as there were commits
    if not commits:
        raise KeyError(artifact if run_id is None else (artifact, run_id))
    out = None
    for commit in commits:
        rows = spark.read.parquet(_data(folder, artifact, commit))
        if run_id is not None:
            rows = rows.where(F.col("run_id") == run_id)
        else:
            own = held.where(F.col("commit") == commit).select(F.col("run_id").alias("held_run"))
            rows = rows.join(own, rows["run_id"].cast("string") == F.col("held_run"), "left_semi")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def verified(spark: SparkSession, folder: str, artifact: str) -> DataFrame:
    """Per run of an artifact whether its rows still have the manifest's count and checksum."""
    rows = read(spark, folder, artifact)
    now = rows.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count(F.lit(1)).alias("rows_now"), _checksum(rows).alias("checksum_now"))
    held = manifest(spark, folder).where(F.col("artifact_id") == artifact)
    same = (F.col("n_rows") == F.col("rows_now")) & (F.col("content_checksum") == F.col("checksum_now"))
    return held.join(now, "run_id", "left").select("run_id", "artifact_id", F.coalesce(same, F.lit(False)).alias("unchanged"))
