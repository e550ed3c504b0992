"""Cutting lineage at frames that several later jobs read."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one for a session of one machine only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tablesight-checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the session's checkpoint folder and read it back.

    The folder is the shared one the cluster names in ``spark.checkpoint.dir``, so the rows survive
    the loss of any executor. Only where nothing is set, as in a local test, a scratch folder is used.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the session's checkpoints, which every executor can reach."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back, which cuts its lineage."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def _co_located(spark: SparkSession) -> Iterator[None]:
    """Frames that are dealt by a part of a join's keys are joined where they lie."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def dealt(df: DataFrame, key: str, parts: int, name: str = "table") -> DataFrame:
    """``df`` written once into the shared folder, dealt by ``key``, and read back as it was dealt.

    Frames dealt by one key into as many parts meet where they lie: sums, windows and joins on that key and further
    columns move no rows. A join that has further keys does so while it is written here.
    """
    spark, table = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    rows = df.repartition(parts, key).write.format("parquet").option("compression", "zstd").option("path", scratch_folder(spark, name))
    with _co_located(spark):
        rows.bucketBy(parts, key).saveAsTable(table)
    # a name of its own for the key: a union of two such frames else takes their keys for different columns, and moves all rows
    own = F.col(f"`{key}`").alias(key, metadata={"dealt": table})
    return spark.table(table).select(*[own if c == key else F.col(f"`{c}`") for c in df.columns])


def left_join_lookup(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], max_rows: int = 100_000,
                     max_bytes: int = 32 << 20, salts: int = 64) -> DataFrame:
    """Left join where few distinct keys may each cover most of ``rows``.

    The lookup is measured first, reading no more than ``max_rows`` + 1 of its rows. Within both bounds
    it is broadcast and ``rows`` stay where they are. Beyond them the lookup is repeated per salt and
    rows take the salts in turn, so a hot key is spread over that many tasks, equal rows included.
    """
    lookup = cut(lookup)
    written = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in lookup.columns])))
    size = lookup.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(written), F.lit(0)).alias("b")).first()
    if size["n"] <= max_rows and size["b"] <= max_bytes:
        return rows.join(F.broadcast(lookup), list(keys), "left")
    spread = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return salted.join(spread, [*keys, "salt"], "left").drop("salt")
