"""Exact top-k by integer inner product: a Voronoi join of queries and data.

Queries and data are grouped by their nearest pivot. A query group is summarised by its pivot c and
radius r, so q.x lies within r|x| of c.x for each of its queries q; a data cell by its pivot, its radius
and its largest norm. A first pass over the data finds, per query group, a score that enough vectors
certainly reach for every query of the group; a second one sends a vector to the groups where it could
reach that score, after whole cells have been ruled out by their summaries. Every group is solved where
it is, in blocks of queries and data, and a last merge keeps the best of each query.

Bounds decide only what is sent; scores are exact. Equal vectors travel once, with as many of their
smallest ids as could matter, so a vector that fills a third of the table is one row. On embeddings
without clusters the bounds rule out little, and each vector goes to about every group; the number of
groups is therefore small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesight.plans.shared import stored

K = 5
UNITS = 256.0
#: Query groups, and the most queries and data vectors of one block.
PIVOTS = 16
BLOCK_QUERIES, BLOCK_DATA = 2_048, 8_192


def _packed(vector: np.ndarray | None) -> bytes | None:
    """floor(256 x) in the smallest of 2 or 4 byte integers, led by its type; None if a component is null or not finite."""
    if vector is None:
        return None
    whole = np.floor(np.asarray(vector, np.float64) * UNITS)
    if not np.isfinite(whole).all():
        return None
    kind = "h" if (np.abs(whole) < 2**15).all() else "i"
    if kind == "i" and (np.abs(whole) >= 2**31).any():
        raise ValueError("a component is too large for integer scores")
    return kind.encode() + whole.astype(f"<{'i2' if kind == 'h' else 'i4'}").tobytes()


def _matrix(rows: pd.Series, width: int = 0) -> np.ndarray:
    """Packed vectors as rows of a float matrix, the shorter ones filled up with zeros."""
    vectors = [np.frombuffer(b, "<i2" if b[:1] == b"h" else "<i4", offset=1) for b in rows]
    out = np.zeros((len(vectors), max([width, *map(len, vectors)])))
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, by floats where these are exact."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    if width * max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) < 2**53:
        return (a @ b.T).astype(np.int64)
    return (a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T).astype(np.int64)


def packed_vectors(table: DataFrame) -> DataFrame:
    """Distinct (vec_id, vector) of ``table`` (vec_id, embedding), packed; null ids and unusable vectors are left out."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch["vec_id"], "vector": [_packed(v) for v in batch["embedding"]]})

    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    rows = table.where("vec_id is not null").where(usable).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInPandas(pack, "vec_id long, vector binary").where("vector is not null").distinct()


def _nearest(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return ((pivots**2).sum(axis=1) - 2 * points @ pivots.T).argmin(axis=1)


def _grouped(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (vector, ...) with their nearest pivot, distance to it and norm."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = _matrix(batch["vector"], pivots.shape[1])
            own = _nearest(points, pivots)
            yield batch.assign(cell=own.astype("int32"), apart=np.linalg.norm(points - pivots[own], axis=1), norm=np.linalg.norm(points, axis=1))

    return rows.mapInPandas(near, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell int, apart double, norm double")


def _reached(data: DataFrame, pivots: np.ndarray, radius: np.ndarray, need: int) -> np.ndarray:
    """Per query group a score that ``need`` vectors reach for each of its queries; minus infinity if there are fewer."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = np.full((len(pivots), need), -np.inf)
        for batch in batches:
            points = _matrix(batch["vector"], pivots.shape[1])
            sure = pivots @ points.T - radius[:, None] * batch["norm"].to_numpy()
            top = np.sort(np.concatenate([top, sure], axis=1), axis=1)[:, -need:]
        group = np.repeat(np.arange(len(pivots), dtype="int32"), need)
        yield pd.DataFrame({"group": group, "score": top.ravel()})

    order = Window.partitionBy("group").orderBy(F.desc("score"))
    found = data.select("vector", "norm").mapInPandas(best, "group int, score double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") == need)
    least = np.full(len(pivots), -np.inf)
    for r in found.collect():  # one row per pivot
        least[r["group"]] = r["score"]
    return least


def top_k(table: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """The ``k`` best rows of ``table`` (vec_id, embedding) for each of ``queries`` (vec_id): query_id, rank, vec_id, score.

    Scores are inner products of the integers floor(256 x), shorter vectors filled up with zeros; ties
    go to the smaller vec_id; a row is no candidate for its own id. Null ids, and vectors that are null
    or hold null or non-finite components, take no part. Repeated rows count once. Components of 2**23
    or more in size raise an error, since scores would not fit.
    """
    spark, need = table.sparkSession, k + 1
    vectors = stored(packed_vectors(table), "vectors")
    asked = vectors.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").withColumnRenamed("vec_id", "query_id")
    seeking = stored(asked.select("vector").distinct(), "queries")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    seeds = seeking.orderBy(F.xxhash64("vector"), "vector").limit(pivots).toPandas()
    if seeds.empty:
        return empty
    centres = _matrix(seeds["vector"])
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = vectors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= need)
    data = stored(_grouped(few.groupBy("vector").agg(F.collect_list("vec_id").alias("ids")), centres), "data")
    seeking = stored(_grouped(seeking, centres), "query-groups")

    radius, counts = np.zeros(len(centres)), np.zeros(len(centres), int)
    for r in seeking.groupBy("cell").agg(F.max("apart").alias("r"), F.count("*").alias("n")).collect():
        radius[r["cell"]], counts[r["cell"]] = r["r"] * (1 + 1e-9) + 1e-6, r["n"]
    reach = np.zeros(len(centres))
    for r in data.groupBy("cell").agg(F.max("apart").alias("r")).collect():
        reach[r["cell"]] = r["r"] * (1 + 1e-9) + 1e-6
    least = _reached(data, centres, radius, need)
    size = np.linalg.norm(centres, axis=1)
    possible = centres @ centres.T + radius[:, None] * (size + reach) + size[:, None] * reach
    open_cells = (possible * (1 + np.sign(possible) * 1e-9) + 1 >= least[:, None]) & (counts > 0)[:, None]

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = _matrix(batch["vector"], centres.shape[1])
            norms = batch["norm"].to_numpy()
            most = points @ centres.T + norms[:, None] * radius
            send = open_cells[:, batch["cell"].to_numpy()].T & (most + np.abs(most) * 1e-9 + 1 >= least)
            row, group = np.nonzero(send)
            yield pd.DataFrame({"group": group.astype("int32"), "vector": batch["vector"].to_numpy()[row], "ids": batch["ids"].to_numpy()[row]})

    slices = max(1, -(-data.count() // BLOCK_DATA))
    parts = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // BLOCK_QUERIES))) for n in counts]), F.col("group") + 1)
    mine = F.pmod(F.xxhash64("vector"), F.lit(slices)).cast("int")
    sent = data.select("vector", "ids", "norm", "cell").mapInPandas(needed, "group int, vector binary, ids array<bigint>")
    sent = sent.withColumn("slice", mine).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    asking = seeking.select(F.col("cell").alias("group"), "vector", F.lit(None).cast("array<bigint>").alias("ids"))
    asking = asking.withColumn("part", F.pmod(F.xxhash64("vector"), parts).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    block = ["group", "part", "slice"]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        held = rows["ids"].notna()
        base, ask = rows[held], rows[~held]
        if base.empty or ask.empty:
            return pd.DataFrame({"vector": [], "vec_id": [], "score": []})
        found = []
        points, ids = _matrix(base["vector"]), base["ids"].to_numpy()
        for query, line in zip(ask["vector"], _scores(_matrix(ask["vector"]), points), strict=True):
            bar = np.partition(line, -need)[-need] if len(line) > need else line.min()
            best = sorted((-int(line[i]), int(v)) for i in np.flatnonzero(line >= bar) for v in ids[i])[:need]
            found += [(query, v, -s) for s, v in best]
        return pd.DataFrame(found, columns=["vector", "vec_id", "score"])

    columns = [*block, "vector", "ids"]
    solved = sent.select(columns).unionByName(asking.select(columns)).groupBy(*block).applyInPandas(lambda x: solve(x), "vector binary, vec_id long, score long")
    by_vector = Window.partitionBy("vector").orderBy(F.desc("score"), "vec_id")
    kept = solved.withColumn("rank", F.row_number().over(by_vector)).where(F.col("rank") <= need).drop("rank")
    pairs = asked.join(kept, "vector").where("query_id <> vec_id")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def oracle(every: int = 50, k: int = K) -> str:
    """DuckDB SQL for ``top_k`` of ``embeddings`` with every ``every``-th id as a query."""
    return f"""
        with vectors as materialized (
            select distinct vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
        scored as (
            select q.vec_id as query_id, d.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(d.v as double[])) as bigint) as score
            from vectors q join vectors d on q.vec_id <> d.vec_id where q.vec_id % {every} = 0),
        ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
        select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= {k}"""
