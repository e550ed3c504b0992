"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesight.plans.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b, both long) to rows ``node, label``: the smallest node reachable, for every node above it.

    Direction, repeats and loops do not matter; nulls are ignored. A node that is its component's
    smallest has no row. Neighbours are reduced to their minimum, which combines before the shuffle,
    so no adjacency list is collected; every round is written to the shared folder.
    """
    flat = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = stored(flat.distinct(), "edges")
    while True:
        tops = stars.select(F.col("v").alias("u"))
        chained = stars.join(tops, "u", "left_semi")
        forked = stars.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < high")
        if chained.isEmpty() and forked.isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("label"))
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        stars = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
