"""Choosing codebook pages and snippets for a set of mapping targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mark_pages(pages: DataFrame, terms: list[str]) -> DataFrame:
    """Adds ``matched``: the page text mentions any term (case-insensitive)."""
    text = F.lower("text")
    hit = F.lit(False)
    for t in terms:
        hit = hit | text.contains(t.lower())
    return pages.withColumn("matched", hit)


def select_pages(marked: DataFrame, low_text: int = 40, fallback: int = 4) -> DataFrame:
    """Matched pages, their neighbours and low-text pages; the first few when nothing matches.

    Windows run within one document. ``used_fallback`` says which case a document is in.
    """
    order = Window.partitionBy("run_id").orderBy("page_number")
    whole = Window.partitionBy("run_id")
    near = F.coalesce(F.lag("matched").over(order), F.lit(False)) | F.coalesce(F.lead("matched").over(order), F.lit(False))
    tagged = marked.select(
        "run_id", "page_number", "char_count", "matched", near.alias("near"),
        F.max(F.col("matched").cast("int")).over(whole).alias("any_match"), F.row_number().over(order).alias("place"))
    picked = F.when(F.col("any_match") == 1, F.col("matched") | F.col("near") | (F.col("char_count") < low_text)).otherwise(
        F.col("place") <= fallback)
    return tagged.filter(picked).select("run_id", "page_number", "matched", (F.col("any_match") == 0).alias("used_fallback"))


def shortlist(pages: DataFrame, targets: DataFrame, k: int = 3) -> DataFrame:
    """Best pages per target by how many of its words the page holds.

    ``targets`` has run_id, target_id, term. Page words are matched to terms by an equi join, so no
    page is compared with a term it does not contain.
    """
    words = pages.select("run_id", "page_number", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}0-9_]+"))).alias("term"))
    wanted = targets.select("run_id", "target_id", F.lower("term").alias("term")).distinct()
    hits = words.join(wanted, ["run_id", "term"]).groupBy("run_id", "target_id", "page_number").agg(
        F.count(F.lit(1)).alias("n_terms"))
    order = Window.partitionBy("run_id", "target_id").orderBy(F.col("n_terms").desc(), "page_number")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
