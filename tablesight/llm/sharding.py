"""Balanced label propagation: linked documents gather in shards of even row counts.

Documents of equal text are linked. Every document starts in a shard by its rank in a hash order, so
counts differ by one at most. Each round lets linked documents move to the shard that holds most of
their neighbours; moves are admitted under quotas per pair of shards, as many as change places plus
what room a shard has, so no shard ever holds more linked documents than its share. Unlinked documents
then fill every shard up to its exact quota, which keeps the law ``rows``: counts at most one apart.

A link group is one hub, not a clique: neighbours are counted per (unit, shard). Groups larger than a
fourth of a shard are cut into units by a hash of the id, so a group holding a third of all rows is
spread over tasks and over the few shards it needs. Ranks are taken in ``PARTS`` hash ranges per shard,
whose counts alone reach the driver. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesight.plans.shared import stored

SHARDS = 8
ROUNDS = 6
#: Hash ranges in which rows of one shard are ranked.
PARTS = 512


def _part(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(PARTS)).cast("int")


def ranked(rows: DataFrame, group: str, part: Column, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, their rank from 0 within ``group``, gapless, by ``part`` and then ``order``.

    Counts per (group, part) come to the driver, at most the groups times ``PARTS``; ranks within them
    are windows of that size.
    """
    kept = rows.withColumn("part_", part)
    before: dict = {}
    offsets = []
    for r in sorted(kept.groupBy(group, "part_").count().collect(), key=lambda r: (r[group], r["part_"])):
        offsets.append((r[group], r["part_"], before.get(r[group], 0)))
        before[r[group]] = before.get(r[group], 0) + r["count"]
    table = rows.sparkSession.createDataFrame(offsets, f"{group} int, part_ int, offset_ long")
    within = F.row_number().over(Window.partitionBy(group, "part_").orderBy(*order))
    return kept.withColumn("rank_", within).join(F.broadcast(table), [group, "part_"]).withColumn(name, F.col("offset_") + F.col("rank_") - 1).drop("part_", "rank_", "offset_")


def _quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _admitted(wishes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many may move from i to j: those who change places, and into room in order of the wishes."""
    moves = {(i, j): min(n, wishes.get((j, i), 0)) for (i, j), n in wishes.items()}
    left = list(room)
    for (i, j), n in sorted(wishes.items(), key=lambda x: -x[1]):
        more = max(0, min(n - moves[i, j], left[j]))
        moves[i, j] += more
        left[j] -= more
        left[i] += more
    return moves


def _turn(linked: DataFrame, quotas: list[int], salt: int) -> tuple[DataFrame, int]:
    """One round: ``linked`` (row, unit, shard) after admitted moves, and how many moved."""
    shards = len(quotas)
    votes = linked.groupBy("unit", "shard").count()
    draw = F.xxhash64("unit", "shard", F.lit(salt))
    best = votes.groupBy("unit").agg(F.max(F.struct("count", draw.alias("draw"), F.col("shard").alias("goal"))).alias("best"), F.sum("count").alias("size"))
    wishing = stored(linked.join(best.select("unit", F.col("best.goal").alias("goal"), (F.col("best.count") * 1000 / F.col("size")).cast("int").alias("pull")), "unit"), "wishes")
    tally = wishing.groupBy("shard", "goal").count().collect()  # at most shards squared
    here = [0] * shards
    for r in tally:
        here[r["shard"]] += r["count"]
    wishes = {(r["shard"], r["goal"]): r["count"] for r in tally if r["shard"] != r["goal"]}
    moves = _admitted(wishes, [q - h for q, h in zip(quotas, here, strict=True)])
    lane = (F.col("shard") * shards + F.col("goal")).cast("int")
    movers = ranked(wishing.where("shard <> goal").withColumn("lane", lane), "lane", _part(F.col("unit")), ["unit", "row"], "place")
    allowed = F.create_map(*[F.lit(x) for (i, j), n in moves.items() for x in (i * shards + j, n)]) if moves else None
    if allowed is None:
        return wishing.select("row", "unit", "shard"), 0
    go = F.col("place") < F.element_at(allowed, F.col("lane"))
    moved = movers.select("row", "unit", F.when(go, F.col("goal")).otherwise(F.col("shard")).alias("shard"))
    return stored(wishing.where("shard = goal").select("row", "unit", "shard").unionByName(moved), "shards"), sum(moves.values())


def sharded(rows: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Shard of every row of ``rows`` (row, a unique string) by its ``links`` (row, unit): row, shard, slot.

    Row counts of shards differ by one at most; slots are gapless from 0 within a shard. Rows without a
    unit are unlinked.
    """
    start = stored(ranked(rows.withColumn("all", F.lit(0)), "all", _part(F.col("row")), ["row"], "rank").select("row", F.pmod("rank", F.lit(shards)).cast("int").alias("shard")), "start")
    quotas = _quotas(start.count(), shards)
    linked = stored(start.join(links, "row"), "linked")
    for turn in range(rounds):
        linked, moved = _turn(linked, quotas, turn)
        if not moved:
            break
    held = [0] * shards
    for r in linked.groupBy("shard").count().collect():
        held[r["shard"]] = r["count"]
    single = ranked(start.join(links.select("row"), "row", "left_anti").select("row", F.lit(0).alias("all")), "all", _part(F.col("row")), ["row"], "rank")
    ends, total = [], 0
    for quota, count in zip(quotas, held, strict=True):
        total += quota - count
        ends.append(total)
    fill = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("rank")))
    placed = linked.select("row", "shard").unionByName(single.select("row", fill.cast("int").alias("shard")))
    return ranked(stored(placed, "placed"), "shard", _part(F.col("row")), ["row"], "slot").select("row", "shard", F.col("slot").cast("long"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes and 1, null text none. Repeated rows are linked to each other, and so
    are rows of null text; a null doc_id is placed by its text alone. Columns other than doc_id and text
    are not read. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    body = F.col("text").cast("string")
    key = F.when(body.isNull(), F.lit("null")).otherwise(F.sha2(body.cast("binary"), 256))
    facts = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).cast("long").alias("text_crc32"), key.alias("text_key"),
    ), "facts")
    named = facts.withColumn("copy", F.row_number().over(Window.partitionBy("text_key", "doc_id").orderBy(F.lit(0))))
    named = stored(named.withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy", "text_key")), "rows")
    sizes = named.groupBy("text_key").count().where("count > 1")
    most = max(1, named.count() // (4 * shards))
    parts = F.ceil(F.col("count") / F.lit(most))
    unit = F.xxhash64("text_key", F.pmod(F.xxhash64("row"), parts))
    links = stored(named.select("row", "text_key").join(sizes, "text_key").select("row", unit.alias("unit")), "links")
    placed = sharded(named.select("row"), links, shards, rounds)
    return named.join(placed, "row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
