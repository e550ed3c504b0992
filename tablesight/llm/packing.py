"""Best-fit packing of token pieces into sequences of a fixed length, in bulk-synchronous rounds.

A document is cut into pieces of the sequence length; only its first piece may be shorter. Full pieces
are sequences of their own. The rest is packed by rounds that place very many pieces at once:

1. pieces and gaps are sorted together by size, largest first, gaps before pieces of their size;
2. a sweep over that order gives each piece its successor, the smallest free gap that holds it. The
   sweep is bracket matching: a gap opens, a piece closes the gap opened last. The running difference
   of both is a level, and a piece's gap is the row before it on its level, so the sweep is a prefix
   sum and a window over levels. Pieces that want one gap differ in rank, hence in level, and only
   one of them gets it;
3. gaps shrink by what they took, and pieces left over go to the next round. New empty sequences are
   opened only for what certainly needs them: tokens beyond the sum of all gaps, and pieces longer
   than every gap.

While all waiting pieces are short, a gap is offered as several equal parts, so thousands of tiny
pieces do not take thousands of rounds. There are at most ``limit`` sizes, so only counts by size reach
the driver. Ranks within a size are taken in ``SALTS`` parts, so a size that holds a third of all
pieces is no single task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesight.plans.shared import stored

LIMIT = 1024
END_ID = 2
#: Parts in which the rows of one size are ranked.
SALTS = 16
BATCH_BYTES = 1 << 20


def _encoder(name: str):
    """The byte-level BPE in ``name``.tiktoken, with the added tokens of ``name``.json; its ids equal those of ``tokenizers`` on that file."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
        added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def token_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k", limit: int = LIMIT, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Rows ``item, doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` of every document.

    An added token that stands in a text is that token. A null text is empty and gives the end id alone. Repeated rows and null ids give pieces of their
    own; ``item`` numbers pieces uniquely. Columns other than ``doc_id`` and ``text`` are not read.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode, item = _encoder(vocabulary), TaskContext.get().partitionId() << 36
        names = ["item", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if keep_ids else [])]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                cuts = [0, *range(len(ids) % limit or min(limit, len(ids)), len(ids) + 1, limit)]
                for piece, (start, stop) in enumerate(zip(cuts, cuts[1:])):
                    own = ids[start:stop]
                    row = [item, doc, piece, start, stop - start, zlib.crc32(own.tobytes()), *([own.astype("i4")] if keep_ids else [])]
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
                    item += 1
                if keep_ids and len(rows[0]) >= BATCH_BYTES // limit:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names)
                    rows = [[] for _ in names]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names)

    schema = "item long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, schema)


def _new_gaps(sizes: dict[int, int], gaps: dict[int, int], limit: int) -> int:
    """Sequences that the waiting pieces need for certain beside ``gaps``; both map a size to its count."""
    tokens = sum(s * n for s, n in sizes.items())
    spare = sum(g * n for g, n in gaps.items())
    widest = max(gaps, default=0)
    large = {s: n for s, n in sizes.items() if s > widest}
    return max(
        math.ceil(max(0, tokens - spare) / limit),
        math.ceil(sum(s * n for s, n in large.items()) / limit),
        sum(n for s, n in large.items() if 2 * s > limit),
    )


def _parts(gap: int, largest: int, items: int, gaps: int) -> int:
    """Into how many equal parts a gap is offered: each holds the largest piece, all of them about twice the pieces."""
    return max(1, min(gap // largest, -(-2 * items // max(gaps, 1))))


def _salt(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")


def _sweep(rows: DataFrame) -> DataFrame:
    """``rows`` (kind 0 gap or 1 piece, id, size, total) with ``bin``, the gap a piece got or null."""
    spark = rows.sparkSession
    rows = rows.withColumn("salt", _salt(F.struct("id", "part")))
    counts = rows.groupBy("size", "kind", "salt").count().collect()  # at most limit x 2 x SALTS rows
    level, first = 0, []
    by_run: dict[tuple[int, int], list] = {}
    for r in counts:
        by_run.setdefault((-r["size"], r["kind"]), []).append((r["salt"], r["count"]))
    for (size, kind), salts in sorted(by_run.items()):
        for salt, count in sorted(salts):
            first.append((-size, kind, salt, level))
            level += count if kind == 0 else -count
    offsets = spark.createDataFrame(first, "size int, kind int, salt int, level long")
    rank = F.row_number().over(Window.partitionBy("size", "kind", "salt").orderBy("id", "part"))
    levelled = rows.withColumn("rank", rank).join(F.broadcast(offsets), ["size", "kind", "salt"])
    at = F.when(F.col("kind") == 0, F.col("level") + F.col("rank")).otherwise(F.col("level") - F.col("rank") + 1)
    before = Window.partitionBy("at").orderBy(F.desc("size"), "kind")
    gap = F.lag(F.when(F.col("kind") == 0, F.col("id"))).over(before)
    return levelled.select("kind", "id", "size", "total", at.alias("at")).select("kind", "id", "size", "total", F.when(F.col("kind") == 1, gap).alias("bin"))


def best_fit(items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Place every row of ``items`` (item, length up to ``limit``) in a sequence: ``item, length, sequence_id``.

    ``item`` must be unique. Sequence ids are unique, not gapless. An empty table gives no rows.
    """
    spark = items.sparkSession
    full = items.where(F.col("length") >= limit).select("item", "length", (F.col("item") * 2).alias("sequence_id"))
    waiting = items.where(F.col("length") < limit).select(F.col("item").alias("id"), F.col("length").cast("int").alias("size"))
    gaps, placed, turn = spark.createDataFrame([], "id long, total int"), [full], 0
    while True:
        held = waiting.select(F.lit(1).alias("kind"), "size").unionByName(gaps.select(F.lit(0).alias("kind"), F.col("total").alias("size")))
        tally = held.groupBy("kind", "size").count().collect()  # at most 2 x limit rows
        sizes = {r["size"]: r["count"] for r in tally if r["kind"] == 1}
        if not sizes:
            break
        free = {r["size"]: r["count"] for r in tally if r["kind"] == 0 and r["size"] >= min(sizes)}
        opened = _new_gaps(sizes, free, limit)
        free[limit] = free.get(limit, 0) + opened
        fresh = spark.range(opened).select(((F.col("id") + F.lit(turn << 44)) * 2 + 1).alias("id"), F.lit(limit).alias("total"))
        parts = {g: _parts(g, max(sizes), sum(sizes.values()), sum(free.values())) for g in free}
        count = F.element_at(F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]), F.col("total"))
        offered = (
            gaps.where(F.col("total") >= min(sizes)).unionByName(fresh).withColumn("n", count)
            .withColumn("part", F.explode(F.sequence(F.lit(1), F.col("n"))))
            .select(F.lit(0).alias("kind"), "id", "part", F.floor(F.col("total") / F.col("n")).cast("int").alias("size"), "total")
        )
        asked = waiting.select(F.lit(1).alias("kind"), "id", F.lit(0).alias("part"), "size", F.lit(None).cast("int").alias("total"))
        swept = stored(_sweep(offered.unionByName(asked)), "sweep")
        got = swept.where("kind = 1 and bin is not null")
        placed.append(got.select(F.col("id").alias("item"), F.col("size").cast("long").alias("length"), F.col("bin").alias("sequence_id")))
        waiting = swept.where("kind = 1 and bin is null").select("id", "size")
        taken = F.sum(F.when(F.col("kind") == 1, F.col("size")).otherwise(0))
        gaps = (
            swept.where("kind = 0 or bin is not null").groupBy(F.coalesce("bin", "id").alias("id"))
            .agg((F.max("total") - taken).cast("int").alias("total")).where("total > 0")
        )
        turn += 1
    return _union(placed)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` (of ``token_pieces``) with ``sequence_id`` and ``offset``, its place there, gapless from 0."""
    at = best_fit(pieces.select("item", "length"), limit).select("item", "sequence_id")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "item")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return pieces.join(at, "item").withColumn("offset", F.coalesce(before, F.lit(0)).cast("long")).drop("item")


def packed_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k", limit: int = LIMIT, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack all ``docs``: a row per piece with doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return pack(stored(token_pieces(docs, vocabulary, limit, end_id, keep_ids), "pieces"), limit)
