"""Near copies by SimHash, linked through BK-trees.

Equal fingerprints are one class, so a group of copies is one tree node however large it is. Two
fingerprints within ``RADIUS`` bits agree on at least two of ``RADIUS + 2`` blocks of their bits.
Every pair of blocks therefore gives a shard key, and all links lie inside shards. A shard's
fingerprints form a BK-tree: the children of a node are keyed by their integer distance to it, and a
search follows only the edges within the radius of the query's distance. Trees meet their queries by
a shuffle on the shard key and not by a driver broadcast, since they hold all fingerprints and so
grow with the corpus.

A shard above ``TREE_NODES`` is cut into trees of about that size, and its queries are dealt to each
pair of parts, so no task holds more than two parts. A task returns a spanning forest of the links it
found, at most one row per node, which keeps components whole without listing pairs of a group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesight.llm.graph import components
from tablesight.plans.shared import stored

RADIUS = 4
WORDS = 4
SEED = 42
#: Most fingerprints in one tree, and about how many rows one task takes.
TREE_NODES = 16_384
TASK_ROWS = 50_000
#: Shingles whose bits are counted at once, and tree visits held at once.
BIT_ROWS = 1 << 16
VISITS = 1 << 21


def text_fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of ``words``-word shingles of the text, ASCII letters lower-cased, as a signed integer."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    whole, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) < words:
        hashes = np.array([digest(whole, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes + 1) - 1
        spans = zip((ends - sizes).tolist(), ends[words - 1 :].tolist(), strict=False)
        hashes = np.fromiter((digest(whole[a:b], SEED) for a, b in spans), np.uint64, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BIT_ROWS):
        part = hashes[at : at + BIT_ROWS]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_column(text):
    """The fingerprint of a text column as a long column."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t if isinstance(t, str) else None) for t in texts], dtype="int64")

    return fingerprint(text)


class Forest:
    """BK-trees over distinct fingerprints, one per value of ``tree`` (0, 1, ...), built level by level."""

    def __init__(self, tree: np.ndarray, prints: np.ndarray):
        self.prints = prints
        _, self.root = np.unique(tree, return_index=True)
        at, rest = self.root[tree], np.setdiff1d(np.arange(len(tree)), self.root)
        slots, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(rest):
            slot = at[rest] * 65 + np.bitwise_count(prints[rest] ^ prints[at[rest]])
            taken, first, place = np.unique(slot, return_index=True, return_inverse=True)
            child = rest[first]
            slots.append(taken)
            children.append(child)
            at[rest] = child[place]
            rest = np.delete(rest, first)
        slots, children = np.concatenate(slots), np.concatenate(children)
        order = np.argsort(slots)
        self.slots, self.children = slots[order], children[order]

    def within(self, tree: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) at ``radius`` or fewer differing bits."""
        query, node = np.arange(len(prints)), self.root[tree]
        found = []
        while len(query):
            apart = np.bitwise_count(prints[query] ^ self.prints[node]).astype(np.int64)
            hit = apart <= radius
            found.append((query[hit], node[hit]))
            low = np.searchsorted(self.slots, node * 65 + np.maximum(apart - radius, 1))
            many = np.searchsorted(self.slots, node * 65 + np.minimum(apart + radius, 64), "right") - low
            query = np.repeat(query, many)
            step = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)
            node = self.children[np.repeat(low, many) + step]
        return np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found])


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (node to a node of its set) after the sets of each a and b are joined."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (next_label := label[label])).any():
            label = next_label
    return label


def shard_links(rows: pd.DataFrame, radius: int = RADIUS) -> pd.DataFrame:
    """A spanning forest (a, b) of the links among one task's fingerprints.

    ``rows``: pair, bits (the shard key), print, asks. Rows that ask are searched in the tree of the
    others; where a shard key has no asking row, its tree is searched for its own nodes.
    """
    rows = rows.drop_duplicates(["pair", "bits", "print", "asks"]).sort_values(["pair", "bits", "asks", "print"], ignore_index=True)
    shard = rows.groupby(["pair", "bits"], sort=False).ngroup().to_numpy()
    prints, asks = rows["print"].to_numpy().view(np.uint64), rows["asks"].to_numpy()  # bitwise_count of a signed value drops its sign
    nodes = np.flatnonzero(~asks)
    held = np.unique(shard[nodes])
    dense = np.searchsorted(held, shard)
    forest = Forest(dense[nodes], prints[nodes])
    served = np.isin(shard, np.unique(shard[asks]))
    seekers = np.flatnonzero(asks | ~served)
    seekers = seekers[np.isin(shard[seekers], held)]
    label = np.arange(len(rows))
    weight = np.cumsum(np.bincount(dense[nodes])[dense[seekers]])
    for block in np.split(seekers, np.flatnonzero(np.diff(weight // VISITS)) + 1):
        query, node = forest.within(dense[block], prints[block], radius)
        label = _joined(label, block[query], nodes[node])
    linked = label != np.arange(len(rows))
    return pd.DataFrame({"a": prints[linked].view(np.int64), "b": prints[label[linked]].view(np.int64)})


def _masks(radius: int) -> list[int]:
    """Signed 64-bit masks of all pairs of ``radius + 2`` blocks."""
    edges = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (x | y for x, y in combinations(blocks, 2))]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) whose components equal those of all links among the distinct fingerprints ``print``."""
    masks = _masks(radius)
    keys = F.array(*[F.struct(F.lit(i).cast("int").alias("pair"), F.col("print").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])
    keyed = prints.select("print", F.explode(keys).alias("key")).select("print", "key.pair", "key.bits")
    tasks = max(1, -(-prints.count() * len(masks) // TASK_ROWS))
    large = keyed.groupBy("pair", "bits").count().where(F.col("count") > TREE_NODES)
    large = large.select("pair", "bits", F.ceil(F.col("count") / TREE_NODES).cast("int").alias("parts"))
    dealt = keyed.join(stored(large, "large-shards"), ["pair", "bits"], "left")
    mine = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    others = F.when(F.col("parts").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))
    other = dealt.withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("other", F.explode(others))
    block = F.xxhash64("pair", "bits", F.least("mine", "other"), F.greatest("mine", "other"))
    task = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("pair", "bits"), F.lit(tasks))).otherwise(block)
    rows = other.select(task.alias("task"), "pair", "bits", "print", (F.col("mine") > F.col("other")).alias("asks"))
    found = rows.groupBy("task").applyInPandas(lambda x: shard_links(x[["pair", "bits", "print", "asks"]], radius), "a long, b long")
    return found.distinct()


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Each fingerprint of ``prints`` (doc_id, print) once: ``print, component`` and ``component_id``.

    ``component`` is the smallest fingerprint reachable; ``component_id`` the smallest doc_id there,
    null where no document of the component has one.
    """
    firsts = stored(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "classes")
    linked = components(links(firsts.select("print"), radius))
    labelled = firsts.join(linked.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("label", "print"))
    merged = labelled.join(linked.select(F.col("label").alias("component")).distinct(), "component", "left_semi")
    merged = merged.groupBy("component").agg(F.min("first").alias("least"))
    return labelled.join(merged, "component", "left").select("print", "component", F.coalesce("least", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    A null or wordless text has fingerprint zero and links like any other. Repeated rows all stay.
    A null doc_id takes part by its text. Columns other than doc_id and text are not read.
    """
    prints = stored(docs.select(F.col("doc_id").cast("long"), fingerprint_column(F.col("text").cast("string")).alias("print")), "fingerprints")
    named = classes(prints, radius).select("print", "component_id")
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` per component: its smallest doc_id, null ids last, ties by text and then any equal row."""
    mark, rank = (next(n for i in range(len(docs.columns) + 1) if (n := f"{base}_{i}") not in docs.columns) for base in ("print", "rank"))
    marked = stored(docs.withColumn(mark, fingerprint_column(F.col("text").cast("string"))), "fingerprinted")
    found = classes(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(mark).alias("print")), radius)
    named = found.select(F.col("print").alias(mark), F.struct("component", "component_id").alias(rank))
    first = marked.join(named, mark).where(F.col("doc_id").eqNullSafe(F.col(f"{rank}.component_id")))
    order = Window.partitionBy(f"{rank}.component").orderBy(F.xxhash64("text"))
    return first.withColumn(mark, F.row_number().over(order)).where(F.col(mark) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
