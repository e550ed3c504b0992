"""Merkle manifest of a dataset: a hash tree over documents, with a proof for each.

Leaves are ordered per language and reduced in runs of eight; the languages' roots are reduced likewise
to the root of the dataset. The tree is cut into superblocks of ``SPAN`` = 8 ** 3 neighbouring nodes:

1. upwards, each superblock is reduced to its one node, and these nodes are the leaves of the next
   round, until each language has one node;
2. downwards, the nodes of a round are cogrouped with the outer nodes of their superblock, that is the
   siblings on its way to the root, which gives each node its own outer nodes;
3. in the last exchange leaves and outer nodes meet by superblock in ``applyInPandas``, which finishes
   the local reduction, joins the proofs and folds them.

A group holds one superblock and one row of outer nodes, so it is bounded however large the dataset or
a language is. Positions come from ranges of the order, numbered by one row per range and language, so no
window runs over a language. Only the number of rounds reaches the driver.

A path is text: levels from the leaf up, comma-joined, each the node's place in its run (one digit) and
the digests of the run's other nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesight.plans.shared import stored

if TYPE_CHECKING:
    import pandas as pd

#: Nodes of a run, and levels and nodes of a superblock.
FAN, LEVELS = 8, 3
SPAN = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as its length in bytes, a colon and its text, or a hyphen for null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _height(n: int) -> int:
    """Levels until ``n`` nodes are one, at most those of a superblock."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _reduce(nodes: list[str], levels: int) -> tuple[list[list[str]], str]:
    """Of a superblock: each level's steps (place and siblings of every node there), and what remains."""
    steps = []
    for _ in range(levels):
        runs = [nodes[a : a + FAN] for a in range(0, len(nodes), FAN)]
        steps.append([f"{i}{''.join(run[:i] + run[i + 1 :])}" for run in runs for i in range(len(run))])
        nodes = [_digest("".join(run)) for run in runs]
    return steps, nodes[0]


def _path(steps: list[list[str]], i: int, outer: str) -> str:
    own = [level[i // FAN**k] for k, level in enumerate(steps)]
    return ",".join([*own, outer] if outer else own)


def fold(node: str, path: str) -> str:
    """The root that ``node`` and the siblings of ``path`` give."""
    for step in path.split(",") if path else []:
        place, others = 64 * int(step[0]), step[1:]
        node = _digest(others[:place] + node + others[place:])
    return node


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with ``tree``) and ``index``, the place in the tree by ``order``, from 0, and ``size``, the tree's nodes."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = stored(ranged.withColumn("place", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("place", 33).alias("part")
    starts = ranged.groupBy("tree", part).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = starts.select("tree", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(tree).alias("size"))
    at = F.col("place") - F.col("first") + F.col("before")
    return ranged.withColumn("part", part).join(offsets, ["tree", "part"]).withColumn("index", at).drop("place", "part", "first", "before")


def _superblocks(nodes: DataFrame) -> DataFrame:
    """The one node that remains of each superblock of ``nodes`` (tree, index, size, node), in the same form."""

    def reduced(group: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        first = group.sort_values("index")
        size = int(first["size"].iloc[0])
        _, top = _reduce(first["node"].tolist(), _height(size))
        return pd.DataFrame({"tree": first["tree"].iloc[:1], "index": first["index"].iloc[:1] // SPAN, "size": -(-size // SPAN), "node": top})

    block = F.floor(F.col("index") / SPAN).alias("block")
    kept = nodes.select("tree", "index", "size", "node")
    return kept.groupBy("tree", block).applyInPandas(reduced, "tree string, index long, size long, node string")


def _rounds(leaves: DataFrame) -> list[DataFrame]:
    """``leaves`` and the nodes of every round above, up to one node per tree."""
    rounds = [leaves]
    while len(rounds) == 1 or (rounds[-1].agg(F.max("size")).first()[0] or 0) > 1:
        rounds.append(stored(_superblocks(rounds[-1]), "merkle-round"))
    return rounds


def _outer(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Outer nodes of every one of ``nodes``: tree, index, path, subroot, root; ``above`` has those of their superblocks."""

    def joined(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = left.sort_values("index")
        outer = right.iloc[0]
        steps, _ = _reduce(own["node"].tolist(), _height(int(own["size"].iloc[0])))
        own["path"] = [_path(steps, i, outer["path"]) for i in range(len(own))]
        own["subroot"], own["root"] = outer["subroot"], outer["root"]
        return own[["tree", "index", "path", "subroot", "root"]]

    block = F.floor(F.col("index") / SPAN).alias("block")
    left = nodes.select("tree", "index", "size", "node").groupBy("tree", block)
    right = above.withColumnRenamed("index", "block").groupBy("tree", "block")
    return left.cogroup(right).applyInPandas(joined, "tree string, index long, path string, subroot string, root string")


def _descend(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """From the outer nodes of the last round down to those of the first superblocks."""
    for nodes in reversed(rounds[1:-1]):
        top = stored(_outer(nodes, top), "merkle-outer")
    return top


def manifest(leaves: DataFrame) -> DataFrame:
    """Proofs and folds of all ``leaves`` (tree, id, leaf, changed): id, leaf, subroot, root, proof, proof_sha256, folded_root, verified.

    ``tree`` names the tree of a leaf and orders the trees; in it leaves go by ascending ``id`` (a number,
    null first), equal ids by leaf. ``changed`` is the digest of the leaf as it is found now; the proof is
    that of the leaf as it was. An empty table gives no rows.
    """
    numbered = stored(_numbered(leaves.withColumn("row", F.monotonically_increasing_id()), ["id", "leaf", "row"]), "merkle-leaves")
    rounds = _rounds(numbered.select("tree", "index", "size", F.col("leaf").alias("node")))
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node")
    upper = stored(_numbered(subroots, ["of"]), "merkle-subroots")
    upper_rounds = _rounds(upper)
    root = upper_rounds[-1].select("tree", "index", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    tops = _outer(upper, _descend(upper_rounds, root)).drop("tree")
    by_tree = upper.join(tops.drop("subroot"), "index")
    top = stored(by_tree.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("index"), "path", F.col("node").alias("subroot"), "root"), "merkle-tops")
    above = _descend(rounds, top)

    def finished(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = left.sort_values("index")
        outer = right.iloc[0]
        steps, _ = _reduce(own["leaf"].tolist(), _height(int(own["size"].iloc[0])))
        paths = [_path(steps, i, outer["path"]) for i in range(len(own))]
        own["proof"] = paths
        own["proof_sha256"] = [_digest("".join(step[1:] for step in path.split(","))) for path in paths]
        own["subroot"], own["root"] = outer["subroot"], outer["root"]
        own["folded_root"] = [fold(node, path) for node, path in zip(own["changed"], paths)]
        own["verified"] = own["folded_root"] == outer["root"]
        return own[["id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"]]

    # ids travel as text, since pandas would make numbers with nulls inexact
    left = numbered.select("tree", "index", "size", F.col("id").cast("string").alias("id"), "leaf", "changed")
    left = left.groupBy("tree", F.floor(F.col("index") / SPAN).alias("block"))
    right = above.withColumnRenamed("index", "block").groupBy("tree", "block")
    out = left.cogroup(right).applyInPandas(
        finished, "id string, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumn("id", F.col("id").cast("long"))


def changed_text(text: Column, doc_id: Column) -> Column:
    """The text with A-Z lower-cased in every third document by the checksum of its id; others as they are."""
    return F.when(F.crc32(doc_id.cast("string")) % 3 == 0, F.translate(text, CAPITALS, SMALL)).otherwise(text)


def document_leaves(docs: DataFrame, changed: Column) -> DataFrame:
    """A leaf per row of ``docs``: tree, id, leaf, and ``changed``, its digest with that text instead.

    Languages are trees, null before all others. Texts are hashed where they are read and not shuffled.
    Columns other than those of ``FIELDS`` are not read; a null takes part as null.
    """
    values = {c: F.col(c) for c in FIELDS}
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    now = leaf_hash(list((values | {"text": changed}).values()))
    return stored(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf_hash(list(values.values())).alias("leaf"), now.alias("changed")), "merkle-hashes")


def tamper_check(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` with every third text altered: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A null id is first in its language and is never altered; repeated rows are leaves of their own.
    """
    found = manifest(document_leaves(docs, changed_text(F.col("text"), F.col("doc_id"))))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def oracle(lower: int = 7, upper: int = 3) -> str:
    """The same rows in SQL, for up to 8 ** ``lower`` documents a language and 8 ** ``upper`` languages."""
    def size_first(c: str) -> str:
        return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"

    leaf = "sha256(" + " || ".join(size_first(c) for c in FIELDS) + ")"
    small = f"translate(text, '{CAPITALS}', '{SMALL}')"
    changed = leaf.replace("text", small)
    bits = "list_reduce([x] || range(8), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::bigint ELSE 0 END))"
    checksum = (
        "xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), "
        f"lambda crc, b: {bits.replace('[x]', '[xor(crc, b)]')}), 4294967295::bigint)"
    )
    ctes = [
        f"d AS (SELECT doc_id, lang, {leaf} AS leaf, CASE WHEN {checksum} % 3 = 0 THEN {changed} ELSE {leaf} END AS now FROM documents)",
        "l0 AS (SELECT lang AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, doc_id, leaf, now FROM d)",
    ]

    def level(k: str, prev: str, tree: str) -> str:
        return (
            f"{k} AS (SELECT {tree}, CASE WHEN n > 1 THEN i // 8 ELSE i END AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h "
            f"FROM (SELECT {tree}, i, h, count(*) OVER (PARTITION BY {tree}) AS n FROM {prev}) GROUP BY {tree}, n, CASE WHEN n > 1 THEN i // 8 ELSE i END)"
        ).replace("ORDER BY i", "ORDER BY j").replace(f"(SELECT {tree}, i, h, count", f"(SELECT {tree}, i, i AS j, h, count")

    ctes += [level(f"l{k + 1}", f"l{k}", "tree") for k in range(lower)]
    ctes.append(f"u0 AS (SELECT 0 AS t, tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, h FROM l{lower})")
    ctes += [level(f"u{k + 1}", f"u{k}", "t") for k in range(upper)]
    # upwards from each leaf: its node at a level, the siblings there, and the fold
    ctes.append(
        f"p0 AS (SELECT l.doc_id, l.leaf, l.tree, l.i, u.i AS ui, u.h AS subroot, (SELECT h FROM u{upper}) AS root, '' AS proof, l.now AS f "
        "FROM l0 l JOIN u0 u ON l.tree IS NOT DISTINCT FROM u.tree)"
    )
    step = 0
    for kind, count, at, key, same in (("l", lower, "i", "tree", "s.tree IS NOT DISTINCT FROM p.tree"), ("u", upper, "ui", "t", "TRUE")):
        for k in range(count):
            runs = (
                f"(SELECT {key}, i // 8 AS r, list(h ORDER BY i) AS hs, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {kind}{k}) GROUP BY {key}, i // 8)"
            )
            before, after = f"array_to_string(hs[1:{at} % 8], '')", f"array_to_string(hs[{at} % 8 + 2:], '')"
            ctes.append(
                f"p{step + 1} AS (SELECT p.* REPLACE (CASE WHEN n > 1 THEN proof || {before} || {after} ELSE proof END AS proof, "
                f"CASE WHEN n > 1 THEN sha256({before} || f || {after}) ELSE f END AS f, CASE WHEN n > 1 THEN {at} // 8 ELSE {at} END AS {at}) "
                f"FROM p{step} p JOIN {runs} s ON {same} AND s.r = p.{at} // 8)"
            )
            step += 1
    return "WITH " + ",\n".join(ctes) + (
        f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM p{step}"
    )
