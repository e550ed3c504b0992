import numpy as np
import pytest
import xxhash

from tablesight.llm import graph, simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return "0" * 16
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"


def plain_components(prints):
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 4 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def family_prints(n=60, each=8):
    draw = np.random.default_rng(5)
    out = []
    for base in draw.integers(-(2**63), 2**63 - 1, n):
        for _ in range(each):
            bits = draw.choice(64, draw.integers(0, 6), replace=False)
            out.append(int(base) ^ int(np.bitwise_or.reduce(np.left_shift(np.uint64(1), bits.astype(np.uint64)), initial=np.uint64(0)).view(np.int64)))
    return out


@pytest.mark.parametrize("tree", [simhash.TREE_NODES, 6])
def test_components_equal_brute_force(spark, monkeypatch, tree):
    """Also where shards are cut into parts, down to a few nodes a tree."""
    monkeypatch.setattr(simhash, "TREE_NODES", tree)
    prints = family_prints()
    found = simhash.classes(spark.createDataFrame(list(enumerate(prints)), "doc_id long, print long"))
    got = {r["print"]: r["component_id"] for r in found.collect()}
    assert [got[p] for p in prints] == plain_components([p & (2**64 - 1) for p in prints])


def test_search_of_a_hot_shard_joins_far_chains(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE_NODES", 10)
    chain = [(1 << i) - 1 for i in range(0, 61, 3)]
    found = simhash.classes(spark.createDataFrame([(i, p) for i, p in enumerate(chain)], "doc_id long, print long"))
    assert {r["component_id"] for r in found.collect()} == {0}


def test_edge_rows(edge, nothing):
    rows = simhash.near_duplicates(edge).collect()
    texts = {r["doc_id"]: r["text"] for r in edge.collect() if r["doc_id"] is not None}
    assert len(rows) == 9 and all(r["fingerprint"] == plain_fingerprint(texts[r["doc_id"]]) for r in rows if r["doc_id"] is not None)
    component = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
    assert component[5, plain_fingerprint(texts[5])] == 1 and component[None, "0" * 16] == 2 and component[6, "0" * 16] == 2
    kept = simhash.without_near_duplicates(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.without_near_duplicates(nothing).count() == 0


def test_near_copies_link_and_others_do_not(spark):
    words = [f"w{i}" for i in range(400)]
    other = [f"v{i}" for i in range(400)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:399], "changed"])), (3, " ".join(other)), (4, " ".join(words).upper())]
    rows = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in rows} == {**{i: 0 for i in range(1, 41)}, 101: 100, 200: 100}
