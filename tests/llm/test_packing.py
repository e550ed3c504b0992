import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tablesight.llm import packing


def check_places(rows, limit=1024):
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        assert sum(n for _, n in places) <= limit
    return len(at)


def test_pieces_hold_the_tokenizers_ids(spark):
    texts = ["", "a b", "Äöü ñ  x\n\n y!! <|endoftext|>", "word " * 3000, "\x00퟿", "x" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in packing.packed_documents(docs, keep_ids=True).orderBy("doc_id", "piece").collect():
        own = got.setdefault(r["doc_id"], [])
        assert r["start"] == len(own) and r["length"] == len(r["ids"]) and (r["piece"] == 0 or r["length"] == 1024)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        own += r["ids"]
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_edge_rows_are_packed_whole(edge, nothing):
    rows = packing.packed_documents(edge).collect()
    check_places(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows if r["piece"] == 0 and r["doc_id"] is not None) == [(False, i) for i in (1, 2, 3, 4, 5, 5, 6)]
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert packing.packed_documents(nothing).count() == 0


def test_few_sequences_beyond_the_lower_bound(spark):
    draw = np.random.default_rng(3)
    for lengths in (draw.integers(1, 1025, 3000), draw.integers(1, 12, 6000), np.full(999, 342), np.full(500, 513), [1024] * 5 + [1, 1023]):
        items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "item long, length long")
        rows = packing.best_fit(items).collect()
        assert sorted(r["item"] for r in rows) == list(range(len(lengths)))
        used = {}
        for r in rows:
            used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
        assert max(used.values()) <= 1024
        each = 1024 // int(min(lengths)) if len(set(lengths)) == 1 else None
        least = -(-len(lengths) // each) if each else -(-int(sum(lengths)) // 1024)
        assert len(used) <= least * 1.02 + 2
