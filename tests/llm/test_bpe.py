"""Ids and texts against the library as it loads."""

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablesight.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


PARTS = ["a", "word", "1", "!", " ", "  ", "\n", "\t", "'s", "'LL", "<|endoftext|>", "<|endoftext|", "　", "\x85", "é", "é", "字", "🙂", "՘", "࢏"]


def mixed(rng):
    any_character = lambda: chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)]))
    return "".join(rng.choice(PARTS) if rng.random() < 0.8 else any_character() for _ in range(rng.randint(0, 120)))


def test_words_are_what_the_library_encodes_one_by_one(library):
    rng, split = random.Random(2), bpe.Splitter("byte_bpe_50k")
    for _ in range(400):
        text = mixed(rng)
        words = split(text)
        assert "".join(words) == text
        assert [i for w in words for i in library.encode(w, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids


def test_classes_agree_below_the_common_bound(library):
    split = bpe.Splitter("byte_bpe_50k")
    below = {chr(c) for c in range(1, ord(bpe.COMMON) + 1)}
    split._learn(below)
    assert not split.swaps


def key(row):
    return [(x is None, x) for x in row]


@pytest.mark.parametrize("block_words", [50, bpe.BLOCK_WORDS])
def test_round_trip(spark, library, block_words):
    rng = random.Random(4)
    rows = [(i, mixed(rng)) for i in range(150)] + [(7, "again"), (7, "again"), (None, "no id"), (200, None), (201, "x" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_tokens, list(r.ids), r.decoded) for r in bpe.round_trip(docs, block_words=block_words).collect()), key=key)
    ids = [(doc, library.encode(text or "", add_special_tokens=False).ids) for doc, text in rows]
    assert got == sorted(((doc, len(x), x, library.decode(x, skip_special_tokens=False)) for doc, x in ids), key=key)
    digest = lambda x, text: (sha256(np.array(x, "<u4").tobytes()).hexdigest(), sha256(text.encode()).hexdigest())
    short = sorted((tuple(r) for r in bpe.round_trip(docs, digests=True, block_words=block_words).collect()), key=key)
    assert short == sorted(((doc, n, *digest(x, text)) for doc, n, x, text in got), key=key)


def test_decode_of_any_ids(spark, library):
    rng = random.Random(6)
    rows = [(i, [rng.randrange(50_257) for _ in range(rng.randint(0, 40))]) for i in range(60)] + [(3, [50_256]), (None, [72])]
    got = sorted((tuple(r) for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()), key=key)
    assert got == sorted(((doc, library.decode(ids, skip_special_tokens=False)) for doc, ids in rows), key=key)
    odd = spark.createDataFrame([(1, None), (2, [72, 60_000, 72])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, bpe.decode(odd).collect())) == [(1, ""), (2, "ii")]


def test_edge_rows(spark, edge, nothing, library):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = sorted(((r.doc_id, r.n_tokens, r.decoded) for r in bpe.round_trip(edge).collect()), key=key)
    assert got == sorted(((doc, len(library.encode(text or "", add_special_tokens=False).ids), text or "") for doc, text in rows), key=key)
    assert bpe.round_trip(nothing).collect() == []
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in bpe.round_trip(blank).collect()) == [(1, 0, ""), (2, 0, "")]
