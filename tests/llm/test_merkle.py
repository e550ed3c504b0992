"""The manifest against a tree built in one place, for sizes around runs and superblocks."""

import zlib
from hashlib import sha256

import pytest

from tablesight.llm import merkle
from tests.llm.conftest import SCHEMA


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def proofs(nodes):
    """What remains of ``nodes``, and each one's (place, siblings) level by level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // 8 * 8 : a // 8 * 8 + 8]
            steps[i].append((a % 8, run[: a % 8] + run[a % 8 + 1 :]))
        nodes = [digest("".join(nodes[a : a + 8])) for a in range(0, len(nodes), 8)]
        at = [a // 8 for a in at]
    return nodes[0], steps


def expected(rows):
    by_lang = {}
    for doc, text, lang, source, n in rows:
        small = text.translate({c: c + 32 for c in range(65, 91)}) if text is not None else None
        altered = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        now = (doc, source, lang, n, small if altered else text)
        by_lang.setdefault(lang, []).append((doc, leaf((doc, source, lang, n, text)), leaf(now)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = proofs([r[1] for r in by_lang[lang]])
    root, upper = proofs([trees[x][0] for x in langs])
    out = []
    for lang, above in zip(langs, upper):
        for (doc, was, now), own in zip(by_lang[lang], trees[lang][1]):
            node = now
            for place, others in own + above:
                node = digest("".join([*others[:place], node, *others[place:]]))
            proof = digest("".join("".join(others) for _, others in own + above))
            out.append((doc, was, trees[lang][0], root, proof, node, node == root))
    return sorted(out, key=lambda r: [(x is None, x) for x in r])


def got(docs):
    return sorted((tuple(r) for r in merkle.tamper_check(docs).collect()), key=lambda r: [(x is None, x) for x in r])


def test_many_sizes_of_languages(spark):
    sizes = {"en": 600, "de": 513, "fr": 8, "é": 9, "z": 1, None: 65}
    rows = [(i * 7 + j, f"Text {i} of {lang}", lang, None if i % 5 else "S", i) for j, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    found = got(spark.createDataFrame(rows, SCHEMA))
    assert found == expected(rows)
    assert 0 < sum(not r[-1] for r in found) < len(rows) / 2


@pytest.mark.parametrize("rounds", [1, 2])
def test_small_superblocks_take_more_rounds(spark, monkeypatch, rounds):
    monkeypatch.setattr(merkle, "LEVELS", rounds)
    monkeypatch.setattr(merkle, "SPAN", 8**rounds)
    rows = [(i, f"A {i}", f"l{i % 9 if i < 90 else 0}", "s", i) for i in range(180)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_one_row_is_its_own_root(spark):
    rows = [(3, "Only", "en", "s", 4)]
    (row,) = got(spark.createDataFrame(rows, SCHEMA))
    assert row[1] == row[2] == row[3] and row[4] == digest("") and [row] == expected(rows)


def test_edge_rows(edge, nothing):
    rows = [tuple(r)[:5] for r in edge.collect()]
    assert got(edge) == expected(rows)
    assert got(nothing) == []
