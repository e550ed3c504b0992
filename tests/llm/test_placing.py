import hashlib
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tablesight.llm import knn, sharding, sketch, url_reputation


def plain_sketch(text, words=5, scale=8):
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    chain = lambda hs: __import__("functools").reduce(lambda seed, h: xxhash.xxh64_intdigest(struct.pack("<Q", h), seed), hs, 42)
    if not hashed:
        return []
    found = {chain(hashed[i : i + words]) for i in range(max(1, len(hashed) - words + 1))}
    signed = sorted(struct.unpack("<q", struct.pack("<Q", h))[0] for h in found)
    low = [h for h in signed if h < -(2**63) + 2**64 // scale]
    return low or signed[:1]


def test_sketches_equal_brute_force(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3, "", "short text", None, "ä " * 30, "x y z\tu\nv w a b c d e f g h i j", "one"]
    docs = [(10 * i + 7, t) for i, t in enumerate(texts)]
    rows = {r["doc_id"]: r for r in sketch.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    code = lambda hs: ",".join(f"{h & (2**64 - 1):016x}" for h in hs)
    for i, (doc, text) in enumerate(docs):
        own, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        part = len(own) // 4
        edited = own[: len(own) - part] + after[:part]
        a, b, n = plain_sketch(own), plain_sketch(edited), plain_sketch(after)
        like = lambda p, q: len(set(p) & set(q)) / min(len(p), len(q)) if p and q else float(len(p) == len(q))
        r = rows[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (code(a), code(b))
        assert (r["near_edited"], r["near_next"]) == (like(a, b), like(a, n))


def test_sketch_edges(edge, nothing):
    rows = sketch.edited_fingerprints(edge).collect()
    assert len(rows) == 9 and sketch.edited_fingerprints(nothing).count() == 0
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 5)}) == 1
    plan = sketch.edited_fingerprints(edge)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))


def test_sketches_merge(spark):
    a, b = "a b c d e f g h i j k l m n", "o p q r s t u v w x y z"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    union = df.select(sketch.merged(F.concat(sketch.sketch(F.col("a")), sketch.sketch(F.col("b")))).alias("u")).first()["u"]
    low = [h for h in {*plain_sketch(a), *plain_sketch(b)} if h < -(2**63) + 2**61]
    assert union == sorted(low) or (not low and len(union) == 1)


def check_law(rows, shards=8):
    counts = {}
    for r in rows:
        counts.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(counts.get(s, ())) for s in range(shards)]
    assert set(counts) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in counts.values())


def test_shards_are_even_and_keep_copies_together(spark):
    draw = np.random.default_rng(2)
    texts = [f"group {g}" for g in range(60) for _ in range(int(draw.integers(2, 6)))] + ["giant"] * 150 + [f"single {i}" for i in range(203)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    rows = sharding.shard_documents(docs).collect()
    check_law(rows)
    at = {}
    for r in rows:
        at.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert sum(len(s) > 1 for t, s in at.items() if t != "giant") <= 3 and len(at["giant"]) < 8


def test_shards_of_all_linked_rows_stay_even(spark):
    docs = spark.createDataFrame([(i, f"pair {i // 2}") for i in range(400)], "doc_id long, text string")
    rows = sharding.shard_documents(docs).collect()
    check_law(rows)
    at = {}
    for r in rows:
        at.setdefault(r["doc_id"] // 2, set()).add(r["shard"])
    assert sum(len(s) > 1 for s in at.values()) <= 30


def test_shard_edges(edge, nothing):
    rows = sharding.shard_documents(edge).collect()
    check_law(rows)
    assert len(rows) == 9 and {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert sharding.shard_documents(nothing).count() == 0
    plan = sharding.shard_documents(edge)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))


def plain_top(vectors, queries, k=5):
    out = set()
    for q in queries:
        if q in vectors:
            ranked = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(ranked, 1)}
    return out


def test_top_k_equals_brute_force(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(5, 8))
    points = [centres[i % 5] + 0.1 * draw.normal(size=8) for i in range(300)]
    points[20:60] = [points[20]] * 40
    rows = [(i, [float(x) for x in p], "x") for i, p in enumerate(points)]
    rows += [(900, None, "x"), (901, [1.0, None], "x"), (902, [float("nan")] * 8, "x"), (903, [float("inf")] * 8, "x"), (None, [1.0] * 8, "x"), (904, [2.0, 3.0], "x"), (905, [], "x"), (3, rows[3][1], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    ask = spark.createDataFrame([(i,) for i in (0, 20, 40, 41, 100, 299, 900, 904, 905, None, 7777)], "vec_id long")
    vectors = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    got = [tuple(r) for r in knn.top_k(table, ask, pivots=3).collect()]
    assert set(got) == plain_top(vectors, (0, 20, 40, 41, 100, 299, 904, 905)) and len(got) == 8 * 5


def test_top_k_small_and_empty(spark):
    table = spark.createDataFrame([(0, [1.0]), (50, [-1.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in knn.top_k(table, table).collect()} == {(0, 1, 50, -65536), (50, 1, 0, -65536)}
    assert knn.top_k(table, table.where("false")).count() == 0 and knn.top_k(table.where("false"), table).count() == 0


def test_large_components_are_exact():
    a = np.array([[2.0**30, 3.0]])
    assert knn._scores(a, np.array([[2.0**30 - 1, 1.0]])).tolist() == [[2**30 * (2**30 - 1) + 3]]


URLS = [
    ("https://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("http://a.example.com/fr/1", "a.example.com", "/fr/1", "com/", "allow"),
    ("http://b.net/es/", "b.net", "/es/", "net/es/", "block"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("x.com/en/", "", "", None, "allow"),
    ("http://com", "com", "", None, "allow"),
    ("http://É.org#/en/", "É.org", "", None, "allow"),
    ("a\nb://c.net/fr/?x=://d.com/", "c.net", "/fr/", "net/fr/", "block"),
    (None, "", "", None, "allow"),
]


def test_rules_and_parts_of_urls(spark):
    pages = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, mean string")
    none = spark.createDataFrame([], "page_id long, good int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.judge(pages, none).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert url_reputation.judge(pages.where("false"), none).count() == 0


def test_reputation_shrinks_towards_the_domain(spark):
    rows, labels, n = [], [], 0
    for host, good, bad in (("a.bad.org", 2, 60), ("b.bad.org", 1, 0), ("c.good.org", 60, 2), ("d.good.org", 0, 1), ("e.bad.org", 0, 0), ("f.new.org", 0, 0)):
        for outcome in [1] * good + [0] * bad + [None]:
            rows.append((n, f"http://{host}/p"))
            labels.append((n, outcome))
            n += 1
    pages, outcomes = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")
    got = {r["host"]: r for r in url_reputation.judge(pages, outcomes, rules=[("allow", "zzz/")]).collect()}
    means = {h: r["reputation"] for h, r in got.items()}
    assert means["a.bad.org"] < means["e.bad.org"] <= means["b.bad.org"] < means["f.new.org"] < means["d.good.org"] < means["c.good.org"]
    assert got["a.bad.org"]["verdict"] == "block" and got["c.good.org"]["verdict"] == "allow" and got["f.new.org"]["verdict"] == "allow"


def test_a_page_counts_once_however_often_it_is_repeated(spark):
    pages = [(i, f"http://h{i % 7}.example.com/x") for i in range(60)]
    labels = [(i, int(i % 7 > 2)) for i in range(40)]
    once = judged(spark, pages, labels)
    many = judged(spark, pages + pages[:1] * 49, labels + labels[:1] * 39 + [(1, 1)])
    assert set(many) == set(once) and len(many) == len(pages) + 49
    long = judged(spark, [(1, "http://a.b/" + "x" * 100_000), (2, None), (None, "http://a.b/")], [])
    assert len(long) == 3


def judged(spark, pages, labels):
    frame = spark.createDataFrame(pages, "page_id long, url string")
    return [tuple(r) for r in url_reputation.judge(frame, spark.createDataFrame(labels, "page_id long, good int")).collect()]
