from pyspark.sql import functions as F

from tablesight.llm import queries, sketch
from test_placing import plain_sketch


def whole(text):
    return plain_sketch(text, scale=1)


def plain_near(a, b, scale, least):
    """Containment of whole hash sets up to the higher bound of the two."""
    limit = -(2**63) + 2**64 // scale - 1
    top = max(max(limit, h[least - 1] if len(h) >= least else 2**63 - 1) for h in (a, b))
    p, q = ({x for x in h if x <= top} for h in (a, b))
    return len(p & q) / min(len(p), len(q)) if p and q else float(len(p) == len(q))


def test_short_texts_are_seen_in_long_ones(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(900))
    texts = [" ".join(f"w{i}" for i in range(at, at + n)) for at, n in ((5, 12), (100, 9), (300, 40), (500, 5))]
    docs = [x for t in texts for x in (t, long)] + ["short words of no other text at all", "a b c", None, ""]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op10_threshold_sketch(spark, str(tmp_path)).collect()}
    assert [rows[i]["near_next"] for i in range(7)] == [1.0] * 7 and rows[8]["near_next"] == 0.0
    for i, text in enumerate(docs):
        after = docs[(i + 1) % len(docs)] or ""
        own = text or ""
        edited = own[: len(own) - len(own) // 4] + after[: len(own) // 4]
        a, b, n = whole(own), whole(edited), whole(after)
        assert rows[i]["near_next"] == plain_near(a, n, 4, 16) and rows[i]["near_edited"] == plain_near(a, b, 4, 16)
        low = [h for h in a if h < -(2**63) + 2**62]
        kept = low if len(low) >= 16 else a[:16]
        assert rows[i]["fingerprint"] == ",".join(f"{h & (2**64 - 1):016x}" for h in kept)


def test_rows_of_one_id_each_find_the_next_text(spark):
    long = " ".join(f"w{i}" for i in range(400))
    docs = [(1, long), (1, "w7 w8 w9 w10 w11 w12"), (2, long + " end")]
    rows = sketch.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), scale=4, least=16).collect()
    assert {(r["doc_id"], r["n_chars"]): r["near_next"] for r in rows if r["doc_id"] == 1}[1, len(docs[1][1])] == 1.0


def test_sketches_with_a_least_size_merge(spark):
    a, b = "a b c d e f g h i j k l m n", " ".join(f"v{i}" for i in range(300))
    parts = [sketch.sketch(F.col(c), scale=4, least=16) for c in "ab"]
    union = spark.createDataFrame([(a, b)], "a string, b string").select(sketch.merged(F.concat(*parts), 4, 16)).first()[0]
    assert union == [h for h in sorted({*whole(a), *whole(b)}) if h < -(2**63) + 2**62]
