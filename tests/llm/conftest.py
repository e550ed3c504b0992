import pytest

#: Rows that every operator on documents must bear: nulls, empty and long texts, ties, repeats.
EDGE = [
    (1, "one two three four five six seven", "en", "a", 33),
    (2, None, "en", "a", None),
    (3, "", None, "b", 0),
    (4, "wörter und ähnliches " * 20_000, "de", None, 420_000),
    (5, "one two three four five six seven", "en", "a", 33),
    (5, "one two three four five six seven", "en", "a", 33),
    (6, " \n\t ", "fr", "b", 4),
    (None, "a text without an id", None, None, None),
    (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows with extra columns whose names operators might use themselves."""
    docs = spark.createDataFrame(EDGE, SCHEMA)
    return docs.selectExpr("*", *[f"'x' as {c}" for c in EXTRA])


EXTRA = ("score", "print_0", "rank_0", "cell_0", "odds_0", "clean_0", "item", "kind", "shard", "row", "fingerprint", "component_id", "ids")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
