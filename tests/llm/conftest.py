import pytest

LONG = "the quick brown fox jumps over the lazy dog " * 5_000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and white texts, repeated rows, a very long text, and columns whose names operators use themselves."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "Hello world"), (4, "Hello world"), (5, "hello   world"), (6, LONG), (7, LONG), (8, "ü"), (9, "12 34"), (10, "one two three four five six seven"),
            (11, "one two three four five six seven"), (12, "one two three four five six eight")]
    extra = [(i, t, None if i % 3 else "en", "s", None if t is None else len(t), "x", 1.0, 2) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars int, key string, score double, kept int")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
