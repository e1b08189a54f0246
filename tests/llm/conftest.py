import pytest

LONG = "Lorem ipsum dolor sit amet consectetur. " * 4000

#: (doc_id, text): null and empty texts, white space, one word, marks only, repeated rows and ids, a null id, a very long text.
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "!!! ... 123"), (6, "the same text here"), (6, "the same text here"), (7, "the same text here"), (6, "another text of that id"), (None, "text without an id"), (None, None), (8, LONG), (9, "ÀÉ ß 中文 😀 \u0000 \u00a0x")]


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows with extra columns whose names clash with those that operators make."""
    extra = "score double, ids string, fp string, kept string, row string, s string, p string, n_words string, lang string, source string, n_chars bigint, words string, hits string, text2 string"
    rows = [(i, t, 0.5, "ids", "fp", "kept", "row", "s", "p", "nw", "xx" if k % 2 else None, "src", 3, "w", "h", "t") for k, (i, t) in enumerate(EDGES)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {extra}")


@pytest.fixture(scope="session")
def empty(spark, edges):
    return spark.createDataFrame([], edges.schema)
