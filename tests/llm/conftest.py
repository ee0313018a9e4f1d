import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _n int, bucket int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, ties, one long text, columns that clash with inner names."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    near = base.replace("upsilon", "upsilon phi")
    rows = [
        (1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, near, None, None), (4, "", "de", "b"), (5, None, "de", "b"), (6, " \n\t ", None, "a"), (7, "one two", "fr", "a"), (8, "One Two", "fr", "b"),
        (9, "12 !! ..", "fr", "b"), (None, base, "en", "a"), (None, None, None, None), (7, "one two", "fr", "a"), (10, "x" * 200_000 + " " + "long tail of words " * 20_000, "en", "c"), (11, "é" * 50 + " <|endoftext|> Σ ς", "es", "c"), (12, base + " idiot", "en", "c"),
    ]
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "clash", 3, 4) for i, t, la, s in rows], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
