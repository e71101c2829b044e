import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def plain(docs):
    """The documents as (doc_id, text, source) in order of doc_id."""
    return sorted((r.doc_id, r.text or "", r.source) for r in docs.collect())


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, row string, key int, block int, size int, token string"


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named as the operators' own."""
    extra = ("x", "y", 1, 2, 3, "z")
    rows = [
        (1, "one two three four five six seven", "en", "a", 33, *extra),
        (1, "one two three four five six seven", "en", "a", 33, *extra),
        (2, "one two three four five six seven", None, None, None, None, None, None, None, None, None),
        (3, None, "en", "a", None, *extra),
        (4, "", "en", "b", 0, *extra),
        (5, " \t\n ", "en", "b", 4, *extra),
        (None, "one two three four five six seven", "en", "a", 33, *extra),
        (None, None, None, None, None, None, None, None, None, None, None),
        (6, "word " * 30_000 + "\n" + "line\n" * 2_000, "de", "b", 160_000, *extra),
        (7, "é" * 60_000, "fr", "c", 60_000, *extra),
        (8, "x@y.zz 1.2.3.4 " * 3, "fr", "c", 45, *extra),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
