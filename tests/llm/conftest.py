import pytest

LONG = " ".join(f"word{i % 997}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every awkward case, and extra columns whose names clash with results."""
    base = " ".join(f"tok{i}" for i in range(120))
    rows = [(0, base, "en", "a", 1, "x"), (1, base, "en", "a", 2, "x"), (2, None, None, None, 3, None),
            (3, "", "en", None, 4, "x"), (4, " \n\t\n", "en", "b", 5, "x"), (5, LONG, "de", "b", 6, "x"),
            (6, "ünï cödé " * 30, "fr", "c", 7, "x"), (7, base, "en", "a", 8, "x"), (7, base, "en", "a", 8, "x"),
            (None, "an id is missing here", "en", "a", 9, "x"), (8, "short", "en", "a", 10, "x"),
            (9, base.replace("tok60", "other"), "en", "a", 11, "x")]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_words long, decon string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
