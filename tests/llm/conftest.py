import pytest

LONG = "word, " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators might use."""
    rows = [(1, "plain words of a text that goes on", "en", "b", 5, 0), (2, None, "en", "b", None, 0), (3, "", None, None, 0, 1),
            (4, LONG, "en", "a", 1, 2), (5, "plain words of a text that goes on", "fr", "ü", 5, 3), (5, "plain words of a text that goes on", "fr", "ü", 5, 3),
            (None, "no id here\nbut two lines", "en", "a", 3, 4), (7, "  \n\t ", "en", "a", 3, 4), (8, "one", "en", "Z", 3, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int")


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    """The odd rows with columns named like the operators' own."""
    clash = {"score": "double", "spans": "string", "base_spans": "int", "fp": "string", "_row": "int", "copies": "string", "component_id": "date", "_base": "int"}
    return odd_docs.selectExpr("*", *[f"CAST(NULL AS {t}) AS {n}" for n, t in clash.items()])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
