import pytest

LONG = "word " * 60_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, very long ones, repeated rows, and extra columns whose names operators use inside."""
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG + "end."), (5, "Plain words that say nothing much."), (5, "Plain words that say nothing much."), (6, "x" * 5000), (7, "Ünïcode – “quotes” 漢字 \U0001f600"), (None, "no key here")]
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, "r") for i, t in rows], "doc_id long, text string, lang string, source string, n int, id int, _row string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
