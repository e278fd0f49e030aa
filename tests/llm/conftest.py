import pytest

LONG = "verylongword" * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty, long and repeated texts, and columns named like those operators add."""
    texts = [
        (1, "one two three four five six seven"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, "one two three four five six seven"),
        (7, "Straße, naïve café — 漢字 text\n\n  with  odd   spaces\n"), (8, "a"), (None, "no id at all here, none"), (9, LONG + " end"),
        (1, "one two three four five six seven"), (10, "x" * 49), (11, "x" * 50), (12, "x" * 200),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept string, score string, starts string, item string"
    return spark.createDataFrame([(i, t, "en" if i != 3 else None, None, len(t or ""), "i", "k", "s", "st", "it") for i, t in texts], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
