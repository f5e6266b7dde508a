import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows, a very long text, and columns with clashing names."""
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
    near = " ".join(f"a{i}" for i in range(60))
    rows = [
        (1, near, "en", "s1"), (2, near + " tail", "en", "s1"), (3, None, None, None), (4, "", "en", "s2"), (5, " \n\t ", "fr", "s2"), (6, long, "fr", None), (6, long, "fr", None),
        (None, near, "en", "s1"), (7, "one two", None, ""), (8, "One TWO", "de", "s3"), (9, "x" * 70_000, "de", "s3"), (10, near.upper(), "en", "s1"),
    ]
    rows = [(*r, 0, "b", "t", "k", "i") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bands string, token string, _key string, item_id string")
