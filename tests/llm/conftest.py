import pytest

LONG = "lorem ipsum " * 20_000


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and ids, and columns in the way."""
    same = "One two three four five six seven eight nine ten. " * 5
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, "a"), (4, same, "en", None), (4, same, "en", None), (5, same, "de", "b"),
        (None, same, "en", "a"), (None, None, None, None), (6, "word", "en", "a"), (6, "other words here", "en", "a"), (7, LONG, "fr", "b"),
        (8, "naïve 日本語 😀 text\x00with odd​things", "ja", "c"), (9, "a" * 5000, "en", "c"),
    ]
    rows = [(i, t, la, so, -1, 7.5, "x", None, 3, "n") for i, t, la, so in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size double, hub string, said string, shard int, component string").repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
