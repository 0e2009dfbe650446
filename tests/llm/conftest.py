import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, prefix array<long>, cls string, _d int, c int, topic_hint string"
LONG = " ".join(f"word{i} of the long text." for i in range(4000))
PASSAGE = "the same passage of more than fifty words " * 6
ODD = [
    (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, LONG, "en", None, None), (4, "tie one two three four five", "de", "s", 1),
    (5, "tie one two three four five", "de", "s", 1), (6, PASSAGE + "\nmine\n" + PASSAGE, "fr", "t", 1), (6, PASSAGE + "\nmine\n" + PASSAGE, "fr", "t", 1), (7, "x\n" + PASSAGE, "fr", "t", 1),
    (8, "é ü \U0001f600 ́ a", "es", "t", 1), (9, "\n\n \n", None, "t", 1), (None, "a b c d e f g", "en", "s", 1), (10, "w", "en", "s", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns whose names clash."""
    return spark.createDataFrame([(*r, [1], "x", 7, 8, None) for r in ODD], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
