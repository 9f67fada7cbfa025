import pytest

LONG = "word " * 60_000 + "end"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, size int, key long, kept string, root long, quality_score string, id long, no_id string, digest string, crc int, cuts int, tie int, copies int, total int, rows int, nth int, copy int, _id string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and very long texts, ties, repeated rows and columns whose names clash."""
    good = "the quick brown fox jumps over the lazy dog and runs far away from the old stone house near a river"
    rows = [
        (1, good, "en", "b", 3), (2, None, None, None, None), (3, "", "en", "a", 0), (4, LONG, "en", "a", 9), (5, good, "en", "a", 1), (5, good, "en", "a", 1),
        (6, "one", None, "b", 3), (7, "one two", "en", None, 7), (None, "no id at all", "en", "a", 1), (None, good, "en", "c", 1), (8, good + " now", "de", "c", 5), (9, " é 日本 \U0001f600", "ja", "c", 5), (10, " \t\n ", "en", "c", 5),
    ]
    own = ("x", 1, 2, "k", 3, "q", 4, "n", "d", 5, 6, 7, 8, 9, 10, 11, 12, "i")
    return spark.createDataFrame([(*r, *own) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
