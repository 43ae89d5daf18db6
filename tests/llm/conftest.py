import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, size string, fp string, rank double, key string, h long"


def rows(texts):
    """Documents with further columns, some with the names that operators use inside."""
    return [(i, t, lang, source, 0, 7, "r", "s", "f", 0.5, "k", 3) for i, t, lang, source in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty and long texts, ties and repeated rows."""
    base = "the quick brown fox jumps over the lazy dog and runs away from here to there again and again"
    texts = [
        (1, base, "en", "b"), (2, base, "en", "b"), (2, base, "en", "b"), (3, base + " now", None, None), (4, None, None, None), (5, "", "en", "a"), (6, "  \t\n ", "de", "a"), (7, "one", "en", "c"),
        (8, "word " * 30_000, "en", "c"), (9, "1234 !!! ???", None, "a"), (10, "x" * 5000, "de", "b"), (11, "Über Äpfel und Öl", "de", "a"), (None, base, "en", None), (12, "ONE", "en", "é"),
    ]
    return spark.createDataFrame(rows(texts) + [(None,) * 12], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
