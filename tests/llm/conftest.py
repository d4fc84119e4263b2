import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, _id long, _tie string, taken string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash with helpers."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    long = text(6000)
    shared = text(70)
    rows = [
        (1, text(200), "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n ", "en", None), (5, long, "en", "a"),
        (6, long, "en", "b"), (7, text(30) + " " + shared + " " + text(20), "de", "a"), (8, shared + "\n" + text(10), "de", None),
        (8, shared + "\n" + text(10), "de", None), (9, text(60), None, "c"), (None, text(80), "en", "a"), (None, None, None, None),
        (10, "word", "en", "z"), (11, "word", "en", "z"), (11, "word", "en", "z"), (12, "!!! ... 123", "de", "a"),
    ]
    return spark.createDataFrame([(*x, len(x[1]) if x[1] else None, "h", 7, "t", "x") for x in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
