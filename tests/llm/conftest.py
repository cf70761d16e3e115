import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "vo", "sha", "ne") for b in ("n", "r", "st", "l", "nd", "p", "q", "z")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, _key string, value double"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def paragraphs(rng, lines, words=12):
    return "\n".join(sentence(rng, words) for _ in range(lines))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, a repeated id, and clashing further columns."""
    rng = random.Random(5)
    long = paragraphs(rng, 4000)
    base = paragraphs(rng, 20)
    rows = [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (3, base + "\nmore of it here", "de", "b", 5),
        (4, None, "en", "a", None),
        (5, "", None, None, 0),
        (6, " \n\t ", "fr", "b", 4),
        (7, "one", "fr", "null", 3),
        (8, long, "en", "a", len(long)),
        (9, sentence(rng, 4), "en", "c", 1),
        (9, sentence(rng, 40), "en", "c", 1),
        (None, sentence(rng, 30), None, "c", None),
        (None, None, None, None, None),
        (10, "Ünïcode 漢字 text\x0bwith odd spaces 😀 " * 3, "xx", "d", 7),
        (11, "Ab cD\r\nef", "en", "d", 9),
        (11, "Ab cD\r\nef", "en", "d", 9),
    ]
    return [(*r, 1, "k", 0.5) for r in rows]


@pytest.fixture()
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], SCHEMA)
