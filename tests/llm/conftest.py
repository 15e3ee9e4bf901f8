"""Small document tables with the cases that every operator must take."""

import random

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, shard int, rid bigint, key binary,"
    " node int, n_words string, size string, host string, cls string, label string, score string, tokens string, rate double"
)
EXTRA = (True, 1, 7, b"k", 3, "x", "y", "h", "c", "l", "s", "t", 0.5)


def frame(spark, rows):
    """Documents (doc_id, text[, lang, source]) beside columns that clash with the operators' own names."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s0")), None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame([(*r, *EXTRA) for r in full], SCHEMA)


def word(i):
    return "w" + str(i).translate(str.maketrans("0123456789", "abcdefghij"))


def sentence(rng, n, words=400):
    return " ".join(word(rng.randrange(words)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows and ids."""
    rng = random.Random(5)
    body = sentence(rng, 60)
    rows = [
        (1, body, "en", "s0"), (2, body, None, "s0"), (3, body + " tail", "en", None), (4, None, None, None), (5, "", "en", "s1"),
        (6, " \t\n", "de", "s1"), (7, "one", "de", "s1"), (8, sentence(rng, 12_000), "en", "s1"), (9, "é" * 300, "fr", "s1"),
        (None, sentence(rng, 30), "en", "s0"), (None, None, "en", "s0"), (10, "a" * 700, "en", "s0"),
    ]
    return [*rows, rows[0], rows[0], (3, "another text under a known id", "en", "s0")]
