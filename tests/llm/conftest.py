import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sa") for b in ("ton", "vel", "dor", "sin", "pa", "er", "li")]


@pytest.fixture(scope="session")
def prose():
    """Made-up text of so many words, the same for the same number."""

    def make(n, seed=0):
        r = random.Random(f"{n}:{seed}")
        return " ".join(r.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def nasty(prose):
    """(doc_id, text, source): nulls, empty and very long texts, blanks only, ties and repeated rows."""
    long = prose(30_000, 1)
    return [
        (1, prose(80, 2), "a"), (2, prose(80, 2), "a"), (2, prose(80, 2), "a"), (3, None, "b"), (4, "", "b"), (5, " \t\n\x0b ", None),
        (6, long, "a"), (7, "one", None), (8, "one two", "c"), (None, prose(60, 3), "c"), (None, None, None), (9, long, "b"),
        (10, "Überß naïve    x\x1cy \U0001f600 z", "c"), (11, "x " * 400, "a"), (12, "A\nB\n\nA\nB\n", "b"),
    ]


@pytest.fixture(scope="session")
def documents(spark):
    """A table like `documents`, with more columns whose names clash with those that operators use."""

    def make(rows):
        more = "key long, mark long, size string, taken string, _mark int, _spans string, fingerprint string, kept int, _words string"
        schema = f"doc_id long, text string, source string, {more}"
        return spark.createDataFrame([(*r, 1, 2, "s", "t", 3, "u", "f", 4, "w") for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def ids(nasty):
    return sorted((r[0] for r in nasty), key=lambda i: (i is None, i))


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0], str(r)))
