import random

import pytest

EXTRA = "label string, f long, node long, n long, digest string, words string, anchor long, row long"


@pytest.fixture
def docs(spark):
    """documents-like rows with further columns whose names operators use themselves."""

    def build(*rows):
        extra = ("x", 1, 2, 3, "d", "w", 4, 5)
        return spark.createDataFrame(
            [(i, text, lang, "src", *extra) for i, text, lang in (r if len(r) == 3 else (*r, "en") for r in rows)],
            f"doc_id long, text string, lang string, source string, {EXTRA}",
        )

    return build


@pytest.fixture
def prose():
    """Repeatable invented words."""

    def build(n, seed, size=400):
        rng = random.Random(seed)
        return [f"w{rng.randrange(size)}" for _ in range(n)]

    return build


ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "One"), (4, "One"), (None, "null id"),
    (5, "ONE"), (6, "É one"), (7, "é one"), (8, "x" * 200_000), (9, "two words"),
]


@pytest.fixture
def odd():
    return ODD
