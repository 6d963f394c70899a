"""Tables of hard rows for the tests of this folder."""

import random

import pytest

HARD = "doc_id long, text string, lang string, source string, n_chars long, uid long, row string, recipe string, low int, block int"


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and names that operators use inside."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(999)) for _ in range(30_000))
    texts = [None, "", " ", "a", "one two three four five six seven eight", "one  two\tthree four\nfive six seven eight", long, long + " tail", "x" * 40_000, "@" * 3000, "1" * 30_000, "é日本 \u0301 <|endoftext|> it's  we'll\n\n ok", "mail a.b@c.de and 1.2.3.4 or +1 (555) 555-1234"]
    rows = [(k if k % 5 else None, t, None if k % 3 else "en", None if k % 4 == 1 else "s", None, k, "r", "x", 1, 2) for k, t in enumerate(texts)]
    rows += rows[2:6] + [(7, "one two three four five six seven eight", None, None, 1, 1, None, None, None, None)]
    return spark.createDataFrame(rows, HARD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], HARD)
