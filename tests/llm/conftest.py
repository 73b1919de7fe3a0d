"""Small tables with the cases that every operator has to take."""

import random

import pytest

SMALL = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, print long, uid long, score double, blob string, row int"


def odd_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "er", "on", "é", "ñ", "an"]) for _ in range(rng.randint(1, 4)))
    long_text = " ".join(word() for _ in range(30_000))
    plain = " ".join(word() for _ in range(300))
    near = plain.replace(" ", "  ", 5)
    texts = [None, None, "", "", " \n\t", plain, plain, near, long_text, "one", "One", "a b", "token=abcdefgh1 " + plain, "漢字 œuvre ’tis İ ΑΣ", "\x00\x1c\x85 x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, plain), (9, "other words of the same id"), (None, plain), (None, "no id"), (None, None)]
    return [(i, t, "en", "s", 1, 2, 3, 0.5, "b", 4) for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and ids, and columns with clashing names."""
    return spark.createDataFrame(odd_rows(), DOC_SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
