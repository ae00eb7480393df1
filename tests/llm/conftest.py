import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(60)] + ["Ünï", "ÉCOLE", "x.", "(y)", "it's", "the", "The", "THE"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward_rows():
    """Null, empty, blank, tiny and very long texts; ties, repeated rows, null ids; copies and shared lines."""
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "a b c d"), (None, "no id here at all"), (7, "\n\n"), (8, "x\x0bweird\x1cspace　here end")]
    base = prose(rng, 80)
    rows += [(10 + i, base) for i in range(12)]
    rows += [(30 + i, base + f" extra{i}") for i in range(6)]
    rows += [(40 + i, f"Shared LINE here\n{prose(rng, 30)}\n  shared line HERE \t\n") for i in range(12)]
    rows += [(60 + i, prose(rng, rng.randint(1, 60))) for i in range(30)]
    rows += [(99, prose(rng, 30000)), (100, "word " * 5000)]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCUMENTS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture
def clashing(awkward):
    """Extra columns with names that the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["score", "n_lines", "n_dropped", "n_hit", "n_words", "spans", "items", "t", "c0", "id", "node", "label", "keys", "length", "part", "__y"]
    return awkward.select("*", *(F.lit(1).alias(n) for n in names))


@pytest.fixture
def far_words():
    return WORDS
