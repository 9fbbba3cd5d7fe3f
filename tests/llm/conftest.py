import random

import pytest

WORDS = "the of and in to river stone light paper house green seven walk under bright copper field quiet north glass".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like operators' own."""
    long = "\n".join(prose(i, 60) for i in range(60))
    rows = [
        (1, prose(1, 80), "a", "x"), (2, prose(1, 80), "a", "x"), (2, prose(1, 80), "a", "x"), (3, None, "b", None), (4, "", None, "x"), (5, long, "b", "x"),
        (6, prose(1, 79) + " changed", "a", "x"), (7, " \n\t ", "b", "x"), (None, prose(9, 30), "a", "x"), (8, "x", "c", "x"), (9, long + " tail", "b", "x"), (10, prose(10, 70) + "\n" + prose(1, 80), "a", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, spans string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
