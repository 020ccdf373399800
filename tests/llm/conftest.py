import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import table

@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and very long texts, copies, near copies, repeated rows, ties and characters of several bytes."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéüñ", k=rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = [prose(rng.randint(1, 150)) for _ in range(25)]
    out = [(i, t, "en" if i % 3 else "fr") for i, t in enumerate(base)]
    passage = prose(40)
    out += [(30 + i, base[2], "en") for i in range(4)]
    out += [(40 + i, base[3].rsplit(" ", 3)[0] + " " + prose(2), "en") for i in range(3)]
    out += [(50 + i, prose(20) + " " + passage + "\n" + prose(9), None) for i in range(4)]
    out += [(60, None, "en"), (61, "", "fr"), (62, " \t\n ", "en"), (63, "one", "en"), (64, "ONE", "fr"), (65, "a b c", None), (None, base[2], "en"), (None, None, None)]
    out += [(5, base[5], "en"), (5, base[5], "en"), (66, "é" * 300, "fr"), (67, prose(20_000), "en"), (68, "x" * 70_000, "en"), (69, "1234 !!", "en")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
