"""Fixtures: a small table with every awkward case, and an empty one."""

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "ids string, score string, found string, chunk string, fp string, place string, bin string, label string")


def _rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, base = prose(60), prose(200)
    texts = [None, "", "   \n\t ", "one", "two words", base, base, base + " tail", "head " + base, base.upper(),
             prose(3000), f"{prose(30)} {shared} {prose(30)}", f"{prose(25)}\n{shared}\n\n{prose(10)}", shared, f"{shared} {shared}",
             "x" * 5000, "a " * 3000, "password = hunter2hunter2", " unicode space\u0085", "É" * 300 + "  b"]
    texts += [prose(rng.randint(1, 120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, base), (7, prose(30)), (None, base), (None, None), (-3, shared)]
    return [(i, t, "en", "s", len(t or ""), "x", "x", "x", "x", "x", "x", "x", "x") for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def messy(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
