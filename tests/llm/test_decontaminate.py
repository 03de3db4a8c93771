"""Containment search against exact containment of every pair."""

import random
import re

import pytest

from kiln.llm.decontaminate import find_items, mark_items


def words(t):
    return [w for w in re.split(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").encode().lower()) if w]


def brute(docs, items, threshold=0.8, shingle=5):
    out = []
    for d, text in docs:
        w = words(text)
        for i, item in items:
            q = words(item)
            k = min(shingle, len(q))
            s = set(zip(*(q[j:] for j in range(k)))) if k else set()
            if s:
                share = len(s & set(zip(*(w[j:] for j in range(k))))) / len(s)
                if share >= threshold:
                    out.append((d, i, round(share, 9), len(s)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 12, 20, 33, 34, 60, 61, 130, 400])]
    items += [(100, None), (101, ""), (102, " ... "), (103, items[9][1]), (104, "a a a a a a a a a a"), (None, items[10][1])]
    docs = []
    for k in range(120):
        parts = [" ".join(prose(rng.choice([0, 3, 40, 900])))]
        for _ in range(rng.randint(0, 2)):
            q = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 0, 1, 2])):  # some are altered
                if q:
                    q[rng.randrange(len(q))] = word()
            parts += [(", " if rng.random() < 0.3 else " ").join(q).upper() if rng.random() < 0.2 else " ".join(q), " ".join(prose(rng.choice([0, 2, 300])))]
        docs.append((k, "\n".join(parts)))
    return docs + [(500, None), (501, ""), (None, items[11][1]), (3, docs[3][1]), (502, "a " * 4000)], items


def _got(df):
    return sorted(((r.doc_id, r.item_id, round(r.containment, 9), r.n_shingles) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_items", [20_000, 4])
def test_equals_brute_force(spark, case, block_items):
    docs, items = case
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert _got(find_items(d, i, block_items=block_items)) == brute(docs, items)
    assert _got(find_items(d, i, block_items=block_items, threshold=0.5)) == brute(docs, items, 0.5)


def test_partitions_by_size_lose_nothing(spark):
    """Passages anywhere in long documents, for items of every size class."""
    rng = random.Random(12)
    items, docs = [], []
    for n, size in enumerate(range(5, 300, 7)):
        item = [f"i{n}x{k}" for k in range(size)]
        items.append((n, " ".join(item)))
        for at in (0, 1, 63, 500):
            docs.append((len(docs), " ".join([f"p{rng.random()}" for _ in range(at)] + item[: max(5, int(size * 0.9))] + [f"q{rng.random()}" for _ in range(500 - at)])))
    got = _got(find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items)


def test_awkward_tables(spark, messy, empty, rows):
    items = [(r[0], r[1]) for r in rows]
    i = messy.selectExpr("doc_id as item_id", "text", "ids")
    assert _got(find_items(messy, i)) == brute(items, items)
    assert find_items(empty, i).collect() == [] and find_items(messy, i.limit(0)).collect() == []
    marked = mark_items(messy, i.where("item_id = 5"))
    assert marked.columns == [c for c in messy.columns if c != "found"] + ["found"] and marked.count() == len(rows)
