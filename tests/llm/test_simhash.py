"""SimHash against brute force; the bit-sliced buckets against plain distances."""

import re

import numpy as np
import pytest
import xxhash

from kiln.llm import simhash
from kiln.llm.graph import components
from kiln.llm.simhash import _one_bucket, _small_buckets, fingerprint, links, one_of_each, planes_of, simhash_components, within


def plain_fingerprint(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items, radius):
    """items: (id, fingerprint); least id of each chain of links."""
    todo, out = set(range(len(items))), {}
    while todo:
        group = front = {todo.pop()}
        while front:
            front = {j for j in todo if any(bin(items[i][1] ^ items[j][1]).count("1") <= radius for i in front)}
            todo -= front
            group = group | front
        ids = [items[i][0] for i in group if items[i][0] is not None]
        for i in group:
            out[i] = min(ids) if ids else None
    return out


def clusters(n, rng):
    out = []
    while len(out) < n:
        f = int(rng.integers(0, 1 << 63))
        for _ in range(int(rng.integers(1, 9))):
            f ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 4)), replace=False))
            out.append(f)
    return out[:n]


def test_fingerprints(rows):
    for r in rows:
        assert fingerprint(r[1]) == plain_fingerprint(r[1])


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_within_equals_distances(radius):
    rng = np.random.default_rng(radius)
    fps = np.array(clusters(300, rng), dtype=np.uint64)
    got = simhash._lanes(within(planes_of(fps), fps[:70], radius), 300)
    assert (got == (np.bitwise_count(fps[:70, None] ^ fps[None, :]) <= radius)).all()


def test_buckets(monkeypatch):
    rng = np.random.default_rng(1)
    fps = np.unique(np.array(clusters(700, rng), dtype=np.uint64))
    want = plain_components(list(enumerate(fps.tolist())), 2)
    assert _one_bucket(fps, 2, at_once=7).tolist() == [want[i] for i in range(len(fps))]
    assert _small_buckets(np.zeros(len(fps), np.int64), fps, 2).tolist() == [want[i] for i in range(len(fps))]


@pytest.mark.parametrize("large", [4096, 3])
def test_links_lose_none(spark, monkeypatch, large):
    """Also where every bucket counts as large and is dealt again."""
    monkeypatch.setattr(simhash, "LARGE_BUCKET", large)
    rng = np.random.default_rng(2)
    fps = sorted(set(clusters(500, rng)) | {0, 1, 3, 7, (1 << 64) - 1})
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    tree = {r.node: r.root for r in components(links(spark.createDataFrame([(f,) for f in signed], "fp long")), "a", "b").collect()}
    want = plain_components(list(zip(signed, fps)), 2)
    roots = [tree.get(s, s) for s in signed]
    assert len(set(zip(roots, (want[i] for i in range(len(fps)))))) == len(set(roots)) == len(set(want.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 140)}, 201: 200}


def test_documents(messy, rows, empty):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(messy).collect()), key=str)
    items = [(r[0], plain_fingerprint(r[1])) for r in rows]
    want = plain_components(items, 2)
    assert got == sorted(((i, f"{f:016x}", want[k]) for k, (i, f) in enumerate(items)), key=str)
    assert simhash_components(empty).collect() == []


def test_one_of_each_keeps_every_component(messy, rows):
    """Components whose least doc_id is the same (7 in the fixture) each keep a document."""
    fps = [plain_fingerprint(r[1]) for r in rows]
    group = plain_components([(k, f) for k, f in enumerate(fps)], 2)
    least = plain_components([(r[0], f) for r, f in zip(rows, fps)], 2)
    kept = one_of_each(messy)
    assert kept.columns == messy.columns and one_of_each(messy.limit(0)).collect() == []
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert None not in {i for i, _ in got}  # both rows without an id are copies of rows with one
    at = [next(k for k, r in enumerate(rows) if (r[0], r[1]) == g and least[k] == g[0]) for g in got]
    assert len({group[k] for k in at}) == len(got)
    assert {group[k] for k in at} == set(group.values())


def test_one_of_each_without_ids(spark):
    """Copies among rows without an id: one stays."""
    a, b = " ".join(f"w{k}" for k in range(80)), " ".join(f"v{k}" for k in range(80))
    docs = [(None, a)] * 5 + [(None, b), (3, b), (None, "x y z"), (None, None), (None, "")]
    kept = one_of_each(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == sorted([(None, a), (3, b), (None, "x y z"), (None, "")], key=str)


def test_texts_beyond_one_step_of_shingles(spark, monkeypatch):
    """Texts of more words than are hashed at a time."""
    assert simhash.SHINGLES_AT_ONCE >= 50_000
    text = " ".join(f"w{k % 9973}" for k in range(2 * simhash.SHINGLES_AT_ONCE + 17))
    assert fingerprint(text) == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    for n in (6, 7, 8, 9, 10, 100):
        short = " ".join(f"w{k}" for k in range(n))
        assert fingerprint(short) == plain_fingerprint(short)


def test_one_of_each_shared_ids(spark):
    """The unlinked document stays and the near copy goes, whichever text sorts first."""
    long, other = " ".join(f"w{k}" for k in range(80)), " ".join(f"v{k}" for k in range(80))
    docs = [(1, long), (2, long), (2, f"zz {other}"), (3, long), (3, f"aa {other} x y z"), (4, None), (4, ""), (4, None)]
    kept = one_of_each(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()))
    items = [(i, plain_fingerprint(t)) for i, t in docs]
    assert len(set(plain_components([(k, f) for k, (_, f) in enumerate(items)], 2).values())) == 4
    assert got == [(1, long), (2, f"zz {other}"), (3, f"aa {other} x y z"), (4, "")]
