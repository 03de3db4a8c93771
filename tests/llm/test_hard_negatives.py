"""Cover trees and hard negatives against plain loops over all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.llm import hard_negatives
from kiln.llm.cover_tree import FAR, RATIO, Best, build, descend
from kiln.llm.hard_negatives import mine

SCHEMA = "vec_id long, x array<bigint>, label int, rank string, score string"


def brute(rows, every=100, positives=5, negatives=10, low=(30, 100), high=(90, 100)):
    rows = [r for r in rows if r[1] is not None and None not in r[1] and r[2] is not None]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for k, a in enumerate(rows):
        if a[0] is None or a[0] % every:
            continue
        score = [(dot(a[1], r[1]), r[0], r[2] == a[2]) for j, r in enumerate(rows) if j != k]
        for p, pid, _ in sorted((s for s in score if s[2]), key=key)[:positives]:
            inside = [s for s in score if not s[2] and low[0] * p <= low[1] * s[0] and high[1] * s[0] <= high[0] * p]
            out += [(a[0], pid, n + 1, s[1], p, s[0]) for n, s in enumerate(sorted(inside, key=key)[:negatives])]
    return sorted(out, key=str)


def vectors(rng, n, d, size, clusters=0):
    base = [[rng.randint(-size, size) for _ in range(d)] for _ in range(clusters)]
    if not clusters:
        return [[rng.randint(-size, size) for _ in range(d)] for _ in range(n)]
    return [[v + rng.randint(-size // 20 - 1, size // 20 + 1) for v in rng.choice(base)] for _ in range(n)]


def table(rng, n, d=4, size=20, clusters=0, labels=3):
    return [(i, v, rng.randrange(labels), "clash", "clash") for i, v in enumerate(vectors(rng, n, d, size, clusters))]


def run(spark, rows, parts=3, every=100, **settings):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(map(tuple, mine(df, "vec_id", "x", "label", F.col("vec_id") % every == 0, **settings).collect()), key=str)


@pytest.mark.parametrize("clusters, size, d", [(0, 20, 4), (12, 300, 6), (3, 1, 2), (40, 1000, 16)])
def test_trees_cover_and_bound(clusters, size, d):
    rng = random.Random(size)
    n = 700
    x = np.array(vectors(rng, n, d, size, clusters))
    labels = np.array([rng.randrange(4) for _ in range(n)])
    tree, order = build(np.arange(n), np.zeros(n, bool), labels, x)
    assert sorted(order.tolist()) == list(range(n)) and (tree.x == x[order]).all() and (tree.ids == order).all()
    squares = (tree.x ** 2).sum(axis=1)
    aug = np.concatenate([tree.x, np.sqrt(squares.max() - squares)[:, None]], axis=1)
    level = [np.array([0])]
    while not tree.leaf[level[-1]].any():
        level.append(np.concatenate([np.arange(a, b) for a, b in zip(tree.child_first[level[-1]], tree.child_last[level[-1]])]))
    assert sum(map(len, level)) == len(tree.first) and tree.leaf[level[-1]].all()
    for i, nodes in enumerate(level):
        assert tree.first[nodes[0]] == 0 and tree.last[nodes[-1]] == n and (tree.first[nodes[1:]] == tree.last[nodes[:-1]]).all()
        centres = aug[tree.centre[nodes]]
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + np.diag([np.inf] * len(nodes))
        for k, node in enumerate(nodes):
            mine_ = slice(tree.first[node], tree.last[node])
            assert tree.first[node] <= tree.centre[node] < tree.last[node]
            assert np.sqrt(((aug[mine_] - centres[k]) ** 2).sum(axis=1)).max() <= tree.radius[node]
            assert (tree.label_low[node], tree.label_high[node]) == (tree.labels[mine_].min(), tree.labels[mine_].max())
        if i:  # centres are farther apart than the children of any level below may lie from them
            assert set(tree.centre[level[i - 1]]) <= set(tree.centre[nodes]) and apart.min() > 0
    assert RATIO > 1
    q = np.array(vectors(rng, 30, d, size * 2), dtype=float)
    upper, lower = tree.bounds(np.arange(len(tree.first)), q, (q ** 2).sum(axis=1))
    score = q @ tree.x.T
    for node in range(len(tree.first)):
        part = score[:, tree.first[node]:tree.last[node]]
        assert (part.max(axis=1) <= upper[:, node]).all() and (part.min(axis=1) >= lower[:, node]).all()


@pytest.mark.parametrize("same", [True, False])
def test_descent_equals_all_rows(same):
    rng = random.Random(5)
    x = np.array(vectors(rng, 900, 5, 200, 30), dtype=float)
    labels = np.array([rng.randrange(3) for _ in range(900)])
    tree, _ = build(np.arange(900) // 2, np.arange(900) % 50 == 0, labels, x)
    q, mine_ = tree.x[::45], tree.labels[::45]
    own = np.arange(0, 900, 45)
    low = np.array([[-float(FAR), 1000.0, float(FAR)]] * len(q))
    high = np.array([[float(FAR), 60000.0, -float(FAR)]] * len(q))
    best = Best(7, low, high)
    verified = descend(tree, q, mine_, own, best, same)
    got = sorted(zip(best.group.tolist(), best.score.tolist(), best.null.tolist(), best.ids.tolist()))
    want = []
    for i in range(len(q)):
        rows = [(-float(q[i] @ tree.x[r]), bool(tree.null[r]), int(tree.ids[r])) for r in range(900) if r != own[i] and (tree.labels[r] == mine_[i]) == same]
        for j in range(3):
            want += [(3 * i + j, -s, null, k) for s, null, k in sorted(t for t in rows if low[i, j] <= -t[0] <= high[i, j])[:7]]
    assert got == sorted(want) and 0 < verified <= 900


def test_near_groups_are_left_out():
    """Where rows lie in tight groups, few of them are verified."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(100, 8)) * 10_000, 40, axis=0).round() + rng.integers(-20, 20, size=(4000, 8))
    tree, _ = build(np.arange(4000), np.zeros(4000, bool), np.zeros(4000, int), x)
    for i in range(0, 4000, 400):
        best = Best(5, np.full((1, 1), -float(FAR)), np.full((1, 1), float(FAR)))
        assert descend(tree, tree.x[i:i + 1], np.zeros(1, int), np.array([i]), best, True) < 2000


@pytest.mark.parametrize("chunk, block, together", [(8192, 1 << 20, 64), (16, 8, 2), (1, 4, 1)])
def test_equals_brute_force(spark, monkeypatch, chunk, block, together):
    """Also with tiny chunks and several blocks of anchors."""
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(hard_negatives, "BLOCK_VALUES", block)
    monkeypatch.setattr(hard_negatives, "TOGETHER", together)
    rng = random.Random(chunk)
    rows = table(rng, 120, clusters=9, size=40)
    got = run(spark, rows, every=25)
    assert got == brute(rows, every=25) and len(got) > 20


def test_awkward_rows(spark):
    rng = random.Random(8)
    rows = table(rng, 150)
    rows += [(0, rows[0][1], rows[0][2], "", ""), (0, rows[0][1], rows[0][2], "", ""), (0, [1, 2, 3, 4], 1, "", ""), (40, None, 1, "", ""), (80, [1, None], 1, "", ""),
             (120, [1], None, "", ""), (None, [9, 9, 9, 8], 1, "", ""), (None, [6, 6, 6, 5], 0, "", ""), (None, [6, 6, 6, 5], 0, "", ""), (160, [], 2, "", ""), (200, [5, -7], 2, "", ""),
             (-40, [9, 9, 9, 9], 1, "", ""), (240, [4, 4, 4, 4, 9, 9], 1, "", "")]
    rows += [(1000 + i, [6, 6, 6, 6], 2, "", "") for i in range(40)]  # ties
    got = run(spark, rows, every=40)
    assert got == brute(rows, every=40)
    assert {g[0] for g in got} >= {0, -40, 240, 1000} and any(g[1] is None or g[3] is None for g in got)


@pytest.mark.parametrize("size", [1 << 10, 1 << 24, 1 << 26])
def test_scores_are_exact(spark, size):
    """Beyond what floats hold, too."""
    rng = random.Random(size)
    rows = table(rng, 90, d=3, size=size, clusters=4)
    assert run(spark, rows, every=20) == brute(rows, every=20)


def test_limits(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1], 1, "", "")]) == [] and run(spark, [(100, [1], 1, "", "")]) == []
    rows = table(random.Random(9), 80)
    assert run(spark, rows, every=20, positives=2, negatives=3, low=(1, 2), high=(4, 5)) == brute(rows, 20, 2, 3, (1, 2), (4, 5))
    with pytest.raises(ValueError, match="64 bits"):
        run(spark, [(0, [1 << 40], 1, "", "")])
