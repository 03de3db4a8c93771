"""Cover trees over norm-augmented vectors: exact searches for inner products in a window.

Every vector x gets one more coordinate, sqrt(M^2 - |x|^2) for the longest length M of its tree, so
that all have length M and ``|q - x|^2 = |q|^2 + M^2 - 2 <q, x>`` for a query q (whose extra
coordinate is 0): near means a large inner product.

A farthest-first traversal picks the centres. Cut where the distance to the nearest centre falls
below ``R / RATIO^i``, it gives nested levels whose centres are that far apart and cover every row;
a centre's parent is the nearest centre one level up. Each node knows its rows (one range), the
greatest distance from its centre to any of them (its covering radius) and the range of their labels.
By the triangle inequality, a node's rows have inner products within the bounds of ``Tree.bounds``.

``descend`` goes through a tree best-first for a few queries at once: it opens the nodes with the
greatest upper bound over what is wanted, in numbers that double with each round of leaves, drops nodes that lie outside every
query's windows, and verifies the rows of opened leaves exactly.
"""

from __future__ import annotations

import numpy as np

RATIO = 1.3
#: Rows of a leaf, on average.
LEAF_ROWS = 16
#: Beyond any score; exact in 64-bit integers and floats alike.
FAR = 1 << 62


class Tree:
    """Rows in tree order and the nodes over them, level by level; children follow one another."""

    FIELDS = ("first", "last", "centre", "radius", "child_first", "child_last", "label_low", "label_high")

    def __init__(self, ids: np.ndarray, null: np.ndarray, labels: np.ndarray, x: np.ndarray, nodes: dict[str, np.ndarray]):
        self.ids, self.null, self.labels, self.x = ids, null, labels, x
        self.first, self.last, self.centre, self.radius, self.child_first, self.child_last, self.label_low, self.label_high = (
            nodes[f] for f in self.FIELDS)
        self.longest2 = float((x.astype(float) ** 2).sum(axis=1).max(initial=0.0))

    @property
    def leaf(self) -> np.ndarray:
        return self.child_first < 0

    def bounds(self, nodes: np.ndarray, q: np.ndarray, q2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds, queries by nodes, of the inner products of the nodes' rows."""
        score = (q @ self.x[self.centre[nodes]].T).astype(float)
        reach, length, whole = self.radius[nodes], np.sqrt(q2)[:, None], q2[:, None] + self.longest2
        far = np.sqrt(np.maximum(whole - 2 * score, 0))
        slack = 1e-9 * whole + 1e-6  # for rounding
        upper = np.minimum((whole - np.maximum(far - reach, 0) ** 2) / 2, score + length * reach)
        lower = np.maximum((whole - (far + reach) ** 2) / 2, score - length * reach)
        return upper + slack, lower - slack


def _centres(aug: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Farthest-first centres, the distance at which each was picked, and each row's nearest."""
    length2 = float(aug[0] @ aug[0])
    least = 1e-6 * np.sqrt(length2)  # nearer rows are taken as equal; radii are measured, so bounds hold anyway
    near, owner = np.full(len(aug), np.inf), np.zeros(len(aug), dtype=np.int64)
    picked, gap, at = [], [], 0
    while True:
        picked.append(at)
        gap.append(near[at])
        far = np.sqrt(np.maximum(2 * (length2 - aug @ aug[at]), 0))
        far[at] = 0
        closer = far < near
        near[closer], owner[closer] = far[closer], len(picked) - 1
        at = int(near.argmax())
        if len(picked) >= most or near[at] <= least:
            return np.array(picked), np.array(gap), owner


def build(ids: np.ndarray, null: np.ndarray, labels: np.ndarray, x: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree over some rows, and the order in which it holds them."""
    exact = x.astype(float)
    squares = (exact * exact).sum(axis=1)
    aug = np.concatenate([exact, np.sqrt(squares.max() - squares)[:, None]], axis=1)
    picked, gap, owner = _centres(aug, max(1, len(x) // LEAF_ROWS))
    level = np.zeros(len(picked), dtype=np.int64)
    if len(picked) > 1:
        level[1:] = np.floor(np.log(gap[1] / gap[1:]) / np.log(RATIO) + 1e-9).astype(np.int64)
        level[1:] = np.unique(np.maximum.accumulate(level[1:]), return_inverse=True)[1] + 1  # levels without new centres are left out
    depth = int(level[-1])
    up = np.arange(len(picked))
    for i in range(1, depth + 1):
        own, above = np.flatnonzero(level == i), np.flatnonzero(level < i)
        up[own] = above[(aug[picked[own]] @ aug[picked[above]].T).argmax(axis=1)]
    ancestor, now = [], np.arange(len(picked))
    for i in range(depth, -1, -1):
        now = np.where(level[now] > i, up[now], now)
        ancestor.append(now)
    ancestor.reverse()  # ancestor[i][k]: the centre above centre k on level i
    order = np.lexsort([a[owner] for a in reversed(ancestor)])
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.arange(len(x))
    aug, labels = aug[order], labels[order]
    parts: dict[str, list[np.ndarray]] = {f: [] for f in Tree.FIELDS}
    base = 0
    for i, above in enumerate(ancestor):
        mine = above[owner[order]]
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        last = np.append(first[1:], len(x))
        centre = place[picked[mine[first]]]
        far = np.sqrt(((aug - aug[np.repeat(centre, last - first)]) ** 2).sum(axis=1))
        values = {"first": first, "last": last, "centre": centre, "radius": np.maximum.reduceat(far, first) * (1 + 1e-9),
                  "label_low": np.minimum.reduceat(labels, first), "label_high": np.maximum.reduceat(labels, first)}
        if i < depth:
            below = np.flatnonzero(np.diff(ancestor[i + 1][owner[order]], prepend=-1))
            values["child_first"] = base + len(first) + np.searchsorted(below, first)
            values["child_last"] = base + len(first) + np.searchsorted(below, last)
        else:
            values["child_first"] = values["child_last"] = np.full(len(first), -1)
        base += len(first)
        for f, v in values.items():
            parts[f].append(v)
    nodes = {f: np.concatenate(v) for f, v in parts.items()}
    return Tree(ids[order], null[order], labels, x[order], nodes), order


class Best:
    """For some queries and windows of scores each, the ``k`` first rows by score, then id."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray):
        self.k, self.low, self.high = k, low.copy(), high
        self.group = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=low.dtype)
        self.null, self.ids = np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        group, score = np.concatenate([self.group, group]), np.concatenate([self.score, score])
        null, ids = np.concatenate([self.null, null]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, null, -score, group))
        group = group[order]
        start = np.flatnonzero(np.diff(group, prepend=-1))
        rank = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
        kept = order[rank < self.k]
        full = order[rank == self.k - 1]
        self.group, self.score, self.null, self.ids = group[rank < self.k], score[kept], null[kept], ids[kept]
        at = group[rank == self.k - 1]
        flat = self.low.reshape(-1)
        flat[at] = np.maximum(flat[at], score[full])


def descend(tree: Tree, q: np.ndarray, labels: np.ndarray, own_row: np.ndarray, best: Best, same: bool) -> int:
    """Adds the rows of a tree to ``best``: those with the query's label (``same``) or with another.
    ``own_row`` is the query's own row in this tree or -1. Returns the number of rows verified."""
    q2 = (q.astype(float) ** 2).sum(axis=1)
    windows = best.low.shape[1]
    nodes = np.zeros(1, dtype=np.int64)
    upper, lower = tree.bounds(nodes, q, q2)
    width, verified = 1, 0
    while True:
        excess = np.full(upper.shape, -np.inf)
        for j in range(windows):
            inside = (upper >= best.low[:, j:j + 1]) & (lower <= best.high[:, j:j + 1])
            excess = np.maximum(excess, np.where(inside, upper - best.low[:, j:j + 1], -np.inf))
        low, high = tree.label_low[nodes], tree.label_high[nodes]
        idle = (labels[:, None] < low) | (labels[:, None] > high) if same else (low == high) & (labels[:, None] == low)
        excess = np.where(idle, -np.inf, excess).max(axis=0)
        live = np.flatnonzero(excess > -np.inf)
        if not len(live):
            return verified
        order = live[np.argsort(-excess[live], kind="stable")]
        opened, rest = order[:width], order[width:]
        taken = nodes[opened]
        leaves, inner = taken[tree.leaf[taken]], taken[~tree.leaf[taken]]
        nodes, upper, lower = nodes[rest], upper[:, rest], lower[:, rest]
        if len(inner):
            children = np.concatenate([np.arange(a, b) for a, b in zip(tree.child_first[inner], tree.child_last[inner])])
            more_upper, more_lower = tree.bounds(children, q, q2)
            nodes, upper, lower = np.concatenate([nodes, children]), np.concatenate([upper, more_upper], axis=1), np.concatenate([lower, more_lower], axis=1)
        if len(leaves):
            rows = np.concatenate([np.arange(a, b) for a, b in zip(tree.first[leaves], tree.last[leaves])])
            verified += len(rows)
            score = q @ tree.x[rows].T
            wanted = (labels[:, None] == tree.labels[rows]) == same
            wanted &= rows != own_row[:, None]
            for j in range(windows):
                i, r = np.nonzero(wanted & (score >= best.low[:, j:j + 1]) & (score <= best.high[:, j:j + 1]))
                if len(i):
                    best.add(i * windows + j, score[i, r], tree.null[rows[r]], tree.ids[rows[r]])
            width *= 2
