import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import boosting as b
from kiln.operators import model


def _rows(n=400, k=3, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x1, x2, x3 = (float(v) for v in rng.integers(0, 12, 3))
        y = int(min(k - 1, (x1 > 5) + (x2 > 7)))
        if rng.random() < 0.1:
            y = int(rng.integers(0, k))
        out.append((i, None if i % 17 == 0 else x1, float("nan") if i % 23 == 0 else x2, x3, y, i % 4 == 0))
    return out


_SCHEMA = "id long, x1 double, x2 double, x3 double, y int, v boolean"


def _plain_tree(x, g, h, depth, rate):
    """A tree grown on raw values with plain loops: node -> (feature, value, missing left) or a leaf."""
    tree = {}

    def grow(rows, node, level):
        G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
        tree[node] = -rate * G / (H + 1)
        if level == depth:
            return
        best = None
        for f in range(x.shape[1]):
            for v in sorted({x[i, f] for i in range(len(x)) if not np.isnan(x[i, f])}):
                for missing_left in (False, True):
                    left = [i for i in rows if (missing_left if np.isnan(x[i, f]) else x[i, f] <= v)]
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    if hl < 1 or H - hl < 1:
                        continue
                    gain = gl ** 2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G ** 2 / (H + 1)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, left)
        if best:
            inside = set(best[1])
            grow(best[1], 2 * node + 1, level + 1)
            grow([i for i in rows if i not in inside], 2 * node + 2, level + 1)
            tree[node] = None

    grow(list(range(len(x))), 0, 0)
    return tree


@pytest.mark.parametrize("k", [2, 3])
def test_one_round_against_plain_loops(spark, k):
    rows = _rows(k=k)
    df = spark.createDataFrame(rows, _SCHEMA)
    made = b.fit_boosted(df.repartition(5), ["x1", "x2", "x3"], "y", n_trees=1, max_depth=2, learning_rate=0.3)
    assert len(made.trees) == (1 if k == 2 else 3)
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows], dtype=float)
    for t in made.trees:
        cls = 1 if k == 2 else t.group
        p, scale = 1 / k, 1 if k == 2 else 2
        g = [p - (r[4] == cls) for r in rows]
        h = [scale * p * (1 - p)] * len(rows)
        plain = _plain_tree(x, g, h, 2, 0.3)
        mine = {i: t.value[i] for i in set(t.route(b.encode(list(x.T), made.cuts)).tolist())}
        leaves = {i: v for i, v in plain.items() if v is not None}
        assert sorted(mine.values()) == pytest.approx(sorted(leaves.values()), abs=1e-6)


def test_same_model_however_the_rows_are_dealt(spark):
    df = spark.createDataFrame(_rows(), _SCHEMA)
    fits = [b.fit_boosted(d, ["x1", "x2", "x3"], "y", n_trees=12, max_depth=2) for d in (df.coalesce(1), df.repartition(7))]
    assert fits[0].to_json() == fits[1].to_json()
    assert fits[0].n_rounds == 12  # margins are stored anew after ten
    s = model.score(fits[0], df)
    assert s.filter(F.col("prediction") == F.col("y")).count() > 340
    assert all(abs(sum(r.probability) - 1) < 1e-12 for r in s.collect())
    shares = model.feature_importance(fits[0], fits[0].features).collect()
    assert abs(sum(r.importance for r in shares) - 1) < 1e-9 and shares[-1].feature == "x3"


def test_margins_kept_and_margins_recomputed_agree(spark, monkeypatch):
    df = spark.createDataFrame(_rows(), _SCHEMA)
    one = b.fit_boosted(df, ["x1", "x2"], "y", n_trees=4, max_depth=2)
    monkeypatch.setattr(b, "REFRESH", 1)
    assert b.fit_boosted(df, ["x1", "x2"], "y", n_trees=4, max_depth=2).to_json() == one.to_json()


def test_patience_and_the_rows_it_looks_at(spark):
    rng = np.random.default_rng(5)
    noise = [(i, float(rng.normal()), float(rng.normal()), 0.0, int(rng.integers(0, 2)), i % 3 == 0) for i in range(300)]
    df = spark.createDataFrame(noise, _SCHEMA)
    made = b.fit_boosted(df, ["x1", "x2"], "y", n_trees=60, max_depth=3, learning_rate=0.5, validation_col="v", patience=3)
    assert made.losses[0] == pytest.approx(np.log(2), abs=1e-6)
    assert made.n_rounds == int(np.argmin(made.losses)) and len(made.losses) == made.n_rounds + 4 < 60
    val = model.score(made, df.filter("v")).collect()
    assert made.losses[made.n_rounds] == pytest.approx(np.mean([-np.log(r.probability[r.y]) for r in val]), abs=1e-6)


def test_shares_of_rows_and_features_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame(_rows(), _SCHEMA)
    made = b.fit_boosted(df, ["x1", "x2", "x3"], "y", n_trees=6, max_depth=2, subsample=0.5, colsample=0.4)
    assert all(len(set(t.feature[t.feature >= 0].tolist())) <= 1 for t in made.trees)
    model.save_model(made, str(tmp_path / "m"))
    again = model.load_model(str(tmp_path / "m"))
    assert again.to_json() == made.to_json()
    assert sorted(map(str, model.score(again, df).collect())) == sorted(map(str, model.score(made, df).collect()))
    empty = b.fit_boosted(df.filter("id < 0"), ["x1"], "y", n_trees=2)
    assert [r.probability for r in model.score(empty, df.limit(1)).collect()] == [[0.5, 0.5]]
    with pytest.raises(ValueError):
        b.fit_boosted(df.withColumn("y", F.lit(-1)), ["x1"], "y")
