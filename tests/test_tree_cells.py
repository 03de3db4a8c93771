import numpy as np
import pytest
from pyspark.ml.classification import OneVsRest
from pyspark.sql import functions as F

from kiln.operators import model, tree_cells

FEATURES = ["price", "step", "shift", "zero", "one"]


def _table(spark, n=14_000, seed=5):
    """Skewed, stepped, signed and constant features; labels that follow them in part (nodes of one
    residual would be split by rounding errors), some NULL."""
    rng = np.random.default_rng(seed)
    price, step, shift = rng.lognormal(5, 1, n), rng.integers(1, 12, n) / 4, np.where(rng.random(n) < 0.3, 0.0, rng.normal(size=n))
    y = (rng.random(n) < np.where(price > 150, 0.8, 0.3)).astype(int) + (rng.random(n) < np.where(step + shift > 2, 0.7, 0.2))
    rows = [(i, float(a), float(b), float(c), 0.0, 1.0, None if i % 97 == 0 else int(v)) for i, (a, b, c, v) in enumerate(zip(price, step, shift, y))]
    cols = "id long, price double, step double, shift double, zero double, one double, y int"
    return spark.createDataFrame(rows, cols).repartition(3, "id").persist()


def _nodes(fitted):
    """The trees in raw thresholds, and the values of their leaves."""
    cut_of = lambda i, t: float(t)
    if len(fitted.stages) == 3:
        begins = fitted.stages[0].getSplitsArray()
        cut_of = lambda i, t: float(np.nextafter(begins[i][int(t) + 1], -np.inf))
    trees = [[] for m in fitted.stages[-1].models for _ in m.trees]
    for out, t in zip(trees, [t for m in fitted.stages[-1].models for t in m.trees]):
        tree_cells._nodes(t._call_java("rootNode"), out, cut_of)
    return [[n[:4] for n in t] for t in trees], [n[4] for t in trees for n in t]


@pytest.mark.parametrize("features", [FEATURES, ["price", "step"]])
def test_cells_give_the_trees_of_the_rows(spark, monkeypatch, features):
    """More rows than candidates are drawn from: the trees on counted cells ask what Spark's ask on the rows,
    and the fit is handed cells, not rows."""
    df = _table(spark)
    fit = lambda: model.fit_gbt_classifier(df, features, "y", n_trees=4, max_depth=3, learning_rate=0.3)
    plain = fit()
    monkeypatch.setattr(tree_cells, "CELL_ROWS", 10_000)
    monkeypatch.setattr(tree_cells, "CELL_SHARE", 100.0)
    given, inner = [], OneVsRest.fit
    monkeypatch.setattr(OneVsRest, "fit", lambda self, data, params=None: (given.append(data), inner(self, data, params))[1])
    counted = fit()
    assert len(plain.stages) == 2 and len(counted.stages) == 3
    assert given[0].columns == ["features", "_label", "_rows"]
    if len(features) == 2:
        assert given[0].agg(F.sum("_rows")).first()[0] == df.count() and given[0].count() < df.count() / 10
    (asked, values), (asked_now, values_now) = _nodes(plain), _nodes(counted)
    assert asked == asked_now and np.allclose(values, values_now, atol=1e-9)
    both = counted.transform(plain.transform(df).select(*df.columns, F.col("prediction").alias("was")))
    assert both.filter("prediction = was").count() == df.count()
    df.unpersist()


def test_scores_by_region_are_those_of_the_trees(spark, monkeypatch, tmp_path):
    """Missing values, thresholds and their neighbours go where the trees send them; also after a reload."""
    df = _table(spark)
    plain = model.fit_gbt_classifier(df, FEATURES, "y", n_trees=4, max_depth=3, learning_rate=0.3)
    monkeypatch.setattr(tree_cells, "CELL_ROWS", 10_000)
    monkeypatch.setattr(tree_cells, "CELL_SHARE", 100.0)
    counted = model.fit_gbt_classifier(df, FEATURES, "y", n_trees=4, max_depth=3, learning_rate=0.3)
    cuts = [sorted({n[1] for t in _nodes(plain)[0] for n in t if n[0] == i}) for i in range(len(FEATURES))]
    odd = [None, float("nan"), float("inf"), -float("inf"), -0.0] + [float(x) for x in cuts[0] for x in (x, np.nextafter(x, np.inf), np.nextafter(x, -np.inf))]
    rows = [(x, s, h, 0.0, z) for x in odd for s in [None, *cuts[1]] for h in [float("nan"), *cuts[2]] for z in (1.0, None)]
    x = spark.createDataFrame(rows, "price double, step double, shift double, zero double, one double")
    model.save_model(counted, str(tmp_path / "m"))
    for fitted in (plain, counted, model.load_model(str(tmp_path / "m"))):
        both = fitted.transform(x).withColumnRenamed("prediction", "was").select("was", *FEATURES)
        s = model.score(fitted, both, keep=["was"])
        assert "from_json" not in s._jdf.queryExecution().optimizedPlan().toString()  # read once, not per row
        assert s.filter("prediction = was").count() == len(rows)
    before = plain.transform(x).groupBy("prediction").count().collect()
    assert sorted(before) == sorted(model.score(counted, x, keep=[]).groupBy("prediction").count().collect())
    monkeypatch.setattr(tree_cells, "REGIONS", 1)
    assert tree_cells.predicted(plain, x, []) is None
    df.unpersist()


def test_rows_that_cells_do_not_serve_keep_sparks_fit(spark, monkeypatch):
    """A missing feature is still Spark's error, and samples of rows or features are drawn from rows."""
    df = _table(spark, 2_000)
    monkeypatch.setattr(tree_cells, "CELL_ROWS", 100)
    for options in ({"subsample": 0.8}, {"colsample": 0.67}, {"validation_col": "val"}):
        fitted = model.fit_gbt_classifier(df.withColumn("val", F.col("id") % 5 == 0).fillna(0, ["y"]), FEATURES[:3], "y", n_trees=2, **options)
        assert len(fitted.stages) == 2
    assert len(model.fit_gbt_classifier(df, FEATURES[:3], "y", n_trees=2).stages) == 2  # as many cells as rows
    with pytest.raises(Exception, match="NaN"):
        model.fit_gbt_classifier(df.withColumn("step", F.when(F.col("id") != 7, F.col("step"))), ["step"], "y", n_trees=2)
    assert len(model.fit_gbt_classifier(df, ["step"], "y", n_trees=2).stages) == 3
    df.unpersist()


def test_split_points():
    """All values apart where they are few; else equal shares, zeros being what is left of the rows."""
    x = np.array([3.0, 1.0, 2.0, 2.0, 0.0, 0.0])
    assert tree_cells.split_points(x, 6, 1.0, 32) == [0.5, 1.5, 2.5]
    assert tree_cells.split_points(x[x > 0], 4, 1.0, 32) == [1.5, 2.5]
    assert tree_cells.split_points(np.zeros(5), 5, 1.0, 32) == []
    assert tree_cells.split_points(np.arange(1.0, 101), 100, 1.0, 4) == [25.5, 50.5, 75.5]
