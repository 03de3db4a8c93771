import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import model, tune
from kiln.plans import runs


def _separable(spark, n=300):
    rng = np.random.default_rng(7)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = (x1 + 0.5 * x2 > 0).astype(int)
    return spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x1, x2, y)], "x1 double, x2 double, y int")


def test_classifiers_on_separable_data(spark):
    df = _separable(spark)
    for fit in (lambda d: model.fit_logistic(d, ["x1", "x2"], "y", C=10.0),
                lambda d: model.fit_gbt_classifier(d, ["x1", "x2"], "y", n_trees=10, max_depth=2)):
        s = model.score(fit(df), df)
        acc = s.filter(F.col("prediction") == F.col("y")).count() / s.count()
        assert acc > 0.9
        sums = s.select(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b).alias("t")).collect()
        assert all(abs(r.t - 1) < 1e-9 for r in sums)
    imp = model.feature_importance(model.fit_gbt_classifier(df, ["x1", "x2"], "y", n_trees=5), ["x1", "x2"])
    assert abs(sum(r.importance for r in imp.collect()) - 1) < 1e-9


def test_ar_recovers_coefficients(spark):
    rng = np.random.default_rng(0)
    rows = []
    for key, phi in (("a", 0.5), ("b", -0.3)):
        x = 0.0
        for t in range(2000):
            x = 1.0 + phi * x + rng.normal(scale=0.1)
            rows.append((key, t, x))
    df = spark.createDataFrame(rows, "k string, t long, v double")
    fit = {r.k: r for r in model.fit_ar(df, "v", p=1, trend="c", order_cols=["t"], key="k").collect()}
    assert abs(fit["a"].coef[1] - 0.5) < 0.05 and abs(fit["b"].coef[1] + 0.3) < 0.05
    fc = model.forecast_ar(model.fit_ar(df, "v", p=1, order_cols=["t"], key="k"), df, "v", 3, ["t"], key="k")
    assert fc.count() == 6


def test_grids_and_draws():
    g = tune.param_grid({"a": [1, 2], "b": ["x", "y", "z"]})
    assert len(g) == 6 and g[0] == {"a": 1, "b": "x"}
    ar = tune.ar_grid({"p": [1, 2], "d": [0], "q": [0], "trend": ["n", "c"]})
    assert len(ar) == 4 and {x["trend"] for x in ar} == {None, "c"}
    d1 = tune.param_samples({"C": ("loguniform", 0.01, 10), "k": ("int", 1, 3)}, 5, seed=42)
    d2 = tune.param_samples({"C": ("loguniform", 0.01, 10), "k": ("int", 1, 3)}, 5, seed=42)
    assert d1 == d2 and all(0.01 <= x["C"] <= 10 and 1 <= x["k"] <= 3 for x in d1)


def _orders(spec):
    return [tuple(c[k] for k in ("p", "d", "q", "P", "D", "Q", "s", "trend")) for c in tune.ar_grid(spec)]


def test_ar_grid_cases():
    plain = {"p": [1, 2], "d": [0], "q": [0, 1]}
    assert _orders(plain) == [(1, 0, 0, 0, 0, 0, 0, None), (1, 0, 1, 0, 0, 0, 0, None), (2, 0, 0, 0, 0, 0, 0, None), (2, 0, 1, 0, 0, 0, 0, None)]
    # p, d, q all empty: the seasonal lists are taken for them, without seasons
    assert _orders({"P": [1], "D": [0], "Q": [0, 2], "s": [12]}) == [(1, 0, 0, 0, 0, 0, 0, None), (1, 0, 2, 0, 0, 0, 0, None)]
    assert _orders({"p": [], "P": [1], "D": [], "Q": [0], "s": [12]}) == []
    # both: seasonal products, and the non-seasonal ones only for a None among the seasons
    both = {"p": [1], "d": [0], "q": [0], "P": [1], "D": [1], "Q": [0], "trend": ["c", "n"]}
    assert _orders(both | {"s": [7]}) == [(1, 0, 0, 1, 1, 0, 7, "c"), (1, 0, 0, 1, 1, 0, 7, None)]
    assert _orders(both | {"s": [None, 7]}) == [(1, 0, 0, 0, 0, 0, 0, "c"), (1, 0, 0, 0, 0, 0, 0, None), (1, 0, 0, 1, 1, 0, 7, "c"), (1, 0, 0, 1, 1, 0, 7, None)]
    # a list that is empty beside others leaves no candidate
    assert _orders({"p": [1], "d": [0]}) == [] and _orders(both | {"s": [7], "Q": []}) == [] and _orders({}) == []


def test_run_validation_and_flatten(spark):
    good = {"schema_version": "1.1", "step": "train", "algorithm": "x", "params": {}, "metrics": {
        m: 0.5 for m in runs.V11_METRICS}, "hyperparameter_search": {"strategy": "none", "iterations_total": 1,
                                                                     "best_iteration": 0, "best_val_loss": None},
        "lstm_metadata": {"sequence_length": 5, "model_architecture": "a", "total_params": 3, "cpu_only": True},
        "features": list(range(23))}
    bad = dict(good, hyperparameter_search={"strategy": "bayesian", "iterations_total": 1, "best_iteration": 0,
                                            "best_val_loss": 1.0})
    old = {"step": "train"}
    text = dict(good, metrics={**good["metrics"], "val_mae": "0.5", "test_mae": None},
                hyperparameter_search={**good["hyperparameter_search"], "strategy": None})
    assert [r.errors for r in runs.validate_runs(spark.createDataFrame(
        [("r", json.dumps({"steps": [text]}))], "run_id string, doc string")).collect()] == [
        ["not_a_number:metrics.val_mae", "not_allowed:hyperparameter_search.strategy"]]
    docs = spark.createDataFrame([(f"r{i}", json.dumps({"steps": [d]})) for i, d in enumerate([good, bad, old])],
                                 "run_id string, doc string")
    v = {r.run_id: r for r in runs.validate_runs(docs).collect()}
    assert v["r0"].ok and not v["r1"].ok and v["r1"].errors == ["needed_by_strategy:bayesian_config"]
    assert v["r2"].errors == ["absent:algorithm"]
    flat = runs.flatten_runs(docs).filter("run_id = 'r0' and key = 'features'").orderBy("part").collect()
    assert [r.part for r in flat] == [1, 2, 3] and flat[2].value == "[20,21,22]"
    ml = runs.metrics_long(docs)
    assert ml.count() == 12
    best = runs.best_runs(ml, "val_rmse").first()
    assert best.value == 0.5


def test_forecasts_use_trend_and_future_regressors(spark):
    df = spark.createDataFrame([(t, 5.0 + 2 * t, 10.0 * (t % 4) + 3, float(t % 4)) for t in range(40)], "t long, y double, z double, e double")
    trend = model.forecast_ar(model.fit_ar(df, "y", p=0, trend="ct", order_cols=["t"]), df, "y", 3, ["t"])
    assert np.allclose([r.forecast for r in trend.orderBy("step").collect()], [85, 87, 89])
    fit = model.fit_ar(df, "z", p=0, trend="c", exog=["e"], order_cols=["t"])
    future = spark.createDataFrame([(1, 7.0), (2, 0.0)], "step int, e double")
    got = model.forecast_ar(fit, df, "z", 2, ["t"], future=future)
    assert np.allclose([r.forecast for r in got.orderBy("step").collect()], [73, 3])
    with pytest.raises(ValueError):
        model.forecast_ar(fit, df, "z", 2, ["t"])


def test_seasonal_lags_and_differences(spark):
    season = [3.0, -1.0, 4.0, 0.5]
    df = spark.createDataFrame([(t, season[t % 4] + 0.25 * (t // 4)) for t in range(60)], "t long, y double")
    want = [season[t % 4] + 0.25 * (t // 4) for t in range(60, 66)]
    diff = model.forecast_ar(model.fit_ar(df, "y", p=0, D=1, s=4, trend="c", order_cols=["t"]), df, "y", 6, ["t"])
    assert np.allclose([r.forecast for r in diff.orderBy("step").collect()], want)
    lag = model.forecast_ar(model.fit_ar(df, "y", p=0, P=1, s=4, trend="c", order_cols=["t"]), df, "y", 6, ["t"])
    assert np.allclose([r.forecast for r in lag.orderBy("step").collect()], want, atol=1e-6)
    best = tune.ar_search(df, "y", [{"p": 1, "d": 0, "trend": "c"}, {"p": 0, "D": 1, "s": 4, "trend": "c"}], ["t"]).first()
    assert (best.candidate, best.sd, best.season) == (1, 1, 4)


def test_walk_forward_needs_two_predictions(spark):
    df = spark.createDataFrame([(t, float(t * t % 7)) for t in range(16)], "t long, y double")
    assert {r.part for r in tune.walk_forward_metrics(tune.walk_forward(df, "y", ["t"], W=10, h=2, folds=2)).collect()} == {"val", "test"}
    with pytest.raises(ValueError):
        tune.walk_forward(df, "y", ["t"], W=15, h=1, folds=1)


def _plain_walk(y, x, W, h, folds, p, d, trend):
    """Fold by fold on the rows themselves."""
    out = []
    for f in range(folds):
        a, b = f * h, f * h + W
        if b >= len(y):
            break
        w = np.diff(y[a:b], d)
        z = np.diff(x[a:b], d) if x is not None else None
        at = np.arange(p, len(w))
        cols = [np.ones(len(at))] + ([at + float(d)] if trend == "ct" else []) + [w[at - i] for i in range(1, p + 1)] + ([z[at]] if x is not None else [])
        beta = np.linalg.lstsq(np.column_stack(cols), w[at], rcond=None)[0]
        level, xs = list(y[a:b]), list(x[a:b]) if x is not None else None
        for step in range(1, min(h, len(y) - b) + 1):
            w = np.diff(level, d)
            terms = [1.0] + ([W + step - 1.0] if trend == "ct" else []) + [w[-i] for i in range(1, p + 1)]
            if xs is not None:
                xs.append(x[b + step - 1])
                terms.append(np.diff(xs, d)[-1])
            value = float(np.dot(beta, terms)) + (level[-1] if d else 0.0)
            level.append(value)
            out.append((f, step, round(float(y[b + step - 1]), 6), round(value, 6)))
    return out


@pytest.mark.parametrize("p, d, trend, exog", [(1, 0, "c", False), (2, 1, "c", False), (1, 0, "ct", True), (0, 1, "c", True)])
def test_walk_forward_equals_fold_by_fold_fits(spark, p, d, trend, exog):
    rng = np.random.default_rng(11)
    y = {k: np.cumsum(rng.normal(size=n)) + 1000 for k, n in (("a", 60), ("b", 33), ("short", 20))}
    x = {k: rng.normal(size=len(v)) for k, v in y.items()}
    rows = [(k, t, float(v), float(x[k][t])) for k in y for t, v in enumerate(y[k])]
    df = spark.createDataFrame(rows, "k string, t long, y double, x double").repartition(4)
    got = tune.walk_forward(df, "y", ["t"], W=20, h=3, folds=6, p=p, d=d, trend=trend, key="k", exog=["x"] if exog else (), block=7)
    got = sorted((r.k, r.fold, r.step, round(r.actual, 6), round(r.forecast, 6)) for r in got.collect())
    want = sorted((k, *r) for k in y for r in _plain_walk(y[k], x[k] if exog else None, 20, 3, 6, p, d, trend))
    assert [g[:4] for g in got] == [w[:4] for w in want] and "short" not in {g[0] for g in got}
    assert np.allclose([g[4] for g in got], [w[4] for w in want], atol=1e-5)
    with pytest.raises(ValueError):
        tune.walk_forward(df, "y", ["t"], W=3, h=1, p=3, key="k")


def test_accuracy_search_skips_failing_fits(spark):
    df = _separable(spark)
    space = {"solver": ("choice", ["lbfgs", "liblinear"]), "penalty": ("choice", ["l1", "l2"]), "C": ("loguniform", 0.1, 10.0)}
    best, fitted, results = tune.accuracy_search(lambda d, **g: model.fit_logistic(d, ["x1", "x2"], "y", max_iter=10, **g), space, 6, df, df, "y", seed=1)
    assert any(a is None for _, a in results) and max(a for _, a in results if a is not None) > 0.9 and fitted is not None
    assert (best["solver"], best["penalty"]) != ("lbfgs", "l1")
    with pytest.raises(ValueError):
        tune.accuracy_search(lambda d, **g: model.fit_logistic(d, ["x1", "x2"], "y", solver="none"), space, 2, df, df, "y")


def test_replay_of_records(spark):
    from kiln.plans import replay

    rng = np.random.default_rng(3)
    rows = [(i, float(x), "a" if x > 0 else "b", "u" if i % 3 else None) for i, x in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(rows, "id long, x double, label string, color string")
    record = {"steps": [
        {"step": "data_cleaning", "parameters": {"eliminar_duplicados": False, "filtrar_outliers": False, "relleno_valores_numericos": "dejar"}},
        {"step": "generate_eda"},
        {"step": "data_encoding", "parameters": {"input_features": ["x", "color"], "target_variables": ["label"], "encode_target_label": True}},
        {"step": "train_logistic_regression", "input_features": ["x", "color"], "target_variable": "label", "split_ratios": [0.6, 0.2, 0.2],
         "hyperparameters": {"C": 10.0, "max_iter": 20, "solver": "lbfgs", "random_state": 1}}]}
    res = replay.replay_steps(df, record, id_cols=["id"])
    assert res.profile.count() == 4 and "color_vacio" in res.encoded.columns
    test = model.score(res.model, res.splits.filter("split = 'test'"))
    assert test.filter("prediction = label").count() / test.count() > 0.9
    for broken in ({"step": "train_svm", "target_variable": "label"}, {**record["steps"][3], "hyperparameters": {"gamma": 1}}):
        with pytest.raises(ValueError):
            replay.replay_steps(df, {"steps": [*record["steps"][:3], broken]}, id_cols=["id"])
    with pytest.raises(ValueError):
        replay.replay_steps(df, {"steps": [{"step": "data_cleaning", "parameters": {"dedupe": True}}]})
    series = spark.createDataFrame([(f"2024-01-{d:02d}", float(d)) for d in range(1, 29)], "day string, y double")
    got = replay.replay_steps(series, {"steps": [
        {"step": "data_cleaning", "parameters": {"optional_methods": None}},
        {"step": "train_arima", "date_col_name": "day", "target_variable": "y", "forecast_horizon": 3, "split_ratios": [0.8, 0.1, 0.1],
         "hyperparameters": {"p": 0, "d": 1, "trend": "c"}}]})
    assert [(round(r.forecast, 6), r.actual) for r in got.forecast.orderBy("step").collect()] == [(23.0, 25.0), (24.0, 26.0), (25.0, 27.0), (26.0, 28.0)]


def test_replay_of_searches_and_regressors(spark):
    from kiln.plans import replay

    clean = {"step": "data_cleaning", "parameters": {"optional_methods": None}}
    rng = np.random.default_rng(2)
    x = rng.normal(size=60)
    y = [float(10 + 3 * v) for v in x]
    series = spark.createDataFrame([(f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", y[d], float(x[d]), "t") for d in range(60)], "day string, y double, x double, word string")
    step = {"step": "train_arima", "date_col_name": "day", "target_variable": "y", "input_features": ["x", "word"], "forecast_horizon": 1, "split_ratios": [0.7, 0.15, 0.15]}
    got = replay.replay_steps(series, {"steps": [clean, step | {"hyperparameters": {"p": 0, "d": 0, "trend": "c"}}]})
    rows = got.forecast.orderBy("step").collect()
    assert len(rows) == 9 and all(abs(r.forecast - r.actual) < 1e-6 for r in rows) and got.model.first().coef_names == ["const", "exog_x"]
    walk = np.cumsum(rng.normal(size=60)) + 5
    series = series.drop("y", "x").join(spark.createDataFrame([(f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", float(walk[d])) for d in range(60)], "day string, y double"), "day")
    grid = {"use_grid_search": True, "p": [0, 1], "d": [0, 1], "q": [0], "trend": ["n", "c"]}
    got = replay.replay_steps(series, {"steps": [clean, {**step, "input_features": [], "grid_search": grid, "val_metrics": {"val_rmse": 1}}]})
    fits = model.fit_ar_grid(got.splits.filter("split = 'train'"), "y", tune.ar_grid({k: v for k, v in grid.items() if k != "use_grid_search"}), ["day"]).collect()
    least = min(fits, key=lambda r: (r.aic, r.candidate))
    assert (got.best["p"], got.best["d"]) == (least.p, least.d) and got.forecast.count() == 9
    for broken in ({"unknown": 1}, {"hyperparameter_search_strategy": "bayesian"}, {"grid_search": {"use_grid_search": True, "p": [1]}}):
        with pytest.raises(ValueError):
            replay.replay_steps(series, {"steps": [clean, {**step, "input_features": [], **broken}]})


def test_replay_of_classifier_searches(spark):
    from kiln.plans import replay

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(x), int(x > 0)) for i, x in enumerate(rng.normal(size=150))], "id long, x double, label int")
    clean = {"step": "data_cleaning", "parameters": {"eliminar_duplicados": False, "filtrar_outliers": False, "relleno_valores_numericos": "dejar"}}
    step = {"step": "train_logistic_regression", "input_features": ["x"], "target_variable": "label", "split_ratios": [0.6, 0.2, 0.2]}
    lists = {"C": [0.0001, 10.0], "max_iter": [20], "solver": ["lbfgs"]}
    got = replay.replay_steps(df, {"steps": [clean, step | {"grid_search": {"use_grid_search": True, "grid_search_params": lists, "best_params": {"C": 1}}}]}, id_cols=["id"])
    assert got.best["C"] == 10.0 and len(got.search) == 2 and got.search[1][1] > 0.9
    ranges = {"C_range": [1.0, 10.0], "max_iter_range": [10, 20], "penalty_options": ["l2", "l1"], "solver_options": ["lbfgs", "saga"]}
    random = {"hyperparameter_search_strategy": "random", "random_search": {"use_random_search": True, "n_random_iterations": 3, "random_search_params": ranges}}
    got = replay.replay_steps(df, {"steps": [clean, step | random]}, id_cols=["id"])
    assert len(got.search) == 3 and 1 <= got.best["C"] <= 10 and got.model is not None


def test_replay_of_default_perceptron_and_watched_boosting(spark):
    from kiln.operators.boosting import BoostedTrees
    from kiln.operators.perceptron import Perceptron
    from kiln.plans import replay

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(x), int((x > 0.5) + 0) + int(x > -0.5)) for i, x in enumerate(rng.normal(size=200))], "id long, x double, label int")
    clean = {"step": "data_cleaning", "parameters": {"eliminar_duplicados": False, "filtrar_outliers": False, "relleno_valores_numericos": "dejar"}}
    step = {"input_features": ["x"], "target_variable": "label", "split_ratios": [0.6, 0.2, 0.2]}
    # a record that names neither activation nor solver is one of relu and adam
    got = replay.replay_steps(df, {"steps": [clean, step | {"step": "train_mlp_model", "hyperparameters": {"maxIter": 2}}]}, id_cols=["id"])
    assert isinstance(got.model, Perceptron) and got.model.activation == "relu" and got.model.sizes == [1, 4, 3] and len(got.model.losses) == 2
    trees = {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.5}
    got = replay.replay_steps(df, {"steps": [clean, step | {"step": "train_xgboost", "hyperparameters": trees}]}, id_cols=["id"])
    assert isinstance(got.model, BoostedTrees) and got.model.n_classes == 3 and len(got.model.losses) == 4
    test = model.score(got.model, got.splits.filter("split = 'test'"))
    assert test.filter("prediction = label").count() / test.count() > 0.9


def test_boosting_deals_rows_to_bounded_tasks(spark, monkeypatch):
    """One partition of all rows becomes as many as the bound asks for, with the rows unchanged."""
    from kiln.operators import encode, model

    monkeypatch.setattr(encode, "TOGETHER_ROWS", 0)
    monkeypatch.setattr(model, "TREE_TASK_ROWS", 10)
    df = spark.range(200).selectExpr("id", "cast(id % 7 as double) as x", "concat('c', id % 3) as y").coalesce(1)
    coded = encode.label_encode(df, ["y"])
    assert "SortMergeJoin" not in coded._jdf.queryExecution().executedPlan().toString()  # three values would be three tasks
    dealt = model._spread(coded, ["x", "y"])
    assert dealt.rdd.getNumPartitions() == 20 and dealt.rdd.glom().map(len).max() <= 15
    assert sorted(dealt.collect()) == sorted(coded.select("x", "y").collect())
    monkeypatch.setattr(model, "TREE_TASK_ROWS", 200)
    assert model._spread(coded, ["x", "y"]).rdd.getNumPartitions() <= coded.rdd.getNumPartitions()


def test_grid_search_prepares_the_rows_once(spark):
    """What comes before the search runs once, not once per fold; each row is scored in one fold."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from kiln.operators import tune

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(300).selectExpr("id", "cast(id % 10 as double) as x", "cast(id % 10 > 4 as int) as y")
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows.mapInArrow(counted, rows.schema))
    lr = LogisticRegression(featuresCol="features", labelCol="_label", maxIter=20)
    found = tune.grid_search_cv(lr, [{"regParam": 10.0}, {"regParam": 1e-4}], data, "y", "id", folds=3, parallelism=2)
    assert seen.value == 300
    assert len(found.avgMetrics) == len(found.stdMetrics) == 2 and found.avgMetrics[1] == 1.0
    assert found.bestModel.getRegParam() == (10.0 if found.avgMetrics[0] == 1.0 else 1e-4)
    with pytest.raises(ValueError, match="fold .* is empty"):
        tune.grid_search_cv(lr, [{"regParam": 1.0}], data.limit(1), "y", "id", folds=3)
