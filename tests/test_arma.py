"""Moving-average fits against plain loops and planted parameters."""

import numpy as np
import pytest

from kiln.operators import arma, model, tune


def series(n, phi=0.0, theta=0.0, level=0.0, seed=1, lag=1):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + lag)
    x, out = 0.0, []
    for t in range(n):
        x = phi * x + e[t + lag] + theta * e[t]
        out.append(float(x + level))
    return out


def plain_ss(y, p, lags, coef, const=True, start=None):
    """The conditional sum of squares, residuals, one row at a time."""
    start = p if start is None else start
    e = np.zeros(len(y))
    for t in range(start, len(y)):
        terms = ([1.0] if const else []) + [y[t - i] for i in range(1, p + 1)] + [e[t - lag] if t - lag >= start else 0.0 for lag in lags]
        e[t] = y[t] - float(np.dot(coef, terms))
    return float((e[start:] ** 2).sum()), e


@pytest.mark.parametrize("n, lags, theta", [(5, [1], [0.4]), (300, [1, 2], [0.5, -0.3]), (1000, [1, 12], [0.4, 0.5]), (400, [30], [0.9])])
def test_recurrence_equals_a_loop(n, lags, theta):
    rng = np.random.default_rng(n)
    u, past = rng.normal(size=(n, 3)), rng.normal(size=(max(lags), 3))
    out = [*past[::-1]]
    for t in range(n):
        out.append(u[t] - sum(w * out[len(out) - lag] for lag, w in zip(lags, theta)))
    got = arma.recur(u, lags, theta, past)
    assert np.allclose(got, out[max(lags):], atol=1e-10)
    assert np.allclose(arma.after(past, got), out[-max(lags):][::-1])
    power = np.linalg.matrix_power(arma.companion(lags, theta), n)
    alone = arma.after(np.zeros_like(past), arma.recur(u, lags, theta, np.zeros_like(past)))
    assert np.allclose(alone + power @ past, out[-max(lags):][::-1], atol=1e-8)


@pytest.mark.parametrize("block", [8192, 64])
def test_planted_parameters_are_recovered(spark, block):
    """Per series, in one block or many; the fit is a minimum of the plain sum of squares."""
    planted = {"a": (0.6, 0.4, 0.0), "b": (-0.3, 0.7, 1e6), None: (0.5, -0.5 + 0.9, 50.0)}
    data = {k: series(1500, phi, theta, level, seed=3) for k, (phi, theta, level) in planted.items()}
    df = spark.createDataFrame([(k, t, v) for k, y in data.items() for t, v in enumerate(y)], "k string, t long, v double").repartition(5)
    got = {r.k: r for r in arma.fit_arma(df, "v", p=1, q=1, order_cols=["t"], key="k", block=block).collect()}
    for k, (phi, theta, level) in planted.items():
        r = got[k]
        assert r.coef_names == ["const", "ar_1", "ma_1"] and r.n == 1499
        assert abs(r.coef[1] - phi) < 0.08 and abs(r.coef[2] - theta) < 0.08
        base = np.array(data[k]) - level
        coef = np.array([r.coef[0] - level * (1 - r.coef[1]), *r.coef[1:]])
        ss, e = plain_ss(base, 1, [1], coef)
        assert np.isclose(ss, r.rss, rtol=1e-6) and np.isclose(r.resid[0], e[-1], atol=1e-4)
        for i in range(3):
            for step in (-1e-3, 1e-3):
                assert plain_ss(base, 1, [1], coef + step * np.eye(3)[i])[0] > ss


def test_blocks_do_not_change_a_fit(spark):
    y = series(500, 0.0, 0.6, seed=5)
    df = spark.createDataFrame(list(enumerate(y)), "t long, v double")
    one, many = (arma.fit_arma(df, "v", p=0, q=2, order_cols=["t"], block=b).first() for b in (8192, 37))
    assert np.allclose(one.coef, many.coef, atol=1e-8) and np.isclose(one.rss, many.rss) and np.allclose(one.resid, many.resid, atol=1e-7)


def test_seasonal_terms_forecasts_and_search(spark):
    y = np.array(series(600, 0.0, 0.6, 20.0, seed=7, lag=4))
    df = spark.createDataFrame([(t, float(v)) for t, v in enumerate(y)], "t long, v double")
    fit = model.fit_ar(df, "v", p=0, Q=1, s=4, order_cols=["t"])
    r = fit.first()
    assert r.coef_names == ["const", "sma_1"] and abs(r.coef[1] - 0.6) < 0.08
    ss, e = plain_ss(y, 0, [4], r.coef)
    assert np.isclose(ss, r.rss, rtol=1e-6)
    got = [x.forecast for x in model.forecast_ar(fit, df, "v", 6, ["t"]).orderBy("step").collect()]
    assert np.allclose(got, [r.coef[0] + (r.coef[1] * e[len(y) - 4 + h] if h < 4 else 0.0) for h in range(6)], atol=1e-6)
    grid = [{"p": 1, "d": 0, "q": 0, "trend": "c"}, {"p": 0, "q": 0, "Q": 1, "s": 4, "trend": "c"}, {"p": 0, "q": 1, "trend": "c"}]
    best = tune.ar_search(df, "v", grid, ["t"]).first()
    assert best.candidate == 1 and best.n == 599


def test_differences_gaps_and_short_series(spark):
    y = np.cumsum(series(300, 0.0, 0.5, seed=9))
    rows = [("a", t, float(v)) for t, v in enumerate(y)] + [("gap", t, None if t in (40, 41, 200) else float(v)) for t, v in enumerate(y)] + [("tiny", 0, 1.0), ("tiny", 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = {r.k: r for r in arma.fit_arma(df, "v", p=0, d=1, q=1, order_cols=["t"], key="k", block=50).collect()}
    ss, _ = plain_ss(np.diff(y), 0, [1], got["a"].coef)
    assert np.isclose(ss, got["a"].rss, rtol=1e-6) and abs(got["a"].coef[1] - 0.5) < 0.15
    assert got["gap"].n == 299 - 5 and abs(got["gap"].coef[1] - 0.5) < 0.15
    assert got["tiny"].coef is None
    assert arma.fit_arma(df.limit(0), "v", order_cols=["t"], key="k").collect() == []
