"""Mergeable factors and what rests on them, against plain numpy; workers without the package."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import model, tune
from kiln.operators.factors import Factor, Model, least_squares, partial_factors, solve_factors


def plain(rows, names):
    """Least squares on the rows as they are."""
    x, z = rows[:, :-1], rows[:, -1]
    beta, *_ = np.linalg.lstsq(x, z, rcond=None)
    return beta, float(((z - x @ beta) ** 2).sum())


@pytest.mark.parametrize("cuts", [[], [1], [3, 4, 50], list(range(1, 200, 7))])
def test_merged_factors_give_the_same_fit(cuts):
    rng = np.random.default_rng(1)
    rows = np.column_stack([np.ones(200), rng.normal(size=(200, 3)) * [1, 10, 100] + [5, -3, 7]])
    rows[:, 3] += rows[:, 1] * 2 - rows[:, 2]
    parts = [Factor.of(p) for p in np.split(rows, cuts)]
    total = parts[0]
    for p in parts[1:]:
        total = total.merged(p)
    assert total.n == 200
    for const, names in (({0: 1.0}, ["const", "a", "b"]), (None, ["a", "b"])):
        terms = [*([const] if const else []), {1: 1.0}, {2: 1.0, 1: -1.0}]
        fit = least_squares(total, Model(names, terms, {3: 1.0}))
        x = [*([rows[:, 0]] if const else []), rows[:, 1], rows[:, 2] - rows[:, 1], rows[:, 3]]
        beta, rss = plain(np.column_stack(x), names)
        assert np.allclose(fit.coef, beta, rtol=1e-9) and np.isclose(fit.rss, rss, rtol=1e-9)


def test_dependent_terms_get_zero():
    t = np.arange(20.0)
    total = Factor.of(np.column_stack([np.ones(20), t, 2 * t, np.full(20, 7.0), 3 * t + 1]))
    fit = least_squares(total, Model(["const", "a", "b", "c"], [{0: 1.0}, {1: 1.0}, {2: 1.0}, {3: 1.0}], {4: 1.0}))
    assert np.allclose(fit.coef, [1, 3, 0, 0]) and fit.rss < 1e-20


def _ar1(level, n=1500, seed=4):
    rng = np.random.default_rng(seed)
    x, out = 0.0, []
    for e in rng.normal(size=n):
        x = 0.5 * x + e
        out.append(float(x + level))
    return out


@pytest.mark.parametrize("level, within", [(0.0, 1e-12), (1e4, 1e-9), (1e6, 1e-7), (1e9, 1e-5)])
def test_levels_do_not_change_a_fit(spark, level, within):
    base = np.array(_ar1(0.0))
    y, y1 = base[1:], base[:-1]
    beta, rss = plain(np.column_stack([np.ones(len(y)), y1, y]), None)
    df = spark.createDataFrame([(t, v) for t, v in enumerate(_ar1(level))], "t long, v double").repartition(3)
    r = model.fit_ar(df, "v", p=1, order_cols=["t"], block=200).first()
    assert abs(r.coef[1] - beta[1]) < within and abs(r.sigma2 - rss / len(y)) < within
    assert abs(r.aic - (len(y) * np.log(rss / len(y)) + 6)) < within * 1500
    assert abs(r.coef[0] - (beta[0] + level * (1 - beta[1]))) <= max(within, 1e-12) * max(level, 1)
    best = tune.ar_search(df, "v", [{"p": 0, "d": 1, "trend": "c"}, {"p": 1, "d": 0, "trend": "c"}, {"p": 2, "d": 1}], ["t"]).first()
    assert (best.p, best.d) == (1, 0)


def test_grid_equals_single_fits(spark):
    """One factor serves all candidates, over the rows that all can use."""
    y = np.array(_ar1(1000.0, 120))
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(y)] + [(None, t, float(v)) for t, v in enumerate(y[::-1])] + [("short", 0, 1.0)],
                               "k string, t long, v double")
    grid = [{"p": 1, "d": 0, "trend": "c"}, {"p": 2, "d": 1, "trend": "ct"}, {"p": 0, "P": 1, "s": 4, "trend": None}, {"p": 1, "D": 1, "s": 4, "trend": "c"}]
    got = {(r.k, r.candidate): r for r in model.fit_ar_grid(df, "v", grid, ["t"], key="k").collect()}
    assert len(got) == 12 and all(got["short", i].coef is None and got["short", i].n == 0 for i in range(4))
    reach = 5  # a seasonal difference and one lag
    for key, series in (("a", y), (None, y[::-1])):
        t = np.arange(reach, len(series))
        lag = lambda k: series[t - k]
        d4 = lambda k: lag(k) - lag(k + 4)
        d1 = lambda k: lag(k) - lag(k + 1)
        one = np.ones(len(t))
        want = [[one, lag(1), lag(0)], [one, t, d1(1), d1(2), d1(0)], [lag(4), lag(0)], [one, d4(1), d4(0)]]
        for i, columns in enumerate(want):
            beta, rss = plain(np.column_stack(columns), None)
            assert np.allclose(got[key, i].coef, beta, rtol=1e-6, atol=1e-9) and np.isclose(got[key, i].rss, rss, rtol=1e-9), (key, i)
            assert got[key, i].n == len(t)


def test_hot_key_hands_over_few_rows(spark):
    df = spark.range(20000).select((F.col("id") % 3 == 0).alias("k"), F.rand(1).alias("a"), F.rand(2).alias("b")).repartition(6)
    parts = partial_factors(df, ["k"], [F.col("a"), F.col("b")])
    assert parts.count() <= 12
    n = solve_factors(parts, ["k"], "n bigint", lambda key, f: [{"n": f.n}]).collect()
    assert sum(r.n for r in n) == 20000


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from kiln.session import local_session
spark = local_session(2, 2)
for name in ("m7_ar1_forecast", "x15_pacf_two_lags", "m12_walk_forward"):
    assert entry.queries()[name](spark, {data!r}).count() > 0
from kiln.operators import diagnostics, model
df = spark.createDataFrame([(t, float(t * t % 17)) for t in range(40)], "t long, y double")
assert diagnostics.pacf(df, "y", ["t"]).count() == 11
assert model.forecast_ar(model.fit_ar(df, "y", order_cols=["t"]), df, "y", 3, ["t"]).count() == 3
print("fine")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Run from another folder: only the driver's path has the package."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "job.py"
    script.write_text(SCRIPT.format(repo=repo, data="/root/testdata/sf0.001"))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and "fine" in done.stdout, done.stderr[-2000:]
