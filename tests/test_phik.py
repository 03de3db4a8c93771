"""phi_k against planted correlations and a plain sum over a fine grid."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import phik, windows


@pytest.mark.parametrize("rho", [0.0, 0.3, -0.6, 0.95])
def test_cells_are_probabilities_of_the_normal(rho):
    rows, columns = [3, 1, 4, 2], [5, 5, 1]
    p = phik.cells(rows, columns, rho)
    assert np.allclose(p.sum(axis=1), np.array(rows) / 10, atol=1e-12) and np.allclose(p.sum(axis=0), np.array(columns) / 11, atol=2e-4)
    grid = np.linspace(-8, 8, 1601)
    x, y = np.meshgrid(grid, grid, indexing="ij")
    density = np.exp(-(x * x - 2 * rho * x * y + y * y) / (2 * (1 - rho * rho))) / (2 * math.pi * math.sqrt(1 - rho * rho)) * 0.01 ** 2
    i, j = np.searchsorted(phik._cuts(rows), x), np.searchsorted(phik._cuts(columns), y)
    plain = np.array([[density[(i == a) & (j == b)].sum() for b in range(3)] for a in range(4)])
    assert np.abs(plain - p).max() < 5e-3


def test_chi_squared_rises_with_the_correlation():
    values = [phik.mean_square([1] * 8, [2, 1, 1, 3], r) for r in (0, 0.1, 0.3, 0.5, 0.8, 0.95, 0.999)]
    assert values[0] < 1e-9 and all(a < b for a, b in zip(values, values[1:]))


@pytest.mark.parametrize("rho", [0.0, 0.3, 0.9])
def test_planted_correlations_are_recovered(spark, rho):
    rng = np.random.default_rng(8)
    x = rng.normal(size=40000)
    y = rho * x + math.sqrt(1 - rho * rho) * rng.normal(size=40000)
    df = spark.createDataFrame([(float(a), float(b), "abcd"[int(np.searchsorted([-1, 0, 1], b))]) for a, b in zip(x, y)] + [(None, 1.0, "a"), (1.0, None, None)],
                               "x double, y double, c string")
    assert abs(phik.phi_k(df, "x", "y", numeric=["x", "y"]).first().phi_k - rho) < 0.02
    assert abs(phik.phi_k(df, "x", "c", numeric=["x"]).first().phi_k - rho) < 0.02


def test_limits(spark):
    df = spark.createDataFrame([(k % 3, k % 3, 1, k) for k in range(900)], "a int, b int, one int, id int")
    assert phik.phi_k(df, "a", "b").first().phi_k > 0.9999 and phik.phi_k(df, "a", "one").first().phi_k == 0.0
    assert phik.phi_k(df.limit(0), "a", "b").first().phi_k is None
    with pytest.raises(ValueError):
        phik.phi_k(df, "a", "id")


def test_context_window_warnings(spark):
    df = spark.createDataFrame([(t, None if t == 5 else float(t)) for t in range(30)], "t long, v double")
    with pytest.warns(UserWarning) as seen:
        assert windows.context_windows(df, ["v"], 4, 2, ["t"]).count() == 25
    said = " ".join(str(w.message) for w in seen)
    assert "NULL" in said and "25 windows" in said
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("error")
        windows.context_windows(df.filter("v is not null").select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"), (F.col("t") * 10 + F.col("k")).alias("t"), "v"), ["v"], 4, 2, ["t"])
