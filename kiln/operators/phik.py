"""The correlation phi_k (G7): the correlation of a bivariate normal that, cut at the same margins,
has the observed chi-squared.

Rows only meet in one grouped count. The margins (as many numbers as there are levels, at most
``MOST_LEVELS`` a side) set the cuts; cell probabilities come from Gauss-Legendre nodes inside the
cuts of one variable and the conditional normal of the other; bisection finds the correlation.
Chi-squared of independent variables is about its degrees of freedom, so that much is taken off
first. Numeric columns are cut into quantile bins; levels of others are taken in their order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import q
from kiln.operators.assoc import _with_margins, contingency, decile_bins

MOST_LEVELS = 200
NODES, HALVINGS = 16, 40
#: The correlation that stands for 1.
NEAR_ONE = 1 - 1e-9

_erf = np.vectorize(math.erf, otypes=[float])


def _cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(z / math.sqrt(2)))


def _cuts(margin: Sequence[float]) -> np.ndarray:
    """Standard normal cuts between levels with these shares."""
    share = np.cumsum(margin)[:-1] / np.sum(margin)
    return np.array([NormalDist().inv_cdf(min(max(s, 1e-15), 1 - 1e-15)) for s in share])


def cells(rows: Sequence[float], columns: Sequence[float], rho: float) -> np.ndarray:
    """Cell probabilities of a standard bivariate normal cut at the two margins."""
    p = np.asarray(rows, dtype=float) / np.sum(rows)
    low = np.concatenate([[0.0], np.cumsum(p)[:-1]])
    at, weight = np.polynomial.legendre.leggauss(NODES)
    # nodes in probability: within a level they spread where the variable itself does
    u = low[:, None] + p[:, None] * (at + 1) / 2
    x = np.array([[NormalDist().inv_cdf(min(max(v, 1e-15), 1 - 1e-15)) for v in r] for r in u])
    scaled = (_cuts(columns)[None, None, :] - rho * x[:, :, None]) / math.sqrt(1 - rho * rho)
    below = np.concatenate([np.zeros((*x.shape, 1)), _cdf(scaled), np.ones((*x.shape, 1))], axis=2)
    return p[:, None] * (np.diff(below, axis=2) * weight[None, :, None] / 2).sum(axis=1)


def mean_square(rows: Sequence[float], columns: Sequence[float], rho: float) -> float:
    """Chi-squared over n of the bivariate normal's cells."""
    alone = np.outer(np.asarray(rows) / np.sum(rows), np.asarray(columns) / np.sum(columns))
    return float(((cells(rows, columns, rho) - alone) ** 2 / alone).sum())


def correlation_of(chi2: float, n: float, rows: Sequence[float], columns: Sequence[float]) -> float:
    """The correlation whose cells have the chi-squared that the noise leaves."""
    if len(rows) < 2 or len(columns) < 2:
        return 0.0
    wanted = (chi2 - (len(rows) - 1) * (len(columns) - 1)) / n
    if wanted <= 0:
        return 0.0
    if wanted >= mean_square(rows, columns, NEAR_ONE):
        return 1.0
    low, high = 0.0, NEAR_ONE
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        low, high = (mid, high) if mean_square(rows, columns, mid) < wanted else (low, mid)
    return (low + high) / 2


def phi_k(df: DataFrame, a: str, b: str, numeric: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """(a, b, phi_k) in 0..1; rows with a NULL in either column do not count, a column with one level
    gives 0, an empty table NULL. More than ``MOST_LEVELS`` levels are an error: bin the column."""
    sides = [decile_bins(df, c, bins) if c in numeric else q(c) for c in (a, b)]
    counted = _with_margins(contingency(df, *sides), []).persist()
    try:
        whole = counted.agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("_rx") * F.col("_cy")).cast("double")).alias("s"),
                            F.approx_count_distinct("x").alias("r"), F.approx_count_distinct("y").alias("k")).first()
        if max(whole["r"], whole["k"]) > 2 * MOST_LEVELS:
            raise ValueError(f"phi_k of columns with more than {MOST_LEVELS} levels")
        margins = [[r["m"] for r in counted.groupBy(side).agg(F.first(total).alias("m")).orderBy(F.expr(f"try_cast({side} as double)"), side).limit(MOST_LEVELS + 1).collect()]
                   for side, total in (("x", "_rx"), ("y", "_cy"))]
    finally:
        counted.unpersist()
    if max(map(len, margins)) > MOST_LEVELS:
        raise ValueError(f"phi_k of columns with more than {MOST_LEVELS} levels")
    value = correlation_of(whole["n"] * (whole["s"] - 1), whole["n"], *margins) if whole["n"] else None
    return df.sparkSession.createDataFrame([(a, b, value)], "a string, b string, phi_k double")
