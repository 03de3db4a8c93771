"""Distribution tails against finite sums in exact or plain arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.functions.special import beta_inc, chi2_upper, f_upper, gamma_upper, normal_two_sided, stirling_rest, t_two_sided
from kiln.operators import assoc


def close(got, want, within=1e-10):
    return all((g is None and w is None) or abs(g - w) <= within * max(abs(w), 1e-3) for g, w in zip(got, want)) and len(got) == len(want)


def column(spark, rows, names, expr):
    schema = ", ".join(f"{n} double" for n in names)
    return [r.v for r in spark.createDataFrame([tuple(map(float, r)) for r in rows], schema).coalesce(1).select(expr.alias("v")).collect()]


def student(t, dof):
    """Two-sided tail by the finite trigonometric sums for whole degrees of freedom."""
    theta = math.atan(abs(t) / math.sqrt(dof))
    c2, total, term = math.cos(theta) ** 2, 0.0, 1.0
    if dof % 2:
        terms = []
        term = math.cos(theta)
        for k in range(1, dof - 1, 2):
            terms.append(term)
            term *= c2 * (k + 1) / (k + 2)
        return 1 - 2 / math.pi * (theta + math.sin(theta) * math.fsum(terms))
    terms = []
    for k in range(0, dof, 2):
        terms.append(term)
        term *= c2 * (k + 1) / (k + 2)
    return 1 - math.sin(theta) * math.fsum(terms)


def binomial_beta(a, b, x):
    """I_x(a, b) for whole a, b, as an exact sum."""
    x = Fraction(x)
    return float(sum(math.comb(a + b - 1, j) * x ** j * (1 - x) ** (a + b - 1 - j) for j in range(a, a + b)))


def chi(x, dof):
    if dof % 2 == 0:
        return math.exp(-x / 2) * math.fsum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))
    out = math.erfc(math.sqrt(x / 2))
    return out + math.exp(-x / 2) * math.fsum((x / 2) ** (k - 0.5) / math.gamma(k + 0.5) for k in range(1, (dof + 1) // 2))


def test_incomplete_beta(spark):
    rows = [(a, b, x) for a in (1, 2, 7, 40) for b in (1, 3, 25, 60) for x in (0.001, 0.1, 0.4, 0.5, 0.75, 0.999)]
    assert close(column(spark, rows, "abx", beta_inc(F.col("a"), F.col("b"), F.col("x"))), [binomial_beta(a, b, x) for a, b, x in rows])
    edge = [(2, 3, 0), (2, 3, 1), (2, 3, -1), (2, 3, 2)]
    assert column(spark, edge, "abx", beta_inc(F.col("a"), F.col("b"), F.col("x"))) == [0, 1, 0, 1]


def test_incomplete_gamma(spark):
    rows = [(x, k) for k in (1, 2, 3, 10, 31, 60) for x in (0.01, 0.5, 1, 3, 9.7, 30, 80, 200)]
    assert close(column(spark, rows, "xk", chi2_upper(F.col("x"), F.col("k"))), [chi(x, k) for x, k in rows])
    z = [(v,) for v in (0, 0.1, -1, 1.96, 3, -5, 8)]
    assert close(column(spark, z, "z", normal_two_sided(F.col("z"))), [math.erfc(abs(v) / math.sqrt(2)) for v, in z])
    # relative accuracy far out
    far = column(spark, [(8.0,), (20.0,)], "z", normal_two_sided(F.col("z")))
    assert all(abs(g / math.erfc(v / math.sqrt(2)) - 1) < 1e-10 for g, v in zip(far, (8.0, 20.0)))
    assert column(spark, [(2, 0), (2, -1), (2, math.inf)], "ax", gamma_upper(F.col("a"), F.col("x"))) == [1, 1, 0]


def test_student_and_f(spark):
    rows = [(t, k) for k in (1, 2, 3, 8, 29, 120, 2001) for t in (0.0, 0.01, -0.7, 1.5, 2.5, 9.0)]
    assert close(column(spark, rows, "tk", t_two_sided(F.col("t"), F.col("k"))), [student(t, k) for t, k in rows])
    rows = [(f, a, b) for a in (2, 4, 10) for b in (2, 6, 40) for f in (0.1, 1.0, 2.7, 12.0)]
    assert close(column(spark, rows, "fab", f_upper(F.col("f"), F.col("a"), F.col("b"))), [binomial_beta(b // 2, a // 2, Fraction(b) / (b + a * Fraction(f))) for f, a, b in rows])


@pytest.mark.parametrize("dof", [1e4, 1e6, 1e8])
def test_many_degrees_of_freedom(spark, dof):
    if dof < 1e7:
        got = column(spark, [(t, dof) for t in (0.5, 2.0, 4.0)], "tk", t_two_sided(F.col("t"), F.col("k")))
        assert all(abs(g - student(t, int(dof))) < 1e-10 for t, g in zip((0.5, 2.0, 4.0), got))
    f2 = column(spark, [(1.3, 2.0, dof)], "fab", f_upper(F.col("f"), F.col("a"), F.col("b")))[0]
    assert abs(f2 / math.exp(-dof / 2 * math.log1p(2 * 1.3 / dof)) - 1) < 1e-9


def test_stirling_rest(spark):
    values = (0.5, 1.0, 2.5, 11.9, 12.0, 150.0, 1e7)
    got = column(spark, [(v,) for v in values], "a", stirling_rest(F.col("a")))
    for v, g in zip(values, got):
        want = math.lgamma(v) - ((v - 0.5) * math.log(v) - v + 0.5 * math.log(2 * math.pi))
        assert abs(g + -want) < 1e-13 * max(1.0, abs(math.lgamma(v))) or abs(g - want) < 1e-13 * max(1.0, abs(math.lgamma(v)))


def test_tests_return_p_values(spark):
    rng = np.random.default_rng(4)
    rows = [(("a", "b", "c")[i % 3], float(round(rng.normal() * 3 + (i % 3 == 0), 1)), float(rng.normal()), "uv"[int(rng.random() < 0.4)]) for i in range(240)]
    df = spark.createDataFrame(rows + [(None, 1.0, None, "u"), ("a", None, 1.0, None)], "g string, x double, y double, h string")
    x = {g: np.array([r[1] for r in rows if r[0] == g]) for g in "abc"}
    w = assoc.welch_t(df, "x", "g", "a", "b").first()
    se = x["a"].var(ddof=1) / 80, x["b"].var(ddof=1) / 80
    assert abs(w.statistic - (x["a"].mean() - x["b"].mean()) / math.sqrt(sum(se))) < 1e-9
    lo, hi = student(w.statistic, math.floor(w.dof)), student(w.statistic, math.floor(w.dof) + 1)
    assert min(lo, hi) <= w.p_value <= max(lo, hi)
    f = assoc.anova_f(df, "x", "g").first()
    assert abs(f.p_value - (1 + 2 * f.statistic / f.df_within) ** (-f.df_within / 2)) < 1e-10
    k = assoc.kruskal_h(df, "x", "g").first()
    assert abs(k.p_value - math.exp(-k.statistic / 2)) < 1e-12
    c = assoc.chi2_test(df, "g", "h").first()
    assert abs(c.p_value - math.exp(-c.statistic / 2)) < 1e-12
    r = assoc.pearson_test(df, "x", "y").first()
    assert abs(r.p_value - student(r.statistic, r.dof)) < 1e-10 and assoc.pearson_test(df, "x", "x").first().p_value == 0.0
    # Mann-Whitney with ties: variance from the ranks themselves
    sub = df.filter("g in ('a', 'b')")
    u = assoc.mann_whitney_u(sub, "x", "g", "a").first()
    both = np.concatenate([x["a"], x["b"]])
    ranks = np.array([(both < v).sum() + ((both == v).sum() + 1) / 2 for v in both])
    want_u = ranks[:80].sum() - 80 * 81 / 2
    sd = math.sqrt(80 * 80 / (160 * 159) * ((ranks - ranks.mean()) ** 2).sum())
    assert u.statistic == want_u and abs(u.p_value - math.erfc((abs(want_u - 3200) - 0.5) / sd / math.sqrt(2))) < 1e-10
    flat = df.withColumn("x", F.lit(1.0))
    assert assoc.mann_whitney_u(flat, "x", "g", "a").first().p_value is None and assoc.kruskal_h(flat, "x", "g").first().p_value is None


def test_ks_against_the_fitted_normal(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(5, 2, size=300)
    got = assoc.ks_normal_test(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    s = np.sort(x)
    cdf = np.array([0.5 * math.erfc(-(v - x.mean()) / x.std(ddof=1) / math.sqrt(2)) for v in s])
    d = max((np.arange(1, 301) / 300 - cdf).max(), (cdf - np.arange(300) / 300).max())
    assert abs(got.statistic - d) < 1e-9 and got.p_value > 0.2
    skewed = assoc.ks_normal_test(spark.createDataFrame([(float(v),) for v in np.exp(rng.normal(size=300))], "x double"), "x").first()
    assert skewed.p_value < 0.01
