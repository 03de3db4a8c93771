"""Distribution tails as column expressions: incomplete beta and gamma functions.

Continued fractions are evaluated from their tail inwards, by ``aggregate`` over a sequence whose
length follows the parameters (it grows with their square root), so nothing is iterated until it
settles. Powers over gamma functions are taken together: with Stirling's formula divided out, what
is left is ``a log(1 + u / a)``-like terms that do not cancel, and a small rest. Relative errors stay
below 1e-10 for parameters up to 1e8 or so.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of a fraction or series: FEW and so many times the square root of its larger parameter.
FEW, PER_ROOT, MOST = 100, 14, 2_000_000


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _terms(*sizes: Column) -> Column:
    largest = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    return F.least(F.lit(MOST), F.lit(FEW) + F.ceil(PER_ROOT * F.sqrt(largest))).cast("int")


def stirling_rest(a: Column) -> Column:
    """log Gamma(a) less (a - 1/2) log a - a + log(2 pi) / 2, for a > 0."""
    def series(x: Column) -> Column:
        r = 1 / (x * x)
        return (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * 691 / 360360))))) / x

    def small(x: Column) -> Column:
        far = x + 12
        logs = F.log(x)
        for i in range(1, 12):
            logs = logs + F.log(x + i)
        whole = (far - 0.5) * F.log(far) - far + series(far) - logs
        return whole - ((x - 0.5) * F.log(x) - x)

    return F.when(a >= 12, series(a)).otherwise(small(a))


def beta_inc(a: Column, b: Column, x: Column, y: Column | None = None) -> Column:
    """The regularised incomplete beta function I_x(a, b); ``y`` = 1 - x if known more exactly."""
    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    y = (1 - x) if y is None else y.cast("double")

    def fraction(a: Column, b: Column, x: Column, y: Column) -> Column:
        u = F.when(x < y, x * (a + b) - a).otherwise(b - y * (a + b))  # the one that rounds less
        power = F.sqrt(a * b / (2 * math.pi * (a + b))) * F.exp(a * F.log1p(u / a) + b * F.log1p(-u / b) + stirling_rest(a + b) - stirling_rest(a) - stirling_rest(b))

        def inwards(value: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
            return 1 + odd / (1 + even / value)

        steps = F.sequence(_terms(a, b), F.lit(1), F.lit(-1)).cast("array<double>")
        return power / a / F.aggregate(steps, F.lit(1.0), inwards)

    def value(v: Column) -> Column:
        a, b, x, y = (v[c] for c in ("a", "b", "x", "y"))
        direct = F.when(x <= (a + 1) / (a + b + 2), fraction(a, b, x, y)).otherwise(1 - fraction(b, a, y, x))
        return F.when(x <= 0, 0.0).when(y <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), direct)))

    known = a.isNotNull() & b.isNotNull() & x.isNotNull() & ~F.isnan(x) & (a > 0) & (b > 0)
    return F.when(known, _with(F.struct(a.alias("a"), b.alias("b"), x.alias("x"), y.alias("y")), value))


def gamma_upper(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x)."""
    a, x = a.cast("double"), x.cast("double")

    def value(v: Column) -> Column:
        a, x = v["a"], v["x"]
        u = x - a
        power = F.sqrt(a / (2 * math.pi)) * F.exp(a * F.log1p(u / a) - u - stirling_rest(a))
        n = _terms(a)
        # below a + 1: the series of P; each step is 1 / a_m + x / a_m * (the rest)
        series = F.aggregate(F.sequence(n, F.lit(0), F.lit(-1)).cast("array<double>"), F.lit(0.0), lambda rest, m: (1 + x * rest) / (a + m))
        fraction = F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)).cast("array<double>"), x + 2 * n + 1 - a, lambda rest, m: x + 2 * m - 1 - a - m * (m - a) / rest)
        tail = F.when(x < a + 1, 1 - power * series).otherwise(power / fraction)
        return F.when(x <= 0, 1.0).when(x == float("inf"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))

    known = a.isNotNull() & x.isNotNull() & ~F.isnan(x) & (a > 0)
    return F.when(known, _with(F.struct(a.alias("a"), x.alias("x")), value))


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) of Student's distribution."""
    t, dof = t.cast("double"), dof.cast("double")
    whole = dof + t * t
    return F.when(F.abs(t) == float("inf"), F.lit(0.0)).otherwise(beta_inc(dof / 2, F.lit(0.5), dof / whole, t * t / whole))


def f_upper(f: Column, d1: Column, d2: Column) -> Column:
    """P(F >= f) with (d1, d2) degrees of freedom."""
    f, d1, d2 = (c.cast("double") for c in (f, d1, d2))
    whole = d2 + d1 * f
    return F.when(f == float("inf"), F.lit(0.0)).otherwise(beta_inc(d2 / 2, d1 / 2, d2 / whole, d1 * f / whole))


def chi2_upper(x: Column, dof: Column) -> Column:
    """P(X >= x) of the chi-squared distribution."""
    return gamma_upper(dof.cast("double") / 2, x.cast("double") / 2)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of the standard normal distribution."""
    return gamma_upper(F.lit(0.5), z.cast("double") * z.cast("double") / 2)
