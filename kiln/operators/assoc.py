"""Association measures and hypothesis-test statistics.

Everything is computed from grouped counts or sums: contingency tables for categorical
pairs, value-rank tables for rank measures (average ranks from prefix sums over distinct
values, never a global row window), and the Kendall pair counts from radix counts of the value
ranks (no pair of rows or cells is ever materialised).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import q
from kiln.functions.quantiles import exact_quantiles
from kiln.functions.special import chi2_upper, f_upper, normal_two_sided, t_two_sided
from kiln.operators import order
from kiln.operators.inversions import inversions
from kiln.operators.order import assign_row_id, join_small, keys_of, look_up, running_sum, running_sums, written


def _pairs(cols: Sequence) -> list[tuple]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def _matrix(pairs_df: DataFrame, diagonal: DataFrame, value: str) -> DataFrame:
    """Full symmetric (a, b, value) matrix from the upper triangle and the diagonal."""
    mirror = pairs_df.select(F.col("b").alias("a"), F.col("a").alias("b"), value)
    return pairs_df.select("a", "b", value).unionByName(mirror).unionByName(diagonal.select("a", "b", value))


def _diagonal(df: DataFrame, cols: Sequence[str], value: str) -> DataFrame:
    """1 for columns that vary, NULL for constant and empty ones (one aggregate)."""
    row = df.agg(*[(F.min(q(c)) < F.max(q(c))).alias(f"v{i}") for i, c in enumerate(cols)])
    arr = F.array(*[F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.when(F.col(f"v{i}"), F.lit(1.0)).alias(value))
                    for i, c in enumerate(cols)])
    return row.select(F.explode(arr).alias("r")).select("r.*")


def _safe_corr(a, b):
    """Pearson correlation of complete pairs; NULL where a side is constant or there is no pair."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


# ----------------------------------------------------------------------------- G3
def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """(a, b, corr) over all ordered pairs; pairwise-complete rows; NULL for constants."""
    if method == "spearman":
        return spearman_matrix(df, cols)
    if method == "kendall":
        recs = None
        for a, b in _pairs(cols):
            k = kendall_tau(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("tau_b").alias("corr"))
            recs = k if recs is None else recs.unionByName(k)
        return _matrix(recs, _diagonal(df, cols, "corr"), "corr")
    return _matrix(_pearson_pairs(df, _pairs(cols)), _diagonal(df, cols, "corr"), "corr")


def _pearson_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    row = df.agg(*[_safe_corr(q(a), q(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"))
                    for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(arr).alias("r")).select("r.*")


# ----------------------------------------------------------------------------- G4
def rank_table(df: DataFrame, col: str, key=None) -> DataFrame:
    """(keys, value, avg_rank): average 1-based rank of every distinct non-null value."""
    keys = keys_of(key)
    v = df.filter(q(col).isNotNull()).groupBy(*keys, q(col).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    v = assign_row_id(v, ["_v"], key=keys, row_id="_r")
    v = running_sum(v, keys, "_r", "_c", "_cum")
    return v.select(*keys, "_v", (F.col("_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias("_rank"))


def _value_ranks(x: DataFrame, cols: Sequence[str], beside: Sequence[str]) -> DataFrame:
    """(col, v, n, r, n_{c}, r_{c} ..): of every value of the columns ``cols`` of ``x`` its rows and average
    rank, and for each c of ``beside`` the same among the rows where c is known."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("v")) for c in cols]))
    u = x.select(cells.alias("u"), *[F.col(c).isNotNull().alias(f"k_{c}") for c in beside]).select("u.*", *[f"k_{c}" for c in beside])
    counts = u.filter("v is not null").groupBy("col", "v").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"k_{c}")).alias(f"n_{c}") for c in beside])
    placed = assign_row_id(written(counts, "counts"), ["v"], key=["col"], row_id="at")
    of = ["", *[f"_{c}" for c in beside]]
    summed = running_sums(placed, ["col"], "at", {f"upto{s}": f"n{s}" for s in of})
    return written(summed.select("col", "v", *[f"n{s}" for s in of], *[(F.col(f"upto{s}") - F.col(f"n{s}") + (F.col(f"n{s}") + 1) / 2.0).alias(f"r{s}") for s in of]), "ranks")


def _joined(a: tuple, b: tuple) -> tuple:
    """The (rows, squares of their centred ranks, sum of the other side, its product with the centred
    ranks) of two runs of values, ``b`` behind ``a``. Ranks of a run are centred on its own mean."""
    n, m = a[0], b[0]
    return n + m, a[1] + b[1] + n * m * (n + m) / 4.0, a[2] + b[2], a[3] + b[3] + (n * b[2] - m * a[2]) / 2.0


def _rank_products(values: DataFrame, sides: int) -> list[tuple]:
    """``values`` (v, n0, s0, n1, s1 ..: a row per value) in order of v: for each side the ``_joined`` sums
    of the n rows of a value at their average rank. Every range partition is read as a stream and
    leaves one row; those are joined in order."""
    def run(batches):
        part, sums = TaskContext.get().partitionId(), [(0, 0.0, 0.0, 0.0)] * sides
        for batch in batches:
            for i in range(sides):
                n, s = (batch.column(2 * i + j).to_numpy().astype(np.float64) for j in range(2))
                rows = int(n.sum())
                rank = np.cumsum(n) - n / 2 - rows / 2
                sums[i] = _joined(sums[i], (rows, float(n @ (rank * rank)), float(s.sum()), float(rank @ s)))
        for i, of in enumerate(sums):
            yield pa.RecordBatch.from_pydict(dict(zip(["part", "side", "n", "q", "s", "p"], [[v] for v in (part, i, *of)])),
                                             pa.schema([("part", pa.int32()), ("side", pa.int32()), ("n", pa.int64()), *[(c, pa.float64()) for c in "qsp"]]))

    ordered = values.repartitionByRange("v").sortWithinPartitions("v").drop("v")
    out = [(0, 0.0, 0.0, 0.0)] * sides
    for r in sorted(ordered.mapInArrow(run, "part int, side int, n long, q double, s double, p double").collect()):
        out[r["side"]] = _joined(out[r["side"]], (r["n"], r["q"], r["s"], r["p"]))
    return out


def _corr_with(ranked: DataFrame, last: str, others: dict[str, str], ranks: DataFrame, beside: Sequence[str], seen) -> dict[str, float | None]:
    """Correlation of the ranks of ``last``, not looked up, with each of ``others`` (columns, with those of
    their ranks in ``ranked``): rows are grouped by the value of ``last`` with the sums of the other
    ranks, and the grouped values alone are put in order."""
    half = {c: (min(seen[c], seen[last]) + 1) / 2.0 for c in others}  # about the mean: only keeps sums small
    values = ranked.filter(F.col(last).isNotNull()).groupBy(F.col(last).alias("v")).agg(
        *[e for i, (c, r) in enumerate(others.items()) for e in (
            F.count(F.col(r) if c in beside else F.lit(1)).alias(f"n{i}"), F.coalesce(F.sum(F.col(r) - half[c]), F.lit(0.0)).alias(f"s{i}"))])
    sums = _rank_products(values, len(others))
    s = f"_{last}" if last in beside else ""
    row = ranks.agg(*[F.sum(F.when(F.col("col") == c, F.col(f"n{s}") * (F.col(f"r{s}") - (of[0] + 1) / 2.0) ** 2)).alias(c) for c, of in zip(others, sums)]).first()
    both = {c: math.sqrt(of[1]) * math.sqrt(row[c] or 0.0) for c, of in zip(others, sums)}
    return {c: max(-1.0, min(1.0, of[3] / both[c])) if both[c] > 0 else None for c, of in zip(others, sums)}


def spearman_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of average ranks over the complete rows of each pair. The values of the
    columns are ranked at once, also among the rows where another column is known; then every
    row looks up its ranks, column by column. The column of most values, if they are too many to
    broadcast, is not looked up: its rows are grouped by value (``_corr_with``). Constant columns
    take no part."""
    x = df.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    seen = x.agg(F.count(F.lit(1)).alias("n"), *[e for c in x.columns for e in (
        F.count(c).alias(c), (F.min(c) < F.max(c)).alias(f"varies_{c}"), F.approx_count_distinct(c).alias(f"values_{c}"))]).first()
    vary = sorted((c for c in x.columns if seen[f"varies_{c}"]), key=lambda c: -seen[f"values_{c}"])
    beside = [c for c in vary if seen[c] < seen["n"]]
    last = vary[0] if len(vary) > 1 and seen[f"values_{vary[0]}"] > order.LOOKUP_MAX_ROWS else None
    looked = [c for c in vary if c != last]
    side = lambda c, d: f"{c}|{d if d in beside else ''}"
    found, row = {}, df.sparkSession.range(1)
    if len(vary) > 1:
        ranks, ranked = _value_ranks(x, looked, beside), x.select(*vary)
        for c in looked:
            of = {side(c, d): f"r_{d}" if d in beside else "r" for d in vary if d != c}
            own = ranks.filter(F.col("col") == c).select("v", "n", *[F.col(r).alias(name) for name, r in of.items()])
            ranked = look_up(ranked, c, own, "v", "n", seen["n"], list(of)).drop(c)
        found = {(c, d): _safe_corr(F.col(side(c, d)), F.col(side(d, c))) for c, d in _pairs(looked)}
        if found:
            row = ranked.agg(*[e.alias(f"p{k}") for k, e in enumerate(found.values())])
        found = {p: F.col(f"p{k}") for k, p in enumerate(found)}
        if last:
            found |= {(c, last): F.lit(v) for c, v in _corr_with(ranked, last, {c: side(c, last) for c in looked}, ranks, beside, seen).items()}
    value = lambda i, j: found.get((f"c{i}", f"c{j}"), found.get((f"c{j}", f"c{i}"), F.lit(None))).cast("double")
    arr = F.array(*[F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), value(i, j).alias("corr")) for i, j in _pairs(range(len(cols)))])
    return _matrix(row.select(F.explode(arr).alias("r")).select("r.*"), _diagonal(df, cols, "corr"), "corr")


# ----------------------------------------------------------------------------- G5
def kendall_tau(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall tau-b for columns of any number of distinct values, without pairs of rows.

    Cells (x, y) are put in order of x, then y; a pair is discordant when the later cell has
    the smaller y, an inversion of the y ranks (``operators.inversions``: a copy of a cell per
    byte of the ranks, streamed through tables of 256 counts). Ties come from the margins,
    concordant pairs from the total."""
    cells = written(df.filter(q(a).isNotNull() & q(b).isNotNull()).groupBy(
        q(a).cast("double").alias("x"), q(b).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("c")), "cells")
    ys = assign_row_id(cells.groupBy("y").agg(F.sum("c").alias("t")), ["y"], row_id="_ry")
    tied = F.sum(F.col("t") * (F.col("t") - 1) / 2)
    c = F.col("c")
    tot = cells.agg(F.sum("c").alias("n"), F.sum(c * (c - 1) / 2).alias("both")).first()
    n1 = cells.groupBy("x").agg(F.sum("c").alias("t")).agg(tied).first()[0] or 0.0
    of_y = ys.agg(tied.alias("v"), F.count(F.lit(1)).alias("k")).first()
    n2 = of_y["v"] or 0.0
    n0 = float(tot["n"] or 0) * (float(tot["n"] or 0) - 1) / 2
    ranked = join_small(cells, ys.select("y", "_ry"), ["y"])
    disc = inversions(ranked, ["x", "y"], "_ry", "c", of_y["k"]).select(F.col("inversions").cast("double").alias("D"))
    conc = F.lit(n0 - n1 - n2 + float(tot["both"] or 0.0)) - F.col("D")
    den = math.sqrt((n0 - n1) * (n0 - n2))
    tau = (conc - F.col("D")) / F.lit(den) if den > 0 else F.lit(None).cast("double")
    return disc.select(conc.cast("bigint").alias("concordant"), F.col("D").cast("bigint").alias("discordant"), tau.alias("tau_b"))


# ----------------------------------------------------------------------------- G6 / G7 / G9
def contingency(df: DataFrame, a, b, by=None) -> DataFrame:
    keys = keys_of(by)
    ca = q(a) if isinstance(a, str) else a
    cb = q(b) if isinstance(b, str) else b
    return df.filter(ca.isNotNull() & cb.isNotNull()).groupBy(*keys, ca.cast("string").alias("x"),
                                                             cb.cast("string").alias("y")) \
             .agg(F.count(F.lit(1)).alias("o"))


def _with_margins(cells: DataFrame, keys) -> DataFrame:
    """Cells with their margins ``_rx`` and ``_cy``, joined from grouped sums."""
    rx = cells.groupBy(*keys, "x").agg(F.sum("o").alias("_rx"))
    cy = cells.groupBy(*keys, "y").agg(F.sum("o").alias("_cy"))
    return join_small(join_small(cells, rx, [*keys, "x"]), cy, [*keys, "y"])


def chi_square(cells: DataFrame, keys=None) -> DataFrame:
    """Pearson chi-square over a contingency table (keys, x, y, o) from its margins (cells
    with zero count included implicitly): n * sum(o^2 / (rx cy)) - n. Returns chi2, n, r, k."""
    keys = keys_of(keys)
    o = F.col("o")
    agg = _with_margins(cells, keys).groupBy(*keys).agg(
        F.sum(o * o / (F.col("_rx").cast("double") * F.col("_cy"))).alias("_s"), F.sum("o").alias("n"),
        F.count_distinct("x").alias("r"), F.count_distinct("y").alias("k"))
    return agg.select(*keys, (F.col("n") * F.col("_s") - F.col("n")).alias("chi2"), F.col("n").cast("bigint").alias("n"),
                      F.col("r").cast("bigint").alias("r"), F.col("k").cast("bigint").alias("k"))


def _bergsma(n, r, k, chi2):
    """Bias-corrected Cramer's V; NULL where a side has one value or there is one row."""
    over = lambda x: F.try_divide(x, n - 1)
    phi2c = F.greatest(F.lit(0.0), chi2 / n - over((k - 1) * (r - 1)))
    den = F.least(k - over((k - 1) * (k - 1)) - 1, r - over((r - 1) * (r - 1)) - 1)
    return F.when(den > 0, F.sqrt(F.try_divide(phi2c, den)))


def cramers_v(df: DataFrame, a: str, b: str, by=None) -> DataFrame:
    """Bias-corrected Cramer's V (Bergsma)."""
    keys = keys_of(by)
    ch = chi_square(contingency(df, a, b, keys), keys)
    return ch.select(*keys, F.lit(a).alias("a"), F.lit(b).alias("b"),
                     _bergsma(F.col("n"), F.col("r"), F.col("k"), F.col("chi2")).alias("cramers_v"))


def decile_bins(df: DataFrame, col: str, bins: int = 10, method: str = "exact") -> F.Column:
    """Bin index 0..bins-1 by the column's quantile cut points (x > cut counts)."""
    probs = [i / bins for i in range(1, bins)]
    row = exact_quantiles(df, col, probs, method=method).first()
    cuts = [row[f"q{i}"] for i in range(len(probs))]
    expr = F.lit(0)
    for cval in cuts:
        if cval is not None:
            expr = expr + F.when(q(col) > F.lit(float(cval)), 1).otherwise(0)
    return F.when(q(col).isNotNull(), expr)


def contingency_coefficient(df: DataFrame, a: str, b: str, numeric: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """phi_k stand-in: numerics binned into quantile bins, then sqrt(chi2 / (chi2 + n))."""
    ca = decile_bins(df, a, bins) if a in numeric else q(a)
    cb = decile_bins(df, b, bins) if b in numeric else q(b)
    ch = chi_square(contingency(df, ca, cb))
    return ch.select(F.lit(a).alias("a"), F.lit(b).alias("b"),
                     F.sqrt(F.col("chi2") / (F.col("chi2") + F.col("n"))).alias("contingency"))


def uncertainty_coefficient(df: DataFrame, x: str, y: str) -> DataFrame:
    """Theil's U(x|y) = (H(x) - H(x|y)) / H(x), natural logs; 1 when H(x) = 0."""
    c, o = _with_margins(contingency(df, x, y), []), F.col("o")
    # H(x|y) = -sum o/n log(o/n_y); H(x) = log n - sum over cells o/n log(n_x)
    h = c.agg(F.sum(-o * F.log(o / F.col("_cy"))).alias("a"), F.sum(o * F.log(F.col("_rx").cast("double"))).alias("b"), F.sum("o").alias("n"))
    hxy, hx = F.col("a") / F.col("n"), F.log(F.col("n").cast("double")) - F.col("b") / F.col("n")
    return h.select(F.lit(x).alias("x"), F.lit(y).alias("y"),
                    F.when(hx.between(-1e-12, 1e-12), F.lit(1.0)).otherwise(F.try_divide(hx - hxy, hx)).alias("uncertainty"))


def _group_squares(df: DataFrame, cat: str, num: str) -> DataFrame:
    """One row: groups k, rows N, between-group and within-group sums of squares. Both are sums
    of squared deviations, so large means do not cancel."""
    x = df.filter(q(cat).isNotNull() & q(num).isNotNull())
    v = q(num).cast("double")
    mean = x.agg(F.avg(v)).first()[0]
    g = x.groupBy(q(cat)).agg(F.count(F.lit(1)).alias("n"), F.avg(v - F.lit(mean or 0.0)).alias("m"), F.var_pop(v).alias("s"))
    return g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ssb"),
                 F.sum(F.col("n") * F.col("s")).alias("ssw"))


def correlation_ratio(df: DataFrame, cat: str, num: str) -> DataFrame:
    """eta = sqrt(between-group SS / total SS)."""
    ssb, sst = F.col("ssb"), F.col("ssb") + F.col("ssw")
    return _group_squares(df, cat, num).select(
        F.lit(cat).alias("category"), F.lit(num).alias("numeric"),
        F.when(sst > 0, F.sqrt(F.try_divide(ssb, sst))).otherwise(F.lit(0.0)).alias("eta"))


# ----------------------------------------------------------------------------- G8
def associations(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], bins: int = 10) -> DataFrame:
    """'auto': Spearman for numeric pairs, Cramer's V when a categorical is involved
    (the numeric side discretised into quantile bins). (a, b, method, value)."""
    parts = []
    if len(numeric) >= 2:
        sp = spearman_matrix(df, numeric).filter(F.col("a") < F.col("b"))
        parts.append(sp.select("a", "b", F.lit("spearman").alias("method"), F.col("corr").alias("value")))
    binned = {c: decile_bins(df, c, bins) for c in numeric}
    for i, a in enumerate(categorical):
        for b in [*categorical[i + 1:], *numeric]:
            cb = binned.get(b, q(b))
            ch = chi_square(contingency(df, a, cb))
            parts.append(ch.select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit("cramers_v").alias("method"),
                                   _bergsma(F.col("n"), F.col("r"), F.col("k"), F.col("chi2")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ----------------------------------------------------------------------------- G18
def chi2_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square independence: statistic, degrees of freedom, n and p-value (NULL without freedom)."""
    ch = chi_square(contingency(df, a, b))
    out = ch.select(F.col("chi2").alias("statistic"), ((F.col("r") - 1) * (F.col("k") - 1)).cast("bigint").alias("dof"), "n")
    return out.withColumn("p_value", chi2_upper(F.col("statistic"), F.col("dof")))


def ks_normal_test(df: DataFrame, col: str) -> DataFrame:
    """Kolmogorov-Smirnov against a normal with the sample mean / std (statistic, p)."""
    from pyspark.ml.stat import KolmogorovSmirnovTest

    st = df.agg(F.avg(q(col)).alias("m"), F.stddev_samp(q(col)).alias("s")).first()
    r = KolmogorovSmirnovTest.test(df.select(q(col).cast("double").alias("x")), "x", "norm",
                                   float(st["m"]), float(st["s"])).first()
    return df.sparkSession.createDataFrame([(float(r["statistic"]), float(r["pValue"]))],
                                           "statistic double, p_value double")


def welch_t(df: DataFrame, num: str, group: str, g1, g2) -> DataFrame:
    """Welch two-sample t statistic, Welch-Satterthwaite degrees of freedom, two-sided p-value."""
    s = df.filter(q(group).isin(g1, g2) & q(num).isNotNull()).agg(
        *[F.avg(F.when(q(group) == g, q(num))).alias(f"m{i}") for i, g in enumerate((g1, g2))],
        *[F.var_samp(F.when(q(group) == g, q(num))).alias(f"v{i}") for i, g in enumerate((g1, g2))],
        *[F.count_if(q(group) == g).alias(f"n{i}") for i, g in enumerate((g1, g2))])
    se0 = F.try_divide(F.col("v0"), F.col("n0"))
    se1 = F.try_divide(F.col("v1"), F.col("n1"))
    t = F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(se0 + se1))
    dof = F.try_divide((se0 + se1) ** 2, F.try_divide(se0 ** 2, F.col("n0") - 1) + F.try_divide(se1 ** 2, F.col("n1") - 1))
    return s.select(t.alias("statistic"), dof.alias("dof")).withColumn("p_value", t_two_sided(F.col("statistic"), F.col("dof")))


def anova_f(df: DataFrame, num: str, group: str) -> DataFrame:
    """One-way ANOVA F statistic with (k-1, N-k) degrees of freedom and its p-value; NULL without
    variation inside the groups or with one group."""
    d1, d2 = F.col("k") - 1, F.col("N") - F.col("k")
    f = F.try_divide(F.try_divide(F.col("ssb"), d1), F.try_divide(F.col("ssw"), d2))
    out = _group_squares(df, group, num).select(f.alias("statistic"), d1.cast("bigint").alias("df_between"), d2.cast("bigint").alias("df_within"))
    return out.withColumn("p_value", f_upper(F.col("statistic"), F.col("df_between"), F.col("df_within")))


def rank_sums(df: DataFrame, num: str, group: str) -> DataFrame:
    """Per group: n and the sum of average ranks (ranks over all groups together)."""
    x = df.filter(q(group).isNotNull() & q(num).isNotNull()).select(q(group).alias("_g"), q(num).cast("double").alias("_x"))
    cells = x.groupBy("_g", F.col("_x").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    j = join_small(cells, rank_table(x, "_x"), ["_v"])
    return j.groupBy("_g").agg(F.sum("_c").alias("n"), F.sum(F.col("_rank") * F.col("_c")).alias("rank_sum"))


def mann_whitney_u(df: DataFrame, num: str, group: str, g1, continuity: bool = True) -> DataFrame:
    """U statistic of group ``g1`` against the rest (average ranks for ties), its n, and the
    two-sided p-value of the normal approximation with the tie correction (and, unless turned off,
    the correction for continuity); no p-value when all values are equal or a group is empty."""
    x = df.withColumn("_grp", F.when(q(group) == F.lit(g1), F.lit("a")).otherwise(F.lit("b")))
    tied = float(_tie_sum(x.filter(q(num).isNotNull()).select(q(num).cast("double").alias("v")), "v"))
    side = lambda c, g: F.max(F.when(F.col("_g") == g, F.col(c)))
    rs = rank_sums(x, num, "_grp").agg(side("n", "a").cast("double").alias("n1"), side("n", "b").cast("double").alias("n2"), side("rank_sum", "a").alias("s"))
    n1, n2 = F.col("n1"), F.coalesce(F.col("n2"), F.lit(0.0))
    n, u = n1 + n2, F.col("s") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (n + 1 - F.coalesce(F.try_divide(F.lit(tied), n * (n - 1)), F.lit(0.0)))
    off = F.abs(u - n1 * n2 / 2) - (0.5 if continuity else 0.0)
    z = F.when(var > 0, F.greatest(off, F.lit(0.0)) / F.sqrt(var))
    return rs.filter(n1.isNotNull()).select(u.alias("statistic"), n1.cast("bigint").alias("n"), normal_two_sided(z).alias("p_value"))


def _tie_sum(values: DataFrame, col: str):
    """sum of t^3 - t over the values that t rows share."""
    t = values.groupBy(col).agg(F.count(F.lit(1)).cast("double").alias("t"))
    return t.agg(F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0.0))).first()[0]


def kruskal_h(df: DataFrame, num: str, group: str) -> DataFrame:
    """Kruskal-Wallis H, corrected for ties, dof and p-value; NULL when all values are equal."""
    x = df.filter(q(group).isNotNull() & q(num).isNotNull())
    tied = float(_tie_sum(x.select(q(num).cast("double").alias("v")), "v"))
    n = F.col("N").cast("double")
    h = F.try_divide(F.lit(12.0) * F.col("_s"), n * (n + 1)) - 3 * (n + 1)
    out = rank_sums(df, num, group).agg(F.sum(F.col("rank_sum") ** 2 / F.col("n")).alias("_s"), F.sum("n").alias("N"),
                                         F.count(F.lit(1)).alias("k")).select(
        F.try_divide(h, 1 - F.try_divide(F.lit(tied), n * n * n - n)).alias("statistic"), (F.col("k") - 1).cast("bigint").alias("dof"))
    return out.withColumn("p_value", chi2_upper(F.col("statistic"), F.col("dof")))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Wilcoxon signed-rank test of paired columns: zero differences are left out, tied ones
    share average ranks. statistic = the smaller rank sum; z = its normal approximation with
    the tie correction; p_value two-sided; n = the differences used."""
    d = df.select((q(a).cast("double") - q(b).cast("double")).alias("d")).where("d is not null and d != 0")
    d = d.select(F.col("d"), F.abs("d").alias("_v"))
    signs = d.groupBy("_v").agg(F.count_if(F.col("d") > 0).alias("_p"), F.count_if(F.col("d") < 0).alias("_m"), F.count(F.lit(1)).alias("_c"))
    ranked = join_small(signs, rank_table(d, "_v"), ["_v"])
    tied = float(_tie_sum(d, "_v"))
    s = ranked.agg(F.coalesce(F.sum(F.col("_rank") * F.col("_p")), F.lit(0.0)).alias("plus"),
                   F.coalesce(F.sum(F.col("_rank") * F.col("_m")), F.lit(0.0)).alias("minus"), F.coalesce(F.sum("_c"), F.lit(0)).alias("n"))
    n = F.col("n").cast("double")
    w = F.least("plus", "minus")
    z = F.try_divide(w - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.lit(tied) / 48))
    return s.select(F.when(F.col("n") > 0, w).alias("statistic"), z.alias("z"), normal_two_sided(z).alias("p_value"), "n")


def pearson_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation test: r, t = r sqrt((n-2)/(1-r^2)), dof, two-sided p-value (0 for a perfect
    correlation); NULL for a constant column."""
    s = df.filter(q(a).isNotNull() & q(b).isNotNull()).agg(_safe_corr(q(a), q(b)).alias("r"), F.count(F.lit(1)).alias("n"))
    out = s.select("r", (F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") ** 2))).alias("statistic"),
                   (F.col("n") - 2).cast("bigint").alias("dof"))
    perfect = (F.abs("r") >= 1) & (F.col("dof") > 0)
    return out.withColumn("p_value", F.when(perfect, F.lit(0.0)).otherwise(t_two_sided(F.col("statistic"), F.col("dof"))))
