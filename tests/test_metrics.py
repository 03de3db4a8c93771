"""Metrics against brute force, with planted-error checks (one changed row must move them)."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import assoc, diagnostics, metrics, profile


def _auc_brute(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y != 1]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_binary_and_auc(spark):
    rng = np.random.default_rng(2)
    ys = rng.integers(0, 2, 400).tolist()
    ss = np.round(rng.random(400), 1).tolist()  # ties
    ps = [1 if s > 0.5 else 0 for s in ss]
    df = spark.createDataFrame(list(zip(ys, ps, ss)), "y int, p int, s double")
    m = metrics.binary_metrics(df, "y", "p").first()
    tp = sum(1 for y, p in zip(ys, ps) if y == 1 and p == 1)
    fp = sum(1 for y, p in zip(ys, ps) if y == 0 and p == 1)
    fn = sum(1 for y, p in zip(ys, ps) if y == 1 and p == 0)
    assert abs(m.precision - tp / (tp + fp)) < 1e-12 and abs(m.recall - tp / (tp + fn)) < 1e-12
    auc = metrics.roc_auc(df, "y", "s").first().auc
    assert abs(auc - _auc_brute(ys, ss)) < 1e-12
    ys2 = list(ys)
    ys2[0] = 1 - ys2[0]
    df2 = spark.createDataFrame(list(zip(ys2, ps, ss)), "y int, p int, s double")
    assert metrics.roc_auc(df2, "y", "s").first().auc != auc
    pts = metrics.roc_curve(df, "y", "s").collect()
    assert max(p.tpr for p in pts) == 1.0 and any(p.threshold == float("inf") for p in pts)


def test_confusion_and_macro(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    cm = {(r.actual, r.predicted): r["count"] for r in metrics.confusion(df, "y", "p").collect()}
    assert len(cm) == 9 and cm[("c", "c")] == 0 and cm[("a", "b")] == 1
    m = metrics.macro_metrics(df, "y", "p").first()
    # per class precision a=1, b=1/3, c=0; recall a=1/2, b=1, c=0
    assert abs(m.precision_macro - (1 + 1 / 3) / 3) < 1e-12 and abs(m.recall_macro - 0.5) < 1e-12


def test_ovo_auc_separable(spark):
    rows = [(c, [1.0 if j == i else 0.0 for j in range(3)]) for i, c in enumerate("xyz") for _ in range(5)]
    df = spark.createDataFrame(rows, "y string, p array<double>")
    assert metrics.roc_auc_ovo(df, "y", "p", ["x", "y", "z"]).first().auc_ovo == 1.0


def test_regression_and_horizons(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 1.0), (2.0, 2.0)], "y double, p double")
    r = metrics.regression_metrics(df, "y", "p").first()
    assert abs(r.mse - 2 / 3) < 1e-12 and abs(r.mae - 2 / 3) < 1e-12 and abs(r.mape - 50.0) < 1e-12
    assert metrics.key_horizons(96) == [("h1", 0), ("h48", 47), ("h96", 95)]
    assert metrics.key_horizons(2) == [("h1", 0), ("h2", 1)]
    arr = spark.createDataFrame([([[1.0], [2.0], [4.0]], [[1.0], [1.0], [1.0]])], "t array<array<double>>, p array<array<double>>")
    h = {r.horizon: r.mae for r in metrics.horizon_metrics(arr, "t", "p", H=3).collect()}
    assert h == {"all": 4 / 3, "h1": 0.0, "h3": 3.0}


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    h = metrics.histogram(df, "x", bins=5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 2, 2, 2, 3]


def test_acf_pacf_match_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.zeros(400)
    for t in range(1, 400):
        x[t] = 0.6 * x[t - 1] + rng.normal()
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t long, v double")
    a = {r.lag: r.acf for r in diagnostics.acf(df, "v", ["t"], block=50).collect()}
    d = x - x.mean()
    for k in (0, 1, 5, 20):
        assert abs(a[k] - (d[k:] * d[:len(d) - k]).sum() / (d * d).sum()) < 1e-9
    p = {r.lag: r.pacf for r in diagnostics.pacf(df, "v", ["t"]).collect()}
    assert abs(p[1] - a[1]) < 1e-12 and abs(p[3]) < 0.2


def test_qq_points(spark):
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(1).normal(size=500)], "x double")
    pts = diagnostics.qq_points(df, "x").orderBy("i").collect()
    assert len(pts) == 500 and pts[0].theoretical < -2 and pts[-1].theoretical > 2
    assert np.corrcoef([p.theoretical for p in pts], [p.sample for p in pts])[0, 1] > 0.98


def test_profile_overview_and_assoc(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 2.0), (2, None, 3.0)], "i int, s string, x double")
    o = profile.overview(df).first()
    assert (o.n_rows, o.n_columns, o.missing_cells, o.duplicate_rows) == (3, 3, 1, 1)
    kinds = {r.column: r.kind for r in profile.classify(df).collect()}
    assert kinds == {"i": "binary", "s": "categorical", "x": "binary"}
    rng = np.random.default_rng(9)
    a = rng.integers(0, 6, 300)
    b = a + rng.integers(0, 3, 300)
    d2 = spark.createDataFrame([(int(u), int(v)) for u, v in zip(a, b)], "a int, b int")
    k = assoc.kendall_tau(d2, "a", "b").first()
    conc = disc = 0
    for i in range(300):
        for j in range(i + 1, 300):
            s = (a[i] - a[j]) * (b[i] - b[j])
            conc += s > 0
            disc += s < 0
    assert (k.concordant, k.discordant) == (conc, disc)
    sp = {(r.a, r.b): r.corr for r in assoc.corr_matrix(d2, ["a", "b"], "spearman").collect()}
    ra = np.argsort(np.argsort(a))  # not tie-aware; only a sanity bound
    assert sp[("a", "b")] > 0.8 and sp[("a", "a")] == 1.0 and ra is not None


def test_standardize_population(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    r = profile.standardize(df).collect()
    assert [x.x for x in r] == [-1.0, 1.0] and [x.c for x in r] == [0.0, 0.0]


def test_degenerate_inputs_give_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, "g", 1), (1.0, 3.0, "g", 2), (1.0, None, "g", 3)], "c double, x double, g string, t int")
    m = {(r.a, r.b): r.corr for r in assoc.corr_matrix(df, ["c", "x"]).collect()}
    assert m == {("c", "x"): None, ("x", "c"): None, ("c", "c"): None, ("x", "x"): 1.0}
    assert {r.acf for r in diagnostics.acf(df.union(df.selectExpr("c", "x", "g", "t + 3")), "c", ["t"]).collect()} == {None}
    one = df.limit(1)
    assert assoc.cramers_v(one, "g", "t").first().cramers_v is None
    assert assoc.kruskal_h(df, "c", "g").first().statistic is None and assoc.anova_f(df, "c", "g").first().statistic is None
    assert assoc.pearson_test(df, "c", "x").first().statistic is None
    assert assoc.kendall_tau(df, "c", "x").first().tau_b is None
    assert assoc.wilcoxon(df, "c", "c").first().statistic is None


def test_rank_tests_against_definitions(spark):
    rng = np.random.default_rng(4)
    a, b, g = rng.integers(0, 9, 200), rng.integers(0, 9, 200), rng.integers(0, 3, 200)
    df = spark.createDataFrame([(int(x), int(y), int(z)) for x, y, z in zip(a, b, g)], "a int, b int, g int")

    def ranks(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    r = ranks(a)
    h = 199 * sum((g == k).sum() * (r[g == k].mean() - r.mean()) ** 2 for k in range(3)) / ((r - r.mean()) ** 2).sum()
    assert abs(assoc.kruskal_h(df, "a", "g").first().statistic - h) < 1e-9
    d = (a - b)[a != b]
    rd = ranks(np.abs(d))
    w = assoc.wilcoxon(df, "a", "b").first()
    assert abs(w.statistic - min(rd[d > 0].sum(), rd[d < 0].sum())) < 1e-9 and 0 < w.p_value <= 1 and w.n == len(d)


def test_spearman_of_a_hot_value_and_many_others(spark, monkeypatch):
    """Half the rows share a value; the others are too many to broadcast. No task gets the hot rows."""
    from kiln.operators import order

    monkeypatch.setattr(order, "LOOKUP_MAX_ROWS", 10)
    rng = np.random.default_rng(8)
    x, y = np.where(np.arange(2000) % 2 == 0, 7.0, np.round(rng.normal(size=2000), 2)), rng.normal(size=2000)
    df = spark.createDataFrame([(float(a), float(b + 0.5 * a)) for a, b in zip(x, y)], "a double, b double")
    ranks = [np.array([(v < w).sum() + ((v == w).sum() + 1) / 2 for w in v]) for v in (x, y + 0.5 * x)]
    got = {(r.a, r.b): r.corr for r in assoc.corr_matrix(df, ["a", "b"], "spearman").collect()}
    assert got[("a", "b")] == pytest.approx(np.corrcoef(*ranks)[0, 1], abs=1e-12)
    plan = assoc.look_up(df, "a", df.groupBy("a").count(), "a", "count", 2000, ["count"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Explode" not in plan and "xxhash64" in plan


def test_spearman_ranks_all_pairs_with_missing_values_at_once(spark, monkeypatch):
    """Each pair is ranked on its own complete rows, by one grouped pass over the values."""
    rng = np.random.default_rng(9)
    cols = {c: [None if rng.random() < p else float(v) for v in rng.integers(0, 30, 400)] for c, p in (("a", 0.3), ("b", 0.2), ("d", 0.0))}
    df = spark.createDataFrame(list(zip(*cols.values(), [1.0] * 400)), "a double, b double, d double, c double")
    passes, ranked = [], assoc._value_ranks
    monkeypatch.setattr(assoc, "_value_ranks", lambda *a: passes.append(a) or ranked(*a))
    got = {(r.a, r.b): r.corr for r in assoc.corr_matrix(df, ["a", "b", "c", "d"], "spearman").collect()}
    for x, y in itertools.combinations("abd", 2):
        both = [(u, v) for u, v in zip(cols[x], cols[y]) if u is not None and v is not None]
        ranks = [[sum(w < v for w in side) + (side.count(v) + 1) / 2 for v in side] for side in zip(*both)]
        assert got[(x, y)] == got[(y, x)] == pytest.approx(np.corrcoef(*ranks)[0, 1], abs=1e-12)
    assert len(passes) == 1 and got[("a", "c")] is None and got[("c", "c")] is None and got[("b", "b")] == 1.0


def test_spearman_groups_the_column_of_most_values_instead_of_looking_it_up(spark, monkeypatch):
    """Rows are not joined with the ranks of a column of too many values to broadcast, nor with those of a
    constant one; ties, a hot value, NaN (the largest) and missing values on either side."""
    from kiln.operators import order

    monkeypatch.setattr(order, "LOOKUP_MAX_ROWS", 40)
    rng = np.random.default_rng(12)
    a = [None if rng.random() < 0.2 else float(v) for v in rng.integers(0, 20, 1500)]
    b = [None if rng.random() < 0.1 else 3.0 if rng.random() < 0.3 else float("nan") if rng.random() < 0.02 else float(np.round(v + (u or 0) / 9, 2))
         for u, v in zip(a, rng.normal(size=1500))]
    d = [float(np.round(v)) for v in rng.normal(size=1500) * 3]
    e = [None if u is not None else float(v) for u, v in zip(a, d)]  # never known where a is
    cols = {"a": a, "b": b, "c": [None if v > 4 else 1.0 for v in d], "d": d, "e": e}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(3)
    looked, look_up = [], assoc.look_up
    monkeypatch.setattr(assoc, "look_up", lambda big, value, *r: looked.append(value) or look_up(big, value, *r))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {(r.a, r.b): r.corr for r in assoc.corr_matrix(df, list(cols), "spearman").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    at = lambda v: np.inf if np.isnan(v) else v
    for x, y in itertools.combinations("abde", 2):
        both = [(at(u), at(v)) for u, v in zip(cols[x], cols[y]) if u is not None and v is not None]
        if (x, y) == ("a", "e"):
            assert not both and got[(x, y)] is None and got[(y, x)] is None
            continue
        ranks = [[sum(w < v for w in side) + (side.count(v) + 1) / 2 for v in side] for side in zip(*both)]
        assert got[(x, y)] == got[(y, x)] == pytest.approx(np.corrcoef(*ranks)[0, 1], abs=1e-12)
    assert sorted(looked) == ["c0", "c3", "c4"]
    assert len(got) == 25 and {v for k, v in got.items() if "c" in k} == {None} and {got[(k, k)] for k in "abde"} == {1.0}


def test_box_stats_of_few_groups_are_not_dealt_by_group(spark):
    df = spark.range(1000).selectExpr("id % 2 as g", "cast(id as double) as x")
    boxes = profile.box_stats(df, "x", by="g")
    assert "SortMergeJoin" not in boxes._jdf.queryExecution().executedPlan().toString()
    assert {r.g: (r.n, r.median) for r in boxes.collect()} == {0: (500, 499.0), 1: (500, 500.0)}
