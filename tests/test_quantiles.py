import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.functions.quantiles import exact_quantile_row, exact_quantiles, quantiles_long


@pytest.mark.parametrize("method", ["exact", "sort", "builtin"])
def test_global_matches_numpy(spark, method):
    rng = np.random.default_rng(3)
    vals = np.round(rng.exponential(10, 3001), 2)  # many ties
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    row = exact_quantiles(df, "x", [0.0, 0.1, 0.25, 0.5, 0.75, 1.0], method=method).first()
    want = np.quantile(vals, [0.0, 0.1, 0.25, 0.5, 0.75, 1.0])
    got = [row[f"q{i}"] for i in range(6)]
    assert np.allclose(got, want, rtol=0, atol=1e-9)
    assert row["n"] == len(vals)


def test_grouped_small_and_large_groups(spark):
    rng = np.random.default_rng(5)
    rows = [("big", float(v)) for v in rng.normal(0, 1, 5000)] + [("tiny", 1.0), ("tiny", 4.0)] + [("one", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    res = {r["g"]: r for r in exact_quantiles(df, "x", [0.25, 0.5, 0.75], by="g").collect()}
    for g in ("big", "tiny", "one"):
        vals = np.array([v for k, v in rows if k == g])
        want = np.quantile(vals, [0.25, 0.5, 0.75])
        assert np.allclose([res[g]["q0"], res[g]["q1"], res[g]["q2"]], want, atol=1e-9)


def test_nulls_nan_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    row = exact_quantile_row(df, "x", [0.5])
    assert row["n"] == 2 and row["q0"] == 2.0
    empty = df.filter(F.col("x") > 100)
    assert exact_quantile_row(empty, "x", [0.5])["q0"] is None


def test_long_form(spark):
    vals = list(range(11))
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    out = {r["i"]: r["value"] for r in quantiles_long(df, "x", [0.05, 0.5, 0.95]).collect()}
    assert np.allclose([out[0], out[1], out[2]], np.quantile(vals, [0.05, 0.5, 0.95]))


def test_ties_are_counted_not_collected(spark):
    """A constant and a zero-inflated column: one row per value, and no list of rows in the plan."""
    df = spark.range(20_000).selectExpr("7.0D as c", "if(id % 10 < 9, 0.0D, id * 1.0D) as z", "id % 3 as g")
    for col in ("c", "z"):
        vals = np.array([r[0] for r in df.select(col).collect()])
        got = exact_quantiles(df, col, [0.05, 0.5, 0.9, 0.95])
        assert np.allclose([got.first()[f"q{i}"] for i in range(4)], np.quantile(vals, [0.05, 0.5, 0.9, 0.95]), atol=1e-9)
        assert "collect_list" not in got._jdf.queryExecution().toString()
    by = {r.g: r for r in exact_quantiles(df, "z", [0.95], by="g").collect()}
    for g in range(3):
        vals = np.array([r[0] for r in df.where(f"g = {g}").select("z").collect()])
        assert abs(by[g].q0 - np.quantile(vals, 0.95)) < 1e-9
