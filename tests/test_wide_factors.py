import numpy as np
import pytest

from kiln.operators import profile
from kiln.operators.wide_factors import famd_wide


def _mixed(spark, n=500, values=6):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        a = int(rng.integers(0, values))
        rows.append((i, float(a + rng.normal()), float(rng.normal()), f"v{a}", None if i % 50 == 0 else f"w{(a + int(rng.integers(0, 2))) % 3}"))
    return spark.createDataFrame(rows, "id long, x double, y double, a string, b string")


def test_agrees_with_the_exact_way(spark):
    df = _mixed(spark).repartition(4)
    exact, m = profile.famd(df, ["x", "y"], ["a", "b"], k=3, keep=["id"])
    wide, axes = famd_wide(df, ["x", "y"], ["a", "b"], k=3, keep=["id"])
    assert axes.explainedVariance == pytest.approx(m.explainedVariance.toArray(), abs=1e-9)
    one, two = ({r.id: np.abs(r.coords) for r in d.collect()} for d in (exact, wide))
    assert set(one) == set(two) and len(one) == 500
    assert max(np.abs(one[i] - two[i]).max() for i in one) < 1e-6
    assert [r.component for r in profile.explained(axes).collect()] == [1, 2, 3]


def test_rounds_reach_the_leading_axes(spark):
    """Fewer directions than columns, so that rounds are needed."""
    df = _mixed(spark, 600, 40)
    _, m = profile.famd(df, ["x", "y"], ["a", "b"], k=2, keep=["id"])
    _, axes = famd_wide(df, ["x", "y"], ["a", "b"], k=2, tol=1e-13, max_rounds=200)
    assert axes.pc.shape == (45, 2) and axes.rounds > 1
    assert axes.explainedVariance == pytest.approx(m.explainedVariance.toArray(), abs=1e-6)
    assert axes.pc.T @ axes.pc == pytest.approx(np.eye(2), abs=1e-9)


def test_many_categories_missing_values_and_no_rows(spark):
    df = spark.range(30_000).selectExpr("id", "if(id = 7, null, cast(id % 101 as double)) as x", "concat('c', id % 20000) as a", "cast(id % 2 as string) as b")
    coords, axes = famd_wide(df, ["x"], ["a", "b"], k=2, keep=["id"], max_rounds=3)
    assert len(axes.names) == 20_003 and coords.count() == 29_999
    empty, axes = famd_wide(df.limit(0), ["x"], ["a"], k=1, keep=["id"])
    assert empty.collect() == [] and axes.explainedVariance.tolist() == [0.0]


def test_axes_in_tables_agree(spark):
    """With more columns than the driver may hold, the block of directions is a table."""
    df = _mixed(spark, 600, 12).repartition(4)
    kept, same = famd_wide(df, ["x", "y"], ["a", "b"], k=2, keep=["id"], tol=1e-7)
    stored, axes = famd_wide(df, ["x", "y"], ["a", "b"], k=2, keep=["id"], tol=1e-7, held=0)
    assert axes.explainedVariance == pytest.approx(same.explainedVariance, abs=1e-5)
    assert axes.pc.T @ axes.pc == pytest.approx(np.eye(2), abs=1e-8)
    assert axes.names == same.names and axes.pc == pytest.approx(same.pc, abs=1e-2)
    one, two = ({r.id: np.array(r.coords) for r in d.collect()} for d in (kept, stored))
    assert set(one) == set(two) and len(one) == 600
    assert max(np.abs(one[i] - two[i]).max() for i in one) < 0.05


def test_look_up_of_hot_values(spark, monkeypatch):
    from kiln.operators import order

    monkeypatch.setattr(order, "HOT_SHARE", 0.1)
    big = spark.range(1000).selectExpr("id", "if(id % 10 = 3, null, if(id % 2 = 0, 0.0D, cast(id as double))) as v")
    known = big.filter("v is not null").groupBy(big.v.alias("key")).count().selectExpr("key", "count as n", "key * 2 as twice")
    got = {r.id: r.twice for r in order.look_up(big, "v", known, "key", "n", 1000, ["twice"], whole=10).collect()}
    assert got == {i: None if i % 10 == 3 else 0.0 if i % 2 == 0 else 2.0 * i for i in range(1000)}
