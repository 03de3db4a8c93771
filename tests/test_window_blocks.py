"""Block-encoded windows: equal windows, stored size, and a fit that reads the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import window_fit, windows

N = {"a": 130, "b": 64, "c": 3}


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = [(k, t, None if (k, t) == ("a", 40) else float(rng.normal()), float(rng.normal() + t)) for k, n in N.items() for t in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t long, u double, v double").repartition(5)


def plain(rows, L, h):
    out = {}
    for k in N:
        mine = sorted(r for r in rows if r[0] == k)
        for i in range(len(mine) - L - h + 1):
            out[k, i] = ([list(r[2:]) for r in mine[i:i + L]], mine[i + L + h - 1][3])
    return out


@pytest.mark.parametrize("block", [None, 9, 32, 64])
def test_sequences_are_the_plain_windows(series, block):
    rows, df = series
    got = windows.sequences(df, ["u", "v"], "v", L=5, h=3, order_cols=["t"], key="k", block=block, adapt_length=False)
    assert {(r.k, r.start): (r.x, r.y) for r in got.collect()} == plain(rows, 5, 3)
    third = windows.sequences(df, ["u", "v"], "v", L=5, h=3, order_cols=["t"], key="k", block=block, adapt_length=False, stride=3)
    assert sorted((r.k, r.start) for r in third.collect()) == sorted(k for k in plain(rows, 5, 3) if k[1] % 3 == 0)


def test_context_windows_by_block(series):
    rows, df = series
    with pytest.warns(UserWarning):
        got = windows.context_windows(df, ["u", "v"], L=4, H=2, order_cols=["t"], key="k", block=16).collect()
    want = plain(rows, 6, 1) | {}
    assert len(got) == sum(max(0, n - 5) for n in N.values())
    for r in got:
        mine = sorted(x for x in rows if x[0] == r.k)
        assert r.past == [list(x[2:]) for x in mine[r.start: r.start + 4]]
        assert r.future == [list(x[2:]) for x in mine[r.start + 4: r.start + 6]]
        assert r.past_observed == [[v is not None for v in s] for s in r.past]
    assert set(want) <= {(r.k, r.start) for r in got}


def test_stored_size_is_rows_and_halo(series):
    _, df = series
    L, h, b = 20, 1, 32
    blocks = windows.sequence_blocks(df, ["v"], "v", L, h, ["t"], "k", b, adapt_length=False)
    size = blocks.agg(F.sum(F.size("x")).alias("x"), F.sum(F.size("y")).alias("y"), F.sum("n_windows").alias("w"), F.count("*").alias("b")).first()
    assert size.w == size.y == sum(max(0, n - L) for n in N.values())
    assert size.x == size.w + size.b * (L - 1)  # where a row per window would hold w * L
    with pytest.raises(ValueError):
        windows.sequence_blocks(df, ["v"], "v", L, h, ["t"], "k", L)


def test_no_window_and_no_rows(series):
    _, df = series
    assert windows.sequences(df.filter("k = 'c'"), ["v"], "v", L=4, order_cols=["t"], key="k", adapt_length=False).collect() == []
    assert windows.sequences(df.filter("t < 0"), ["v"], "v", L=4, order_cols=["t"], adapt_length=False).collect() == []


def test_fit_reads_blocks(series, monkeypatch):
    rows, df = series
    monkeypatch.setattr(window_fit, "SLAB_NUMBERS", 100)  # slabs of some windows
    level = df.withColumn("v", F.col("v") + 1e6)
    blocks = windows.sequence_blocks(level, ["u", "v"], "v", 3, 2, ["t"], "k", 16, adapt_length=False)
    fits = window_fit.fit_windows(blocks, "k")
    got = {r.k: r for r in fits.collect()}
    want = plain([(k, t, u, v) for k, t, u, v in rows], 3, 2)
    for k in ("a", "b"):
        pairs = [(np.array(x, dtype=float).ravel(), y) for (s, _), (x, y) in want.items() if s == k]
        pairs = [(x, y) for x, y in pairs if np.isfinite(x).all()]
        a = np.column_stack([np.ones(len(pairs)), [x for x, _ in pairs]])
        coef, rss, *_ = np.linalg.lstsq(a, np.array([y for _, y in pairs]), rcond=None)
        assert got[k].n == len(pairs)
        assert np.allclose(got[k].coef[1:], coef[1:], atol=1e-7) and np.isclose(got[k].rss, rss[0], rtol=1e-6)
    scored = window_fit.window_forecasts(windows.cut_sequences(blocks, "k"), fits, "k")
    errors = {r.k: r.e for r in scored.groupBy("k").agg(F.sum((F.col("y") - F.col("forecast")) ** 2).alias("e")).collect()}
    assert all(np.isclose(errors[k], got[k].rss, rtol=1e-6) for k in ("a", "b"))
