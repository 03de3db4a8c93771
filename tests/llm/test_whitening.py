"""Whitening against exact fractions and plain numpy."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.llm import whitening
from kiln.llm.queries import QUERIES
from kiln.llm.whitening import _centred, _limbs, _square_sums, finite, fit_whitening, moments, quantised

SCHEMA = "vec_id long, x array<bigint>"


def exact(rows):
    """n, S and sum (n x_i - S_i)(n x_j - S_j), by fractions."""
    n, d = len(rows), len(rows[0])
    s = [sum(r[i] for r in rows) for i in range(d)]
    y = [[n * r[i] - s[i] for i in range(d)] for r in rows]
    return s, [[sum(a[i] * a[j] for a in y) for j in range(d)] for i in range(d)], y


def frame(spark, rows, parts=4):
    return spark.createDataFrame(list(enumerate(rows)), SCHEMA).repartition(parts)


@pytest.mark.parametrize("size", [10, 1 << 20, 1 << 40, 1 << 57, 1 << 62])
def test_moments_are_exact(spark, size):
    rng = random.Random(size)
    rows = [[rng.randint(-size, size) + size // 2 for _ in range(5)] for _ in range(60)]
    s, cross, _ = exact(rows)
    for parts in (1, 7):
        m = moments(frame(spark, rows, parts), "x")
        assert (m.n, m.sums, m.cross) == (60, s, cross)
        assert m.covariance().tolist() == [[float(Fraction(c, 60 ** 3)) for c in row] for row in cross]


def test_fast_and_slow_squares_agree():
    rng = random.Random(2)
    z = [[rng.randint(-(1 << 61) + 1, (1 << 61) - 1) for _ in range(3)] for _ in range(500)] + [[(1 << 61) - 1] * 3, [-(1 << 61) + 1] * 3, [0] * 3]
    want = [sum(r[i] ** 2 for r in z) for i in range(3)]
    assert _square_sums(np.array(z, dtype=np.int64)) == _square_sums(np.array(z, dtype=object)) == want
    assert all(sum(v << 32 * k for k, v in enumerate(_limbs(w))) == w for w in want + [-1, -want[0], 0])
    x = np.array([[5, -7], [1, 2]])
    assert _centred(x, 2, [6, -5], 7).tolist() == _centred(x, 2, [6, -5], 1 << 62).tolist() == [[4, -9], [-4, 9]]


def test_whitened_values(spark):
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6)) * 64).astype(int) + 1_000_000
    rows = [*x.tolist(), *x[:50].tolist()]  # repeated rows count
    df = frame(spark, rows).withColumn("whitened", F.lit("clash")).withColumn("deviation", F.lit("clash")).withColumn("other", F.lit("kept"))
    model = fit_whitening(df, "x", k=4)
    c = np.array(rows, dtype=float) - np.mean(rows, axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(rows))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert np.allclose(model.explained, values[:4] / values.sum(), rtol=1e-10)
    out = model.transform(df, "x")
    assert out.columns == ["vec_id", "x", "other", "whitened", "deviation"]
    got = out.orderBy("vec_id").collect()
    z = np.array([r.whitened for r in got])
    assert np.abs(np.abs(z) - np.abs(c @ vectors[:, :4] / np.sqrt(values[:4]))).max() < 1e-8
    assert [r.deviation for r in got] == [sum(v * v for v in y) for y in exact(rows)[2]]
    assert model.identity_error(df, "x") < 1e-9
    assert np.abs(z.T @ z / len(z) - np.eye(4)).max() < 1e-9


def test_directions_without_variance(spark):
    rows = [[i % 7, 5, 2 * (i % 7)] for i in range(70)]  # one direction only
    model = fit_whitening(frame(spark, rows), "x")
    got = model.transform(frame(spark, rows), "x").collect()
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in got)
    assert model.identity_error(frame(spark, rows), "x") < 1e-12
    assert abs(model.explained[0] - 1) < 1e-12
    still = [[3, 4]] * 5
    model = fit_whitening(frame(spark, still), "x")
    assert [(r.whitened, r.deviation) for r in model.transform(frame(spark, still), "x").collect()] == [([None, None], 0)] * 5
    assert model.explained == [None, None] and model.identity_error(frame(spark, still), "x") is None


def test_several_lengths_are_an_error(spark):
    with pytest.raises(ValueError, match="several lengths"):
        moments(frame(spark, [[1, 2], [1]]), "x")


def test_quantised_and_finite(spark):
    inf, nan = float("inf"), float("nan")
    data = [([0.5, -0.01],), (None,), ([None, 1.0],), ([inf, 1.0],), ([-inf],), ([nan],), ([],)]
    got = spark.createDataFrame(data, "e array<float>").select(finite(F.col("e")).alias("ok"), "e").where("ok").select(quantised(F.col("e"), 64, 1000).alias("x"))
    assert [r.x for r in got.collect()] == [[1032, 999], []]


def _query(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n string, component string, x string")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return QUERIES["op12_embedding_whitening"](spark, str(tmp_path)).collect()


def test_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    e = rng.normal(size=(200, 40)).astype(np.float32)
    rows = [(int(i) if i else None, v.tolist(), None, "a", "b", "c") for i, v in enumerate(e)] + [(7, e[7].tolist(), 1, "a", "b", "c")]
    bad = [(900, None), (901, []), (902, [None] * 40), (903, [float("nan")] * 40), (904, [float("inf")] * 40)]
    got = _query(spark, tmp_path / "full", rows + [(i, v, 1, "", "", "") for i, v in bad])
    assert len(got) == 201 * 32 and {r.n for r in got} == {201} and len({r.identity_error for r in got}) == 1
    assert sorted({r.component for r in got}) == list(range(1, 33)) and not {r.vec_id for r in got} & {i for i, _ in bad}
    x = np.floor(np.array([r[1] for r in rows], dtype=float) * 64) + 1e6
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(c))
    of = {(r.vec_id, r.component): r for r in got}
    for i in (1, 50, 199):
        want = c[i] @ vectors[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
        assert all(abs(abs(of[i, k + 1].whitened) - abs(want[k])) < 1e-8 for k in range(32))
    assert _query(spark, tmp_path / "empty", []) == []


def test_driver_holds_sums_only(spark, monkeypatch):
    """As many totals reach the driver as there are pairs, however many rows and tasks."""
    seen = []
    added = whitening._added
    monkeypatch.setattr(whitening, "_added", lambda parts: seen.append(parts.groupBy("place").count().count()) or added(parts))
    moments(frame(spark, [[i, i * i % 11, -i] for i in range(300)], 9), "x")
    assert seen == [3, 6]
