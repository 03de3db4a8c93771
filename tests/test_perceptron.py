import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import model
from kiln.operators import perceptron as p


@pytest.mark.parametrize("activation", p.ACTIVATIONS)
@pytest.mark.parametrize("outputs", [1, 3])
def test_gradient_by_finite_differences(activation, outputs):
    rng, sizes = np.random.default_rng(3), [4, 5, 3, outputs]
    x, y = rng.normal(size=(9, 4)), rng.integers(0, max(outputs, 2), 9)
    flat = p.start_weights(sizes, activation, 1)
    _, g = p.loss_and_gradient(x, y, flat, sizes, activation)
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        up, down = (p.loss_and_gradient(x, y, flat + s, sizes, activation)[0] for s in (step, -step))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=2e-5)


def _frame(spark, k):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + x[:, 1] > 0).astype(int) + (0 if k == 2 else (x[:, 0] - x[:, 1] > 0).astype(int))
    return spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "x1 double, x2 double, y int"), x, y


def test_steps_against_one_machine(spark):
    """The same batches, summed in one array."""
    df, x, y = _frame(spark, 3)
    df = df.coalesce(1)
    for solver in p.SOLVERS:
        made = p.fit_perceptron(df, ["x1", "x2"], "y", (4,), "tanh", solver, max_iter=3, step_size=0.05, batches=2)
        flat = p.start_weights(made.sizes, "tanh", 42)
        m, v, t = np.zeros(len(flat)), np.zeros(len(flat)), 0
        for _ in range(3):
            for part in range(2):
                rows = np.arange(len(y)) % 2 == part
                n = rows.sum()
                w = np.where(p.is_weight(made.sizes), flat, 0)
                g = p.loss_and_gradient(x[rows], y[rows], flat, made.sizes, "tanh")[1] / n + 1e-4 * w / n
                t += 1
                if solver == "adam":
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    flat = flat - 0.05 * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t) * m / (np.sqrt(v) + 1e-8)
                else:
                    m = 0.9 * m - 0.05 * g
                    flat = flat + 0.9 * m - 0.05 * g
        assert made.weights == pytest.approx(flat, abs=1e-9)


def test_relu_and_adam_learn(spark, tmp_path):
    df, _, _ = _frame(spark, 2)
    made = model.fit_mlp(df, ["x1", "x2"], "y", hidden="8,4", activation="relu", solver="adam", max_iter=15, step_size=0.05, batches=2)
    assert made.losses[-1] < made.losses[0] / 2
    assert model.score(made, df).filter(F.col("prediction") == F.col("y")).count() > 280
    model.save_model(made, str(tmp_path / "m"))
    again = model.load_model(str(tmp_path / "m"))
    assert sorted(map(str, model.score(again, df).collect())) == sorted(map(str, model.score(made, df).collect()))


def test_missing_values_no_rows_and_refusals(spark):
    df = spark.createDataFrame([(1.0, 0.5, 1), (None, 0.5, 0), (float("nan"), 0.5, 0), (-1.0, 0.1, 0), (0.3, 0.3, None)], "x1 double, x2 double, y int")
    made = p.fit_perceptron(df, ["x1", "x2"], "y", (3,), max_iter=2, batches=1)
    assert [r.probability is None for r in model.score(made, df).orderBy(F.col("x1")).collect()].count(True) == 2
    assert p.fit_perceptron(df.filter("x1 > 9"), ["x1"], "y", (3,), max_iter=2).losses == []
    still = p.fit_perceptron(df, ["x1", "x2"], "y", (3,), max_iter=50, tol=9.0, patience=3, batches=1)
    assert len(still.losses) == 4
    for wrong in (dict(activation="gelu"), dict(solver="rms")):
        with pytest.raises(ValueError):
            p.fit_perceptron(df, ["x1"], "y", **wrong)
    with pytest.raises(ValueError):
        model.fit_mlp(df, ["x1"], "y", activation="relu", solver="l-bfgs")
