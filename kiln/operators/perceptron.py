"""Multilayer perceptrons trained by minibatch steps (M2): relu, tanh, logistic or identity hidden
units, Adam or stochastic gradient descent.

Rows are dealt to ``batches`` parts of equal size once and stored by part. A step is one job over one
part: tasks sum the gradient of their rows, Spark adds the sums by weight, and the driver, which holds
the weights only, takes the step. More batches are more steps a pass over the rows, not more work.

The loss is the mean log loss of a batch plus ``alpha`` / 2 times the squared weights over its rows;
training ends after ``max_iter`` passes, or when the loss of ten passes in a row was not ``tol`` below
the best. Weights start uniform within sqrt(6 / (in + out)), 2 in place of 6 for logistic units.
Two classes have one output unit, more have one each (softmax).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import q
from kiln.operators.boosting import drop_scratch, probabilities
from kiln.sources.files import scratch_path

# The usual constants of Adam and of momentum.
BETA1, BETA2, EPSILON, MOMENTUM = 0.9, 0.999, 1e-8, 0.9
ACTIVATIONS = ("relu", "tanh", "logistic", "identity")
SOLVERS = ("adam", "sgd")


def _act(z: np.ndarray, kind: str) -> np.ndarray:
    if kind == "relu":
        return np.maximum(z, 0.0)
    if kind == "tanh":
        return np.tanh(z)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) if kind == "logistic" else z


def _slope(a: np.ndarray, kind: str) -> np.ndarray:
    """Derivative of a unit from its output."""
    if kind == "relu":
        return (a > 0).astype(float)
    if kind == "tanh":
        return 1.0 - a * a
    return a * (1.0 - a) if kind == "logistic" else np.ones_like(a)


def layers_of(flat: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, bias) of every layer from one long array."""
    out, at = [], 0
    for n, m in zip(sizes[:-1], sizes[1:]):
        out.append((flat[at: at + n * m].reshape(n, m), flat[at + n * m: at + n * m + m]))
        at += n * m + m
    return out


def start_weights(sizes: Sequence[int], activation: str, seed: int) -> np.ndarray:
    rng, parts = np.random.default_rng(seed), []
    for n, m in zip(sizes[:-1], sizes[1:]):
        bound = np.sqrt((2.0 if activation == "logistic" else 6.0) / (n + m))
        parts += [rng.uniform(-bound, bound, n * m), rng.uniform(-bound, bound, m)]
    return np.concatenate(parts)


def forward(x: np.ndarray, flat: np.ndarray, sizes: Sequence[int], activation: str) -> list[np.ndarray]:
    """Outputs of every layer; the last holds the scores."""
    out, layers = [x], layers_of(flat, sizes)
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(z if i == len(layers) - 1 else _act(z, activation))
    return out


def loss_and_gradient(x: np.ndarray, y: np.ndarray, flat: np.ndarray, sizes: Sequence[int], activation: str) -> tuple[float, np.ndarray]:
    """Sums over the rows, without the penalty."""
    outs = forward(x, flat, sizes, activation)
    p = probabilities(outs[-1])
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    delta = (p[:, 1:] - y[:, None]) if sizes[-1] == 1 else p - (np.arange(sizes[-1])[None, :] == y[:, None])
    layers, parts = layers_of(flat, sizes), []
    for i in range(len(layers) - 1, -1, -1):
        parts.append(np.concatenate([(outs[i].T @ delta).ravel(), delta.sum(axis=0)]))
        if i:
            delta = (delta @ layers[i][0].T) * _slope(outs[i], activation)
    return float(loss), np.concatenate(parts[::-1])


def is_weight(sizes: Sequence[int]) -> np.ndarray:
    """Marks the weights among the parameters; biases carry no penalty."""
    return np.concatenate([np.repeat([True, False], [n * m, m]) for n, m in zip(sizes[:-1], sizes[1:])])


@dataclass
class Perceptron:
    """A fitted network. ``transform`` adds ``probability`` (array) and ``prediction``; a row with a
    missing feature gets NULL for both."""
    features: list[str]
    sizes: list[int]
    activation: str
    weights: np.ndarray
    losses: list[float] = field(default_factory=list)  # mean loss of every pass

    def transform(self, df: DataFrame) -> DataFrame:
        sizes, activation, flat = self.sizes, self.activation, self.weights

        @F.pandas_udf("array<double>")
        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for x in batches:
                rows = x.to_numpy(np.float64, na_value=np.nan)
                ok = ~np.isnan(rows).any(axis=1)
                p = probabilities(forward(np.where(ok[:, None], rows, 0.0), flat, sizes, activation)[-1])
                yield pd.Series([r if known else None for r, known in zip(p, ok)], index=x.index, dtype=object)

        out = df.withColumn("probability", scored(F.struct(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(self.features)])))
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "sizes": self.sizes, "activation": self.activation,
                           "weights": self.weights.tolist(), "losses": self.losses})

    @staticmethod
    def from_json(text: str) -> Perceptron:
        d = json.loads(text)
        return Perceptron(d["features"], d["sizes"], d["activation"], np.array(d["weights"]), d["losses"])


def gradient_sums(rows: DataFrame, n_features: int, flat: np.ndarray, sizes: Sequence[int], activation: str) -> DataFrame:
    """(i, v): the sum over the rows of the gradient by parameter i; -1 is the loss, -2 the number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros(len(flat)), 0.0, 0
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n_features)
                more, g = loss_and_gradient(x, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), flat, sizes, activation)
                total, loss, n = total + g, loss + more, n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(flat), dtype=np.int32)), pa.array(np.concatenate([[n, loss], total]))], names=["i", "v"])

    return rows.select("label", "x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))


def fit_perceptron(df: DataFrame, features: Sequence[str], label: str, hidden: Sequence[int] = (100,), activation: str = "relu",
                   solver: str = "adam", max_iter: int = 200, step_size: float = 0.001, alpha: float = 1e-4, batches: int = 8,
                   tol: float = 1e-4, patience: int = 10, seed: int = 42) -> Perceptron:
    """A network for labels 0..k-1; rows without a label or with a missing feature take no part."""
    if activation not in ACTIVATIONS:
        raise ValueError(f"activation {activation!r} is not one of {', '.join(ACTIVATIONS)}")
    if solver not in SOLVERS:
        raise ValueError(f"solver {solver!r} is not one of {', '.join(SOLVERS)}")
    spark, features = df.sparkSession, list(features)
    x = F.array(*[q(c).cast("double") for c in features])
    usable = q(label).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v))
    path = scratch_path(spark, "perceptron")
    # the number of a row within its task deals every task's rows evenly, whatever their values
    (df.filter(usable).select(q(label).cast("int").alias("label"), x.alias("x"), F.pmod(F.monotonically_increasing_id(), F.lit(batches)).cast("int").alias("part"))
       .write.partitionBy("part").parquet(path))
    rows = spark.read.schema("label int, x array<double>, part int").parquet(path)
    seen = rows.groupBy("part").agg(F.max("label").alias("top"), F.min("label").alias("low")).collect()
    if any(r["low"] < 0 for r in seen):
        raise ValueError("labels are numbers from 0")
    k = max((r["top"] for r in seen), default=1) + 1
    sizes = [len(features), *hidden, 1 if k <= 2 else k]
    flat, decayed = start_weights(sizes, activation, seed), is_weight(sizes)
    first, second, steps = np.zeros(len(flat)), np.zeros(len(flat)), 0
    made = Perceptron(features, sizes, activation, flat)
    lowest, idle = float("inf"), 0
    for _ in range(max_iter if seen else 0):
        passed, n_seen = 0.0, 0.0
        for part in sorted(r["part"] for r in seen):
            sums = gradient_sums(rows.filter(F.col("part") == part), len(features), flat, sizes, activation).toPandas().sort_values("i")["v"].to_numpy()
            n, g = sums[0], sums[2:] / sums[0]
            w = np.where(decayed, flat, 0.0)
            passed, n_seen = passed + sums[1] + 0.5 * alpha * float(w @ w), n_seen + n
            g = g + alpha * w / n
            steps += 1
            if solver == "adam":
                first, second = BETA1 * first + (1 - BETA1) * g, BETA2 * second + (1 - BETA2) * g * g
                rate = step_size * np.sqrt(1 - BETA2 ** steps) / (1 - BETA1 ** steps)
                flat = flat - rate * first / (np.sqrt(second) + EPSILON)
            else:  # with Nesterov's momentum
                first = MOMENTUM * first - step_size * g
                flat = flat + MOMENTUM * first - step_size * g
        made.losses.append(passed / n_seen)
        idle = idle + 1 if made.losses[-1] > lowest - tol else 0
        lowest = min(lowest, made.losses[-1])
        if idle >= patience:
            break
    drop_scratch(spark, path)
    made.weights = flat
    return made
