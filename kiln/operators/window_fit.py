"""A direct linear forecaster on window blocks: y on a constant and all steps and channels of x.

Training reads the blocks of ``windows.sequence_blocks`` where they lie: a task lays the windows of a
block over its rows without copying them out, reduces a slab of windows at a time to a triangular
factor (``operators.factors``), and only factors are shuffled. Windows with an unknown step or target
take no part. Meant for up to some hundred terms (a factor holds their square).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.exprs import q
from kiln.operators.factors import Factor, Model, least_squares, solve_factors
from kiln.operators.order import join_small, keys_of

#: Numbers of a slab of windows that is reduced at once, and of factors a task holds.
SLAB_NUMBERS = 1 << 20
HELD_NUMBERS = 1 << 22


def _block_factor(steps: np.ndarray, y: np.ndarray, length: int) -> Factor:
    """The factor of (1, x, y) over the windows of one block; ``steps`` is rows by channels."""
    laid = np.lib.stride_tricks.sliding_window_view(steps, length, axis=0)  # window, channel, step
    width = length * steps.shape[1]
    total = Factor.of(np.ones((0, width + 2)))
    slab = max(1, SLAB_NUMBERS // (width + 2))
    for at in range(0, len(y), slab):
        x = laid[at: at + slab].transpose(0, 2, 1).reshape(-1, width)
        rows = np.column_stack([np.ones(len(x)), x, y[at: at + slab]])
        total = total.merged(Factor.of(rows[np.isfinite(rows).all(axis=1)]))
    return total


def window_factors(blocks: DataFrame, key=None) -> DataFrame:
    """(key, n, shift, r) of (1, x, y) over the windows of ``blocks``: one row per key and task, or
    more where factors are large."""
    keys = keys_of(key)
    x = blocks.select(*[q(k) for k in keys], "seq_len", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Factor] = {}
        kinds: list[pa.DataType] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], kind) for i, kind in enumerate(kinds)]
            columns += [pa.array([f.n for f in held.values()], pa.int64()), pa.array([f.shift.tolist() for f in held.values()], pa.list_(pa.float64())),
                        pa.array([f.r.ravel().tolist() for f in held.values()], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "n", "shift", "r"])

        for batch in batches:
            at = len(keys)
            kinds = [batch.schema.field(i).type for i in range(at)]
            for i in range(batch.num_rows):
                name = tuple(batch.column(k)[i].as_py() for k in range(at))
                rows, y = batch.column(at + 1)[i].values, batch.column(at + 2)[i].values
                steps = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
                own = _block_factor(steps, y.to_numpy(zero_copy_only=False).astype(float), batch.column(at)[i].as_py())
                held[name] = held[name].merged(own) if name in held else own
                if sum(f.r.size for f in held.values()) > HELD_NUMBERS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    kept = [f for f in x.schema.fields if f.name in keys]
    return x.mapInArrow(run, T.StructType([*kept, *T.StructType.fromDDL("n bigint, shift array<double>, r array<double>").fields]))


def fit_windows(blocks: DataFrame, key=None) -> DataFrame:
    """Per key: ``n`` windows, ``coef`` (the constant, then step by step every channel) and ``rss``."""
    def solve(_key: tuple, factor: Factor) -> list[dict]:
        m = len(factor.shift)
        if not factor.n:
            return [{"n": 0, "coef": None, "rss": None}]
        fit = least_squares(factor, Model([f"c{i}" for i in range(m - 1)], [{i: 1.0} for i in range(m - 1)], {m - 1: 1.0}))
        return [{"n": factor.n, "coef": fit.coef, "rss": fit.rss}]

    return solve_factors(window_factors(blocks, key), keys_of(key), "n bigint, coef array<double>, rss double", solve)


def window_forecasts(windows: DataFrame, fits: DataFrame, key=None) -> DataFrame:
    """``windows`` with ``forecast`` = the fitted line at x; NULL where a step is unknown."""
    keys = keys_of(key)
    named = fits.select(*[q(k) for k in keys], F.col("coef").alias("_coef"))
    terms = F.zip_with(F.flatten("x"), F.slice("_coef", F.lit(2), F.size("_coef") - 1), lambda a, b: a * b)
    line = F.get("_coef", F.lit(0)) + F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return join_small(windows, named, keys, "left").withColumn("forecast", line).drop("_coef")
