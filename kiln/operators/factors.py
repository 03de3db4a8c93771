"""Least squares from mergeable triangular factors.

The normal equations of a series at level 1e6 with unit noise lose the noise to rounding. Here
every task reduces its rows of (1, c_1, .., c_m) to a triangular factor R with R'R = X'X by
Householder reflections, which never squares the values; factors of a key merge by reducing them
together, and the fit is solved on the last one. Each partial factor holds its columns less their
first row's values (``shift``), so a level is gone before anything is rounded; when two factors
merge, one moves to the other's shift by adding a multiple of its constant column, which is exact
algebra. A factor of some columns serves every model whose terms are linear in them (``Model``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys whose factors a task holds before it hands them over.
KEYS_HELD = 4096
#: A column whose part outside the earlier ones is smaller than this share of it counts as dependent.
DEPENDENT = 1e-13


@dataclass
class Factor:
    n: int
    shift: np.ndarray  # what was taken off each column; 0 for the constant
    r: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Factor:
        """The factor of some rows, whose first column is 1."""
        if not len(rows):
            return Factor(0, np.zeros(rows.shape[1]), rows)
        shift = rows[0].copy()
        shift[0] = 0.0
        return Factor(len(rows), shift, np.linalg.qr(rows - shift, mode="r"))

    def merged(self, other: Factor) -> Factor:
        if not self.n or not other.n:
            return self if self.n else other
        moved = other.r.copy()
        moved += np.outer(moved[:, 0], other.shift - self.shift)
        return Factor(self.n + other.n, self.shift, np.linalg.qr(np.vstack([self.r, moved]), mode="r"))


def _runs(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[np.ndarray]:
    """The row numbers of every key in a batch (NULL is a key)."""
    if not keys:
        yield np.arange(batch.num_rows)
        return
    codes = pa.Table.from_batches([batch]).select(list(keys)).to_pandas().groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)


def partial_factors(df: DataFrame, keys: Sequence[str], columns: Sequence[Column], needed: Sequence[Column] = ()) -> DataFrame:
    """(keys, n, shift, r) of (1, columns) over the rows where all columns, and those ``needed``
    besides, are known: one row per key and task, also for keys without such a row."""
    names = [f"_c{i}" for i in range(len(columns))]
    known = F.lit(True)
    for c in (*columns, *needed):
        known = known & c.isNotNull()
    x = df.select(*[F.col(f"`{k}`") for k in keys], *[c.cast("double").alias(n) for c, n in zip(columns, names)], known.alias("_known"))
    keys, m = list(keys), len(columns) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Factor] = {}
        kinds: list[pa.DataType] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], kind) for i, kind in enumerate(kinds)]
            columns += [pa.array([f.n for f in held.values()], pa.int64()), pa.array([f.shift.tolist() for f in held.values()], pa.list_(pa.float64())),
                        pa.array([f.r.ravel().tolist() for f in held.values()], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "n", "shift", "r"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(k).type for k in keys]
            rows = np.ones((batch.num_rows, m))
            for i, name in enumerate(names):
                rows[:, i + 1] = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            known = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            for run_rows in _runs(batch, keys):
                key = tuple(batch.column(batch.schema.get_field_index(k))[int(run_rows[0])].as_py() for k in keys)
                own = Factor.of(rows[run_rows[known[run_rows]]])
                held[key] = held[key].merged(own) if key in held else own
                if len(held) >= KEYS_HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    kept = [f for f in x.schema.fields if f.name in keys]
    schema = T.StructType([*kept, *T.StructType.fromDDL("n bigint, shift array<double>, r array<double>").fields])
    return x.mapInArrow(run, schema)


def solve_factors(parts: DataFrame, keys: Sequence[str], fields: str, solve: Callable[[tuple, Factor], list[dict]]) -> DataFrame:
    """Merges the factors of every key and gives the rows of ``solve(key, factor)``: (keys, fields)."""
    keys = list(keys)
    kept = [f for f in parts.schema.fields if f.name in keys]
    schema = T.StructType([*kept, *T.StructType.fromDDL(fields).fields])
    names = [f.name for f in schema.fields[len(kept):]]

    def run(table: pa.Table) -> pa.Table:
        total = None
        for n, shift, r in zip(table.column("n").to_pylist(), table.column("shift").to_pylist(), table.column("r").to_pylist()):
            own = Factor(n, np.array(shift), np.array(r).reshape(-1, len(shift)))
            total = own if total is None else total.merged(own)
        rows = solve(tuple(table.column(k)[0].as_py() for k in keys), total)
        made = {n: [row[n] for row in rows] for n in names}
        key_columns = {k: pa.array([table.column(k)[0].as_py()] * len(rows), table.schema.field(k).type) for k in keys}
        return pa.table({**key_columns, **{n: pa.array(v, kinds[n]) for n, v in made.items()}})

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {f.name: to_arrow_type(f.dataType) for f in schema.fields}
    if keys:
        return parts.groupBy(*keys).applyInArrow(run, schema)
    return parts.withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(lambda t: run(t.drop_columns(["_g"])), schema)


@dataclass
class Model:
    """Terms and response as linear forms of the factor's columns: ``terms[i][c]`` is the weight of
    column c (0 is the constant) in term i; a term that is the constant alone has to come first."""
    names: list[str]
    terms: list[dict[int, float]]
    response: dict[int, float]


@dataclass
class Fit:
    coef: list[float]
    rss: float


def least_squares(factor: Factor, model: Model) -> Fit:
    """Coefficients and residual sum of squares. A term that depends on the ones before it gets 0;
    the residual sum is at least what rounding leaves of an exact fit."""
    m, k = len(factor.shift), len(model.terms)
    form = np.zeros((m, k + 1))
    for j, weights in enumerate([*model.terms, model.response]):
        for c, w in weights.items():
            form[c, j] += w
    const = bool(k) and model.terms[0] == {0: 1.0}
    level = form[0] + factor.shift @ form  # the multiple of the constant in every column
    if const:
        level[0] = 0.0
        form[0, 1:] = 0.0  # the constant's own coefficient takes the levels up
    else:
        form[0] = level
    a = factor.r @ form
    a = np.vstack([a, np.zeros((max(0, k + 1 - len(a)), k + 1))])
    kept: list[int] = []
    for j in range(k):
        corner = np.linalg.qr(a[:, [*kept, j]], mode="r")[len(kept), len(kept)]
        if not abs(corner) <= DEPENDENT * np.linalg.norm(a[:, j]):
            kept.append(j)
    r = np.linalg.qr(a[:, [*kept, k]], mode="r")
    c = len(kept)
    coef = np.zeros(k)
    coef[kept] = np.linalg.solve(r[:c, :c], r[:c, c]) if c else []
    if const:
        coef[0] += level[k] - coef @ level[:k]
    rss = max(float(r[c, c]) ** 2, 1e-28 * float(a[:, k] @ a[:, k]), 1e-300)
    return Fit([float(v) for v in coef], rss)
