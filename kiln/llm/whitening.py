"""Embedding whitening from a polarisation covariance (operator 12).

The vectors are whole numbers (``quantised``), so every sum is exact and does not depend on how
rows are dealt out. Three passes over the stored rows:

1. n and the sum S of each dimension;
2. with the scaled centred values y = n x - S, the sum of squares of every y_i and of every
   y_i + y_j. Half of V(i + j) - V(i) - V(j) is the cross sum of i and j, so no product of two
   dimensions is ever taken, and the covariance C / n^3 is rounded once, at the end;
3. the covariance of the whitened values, whose largest distance from the identity is the error.

Tasks add up in 64 bits and hand over limbs of 32 bits, d (d + 1) / 2 rows a task; Spark adds these,
and the driver holds d^2 numbers, whatever the number of rows.

Defined results: a NULL or empty vector, or one with NULL or non-finite entries, is left out; vectors
of several lengths are an error, and so is a deviation beyond 64 bits. A component without variance
(below ``LEAST_SHARE`` of the first) whitens to NULL and does not count for the error. Repeated rows
count as often as they occur; rows with a NULL id stay; other columns pass through, and columns of
the output's names are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.shared import bounded_batches

#: Rows whose pair sums are held at a time.
SLICE = 4096
LIMBS, LIMB_BITS = 6, 32
#: Scaled centred values below this go through 64-bit arithmetic, larger ones through Python's integers.
FAST_BELOW = 1 << 60
#: Components with a smaller share of the first one's variance are rounding.
LEAST_SHARE = 1e-12


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def quantised(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * entry) + shift of every entry, as long."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * scale) + F.lit(shift).cast("bigint"))


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = np.unique(np.diff(column.offsets.to_numpy()))
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {lengths.tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield _matrix(batch.slice(at, SLICE).column(0))


def _centred(x: np.ndarray, n: int, sums: Sequence[int], most: int) -> np.ndarray:
    """n x - S, exact."""
    if n * most + max(map(abs, sums)) < FAST_BELOW:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _square_sums(z: np.ndarray) -> list[int]:
    """The exact sum of squares of every column."""
    if z.dtype == object:
        return list((z * z).sum(axis=0))
    high, low = z >> 31, z & ((1 << 31) - 1)
    total = np.zeros(z.shape[1], dtype=object)
    for part, bits in ((high * high, 62), (2 * high * low, 31), (low * low, 0)):
        # halves of 32 bits, so that their sums stay far below 64
        total += ((part >> 32).sum(axis=0).astype(object) * (1 << 32) + (part & 0xFFFFFFFF).sum(axis=0).astype(object)) * (1 << bits)
    return [int(v) for v in total]


def _limbs(value: int) -> list[int]:
    """The value in base 2^32; the last limb has the sign and the rest."""
    return [(value >> LIMB_BITS * k) & 0xFFFFFFFF for k in range(LIMBS - 1)] + [value >> LIMB_BITS * (LIMBS - 1)]


def _added(parts: DataFrame) -> dict[int, int]:
    """Totals by place of rows (place, limb_0 ..); as many rows reach the driver as there are places."""
    names = [c for c in parts.columns if c.startswith("limb_")]
    rows = parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in names]).collect()
    return {r["place"]: sum(int(r[c]) << LIMB_BITS * k for k, c in enumerate(names)) for r in rows}


def _exact_sums(vectors: DataFrame, work) -> dict[int, int]:
    """``work(slices)`` gives the task's totals, a list of integers; their sums over all tasks."""
    schema = "place int, " + ", ".join(f"limb_{k} bigint" for k in range(LIMBS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = work(_slices(batches))
        limbs = [_limbs(int(t)) for t in totals]
        columns = [pa.array(range(len(totals)), pa.int32()), *[pa.array([v[k] for v in limbs], pa.int64()) for k in range(LIMBS)]]
        yield pa.RecordBatch.from_arrays(columns, names=["place", *[f"limb_{k}" for k in range(LIMBS)]])

    return _added(vectors.mapInArrow(run, schema))


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


@dataclass
class Moments:
    """n, the sums S, and the exact cross sums of n x - S over all rows."""
    n: int
    sums: list[int]
    cross: list[list[int]]
    most: int

    def covariance(self) -> np.ndarray:
        """Divisor n; every entry is correctly rounded."""
        return np.array([[c / self.n ** 3 for c in row] for row in self.cross], dtype=float).reshape(len(self.sums), len(self.sums))


def moments(df: DataFrame, vector_col: str) -> Moments:
    """The exact moments of a column array<bigint> without NULLs."""
    bounded_batches(df.sparkSession)
    vectors = df.select(F.col(f"`{vector_col}`").alias("x"))
    shape = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"),
                        F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))).alias("most")).first()
    n, d, most = shape["n"], shape["high"] or 0, int(shape["most"] or 0)
    if shape["low"] != shape["high"]:
        raise ValueError(f"vectors of several lengths, from {shape['low']} to {shape['high']}")
    if not n or not d:
        return Moments(n, [0] * d, [], most)

    def sums(slices) -> list[int]:
        total = [0] * d
        for x in slices:
            high = (x >> 32).sum(axis=0).tolist()
            low = (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + s for t, h, s in zip(total, high, low)]
        return total

    added = _exact_sums(vectors, sums)
    s = [added[i] for i in range(d)]

    def squares(slices) -> list[int]:
        total = [0] * (d * (d + 1) // 2)
        for x in slices:
            y = _centred(x, n, s, most)
            got = []
            for i in range(d):
                got += _square_sums(np.concatenate([y[:, i:i + 1], y[:, i:i + 1] + y[:, i + 1:]], axis=1))
            total = [t + g for t, g in zip(total, got)]
        return total

    added = _exact_sums(vectors, squares)
    of = {pair: added[k] for k, pair in enumerate(_pairs(d))}  # (i, i): of dimension i; (i, j): of the sum of i and j
    cross = [[of[i, i] if i == j else (of[min(i, j), max(i, j)] - of[i, i] - of[j, j]) // 2 for j in range(d)] for i in range(d)]
    return Moments(n, s, cross, most)


@dataclass
class Whitening:
    """Components by falling variance, with what they were fitted on."""
    moments: Moments
    vectors: np.ndarray  # one column per component
    values: np.ndarray
    explained: list[float | None]

    @property
    def kept(self) -> np.ndarray:
        """Marks the components that have variance."""
        return self.values > LEAST_SHARE * self.values[0] if len(self.values) and self.values[0] > 0 else np.zeros(len(self.values), bool)

    def _whiten(self, y: np.ndarray) -> np.ndarray:
        scale = np.where(self.kept, 1 / np.sqrt(np.where(self.kept, self.values, 1.0)), 0.0)
        return (y.astype(float) / self.moments.n) @ (self.vectors * scale)

    def transform(self, df: DataFrame, vector_col: str, out_col: str = "whitened", deviation_col: str = "deviation") -> DataFrame:
        """``df`` with the whitened vector (array<double>, NULL for components without variance) and
        the exact squared length of n x - S."""
        bounded_batches(df.sparkSession)
        df = df.drop(out_col, deviation_col)
        m, kept = self.moments, self.kept
        at, names, k = df.columns.index(vector_col), df.columns, len(self.values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    part = batch.slice(start, SLICE)
                    y = _centred(_matrix(part.column(at)), m.n, m.sums, m.most)
                    if y.dtype != object and y.shape[1] * int(np.abs(y).max(initial=0)) ** 2 >= 1 << 63:
                        y = y.astype(object)
                    z = self._whiten(y)
                    values = pa.array(z.ravel(), mask=np.tile(~kept, len(z)))
                    whitened = pa.ListArray.from_arrays(pa.array(np.arange(0, len(z) * k + 1, max(k, 1))[:len(z) + 1] if k else np.zeros(len(z) + 1), pa.int32()), values)
                    deviation = pa.array((y * y).sum(axis=1).tolist(), pa.int64())
                    yield pa.RecordBatch.from_arrays([*part.columns, whitened, deviation], names=[*names, out_col, deviation_col])

        made = df.select("*", F.lit(None).cast("array<double>").alias(out_col), F.lit(None).cast("bigint").alias(deviation_col))
        return df.mapInArrow(run, made.schema)

    def identity_error(self, df: DataFrame, vector_col: str) -> float | None:
        """The largest entry, by size, of the whitened covariance minus the identity."""
        bounded_batches(df.sparkSession)
        m, use = self.moments, np.flatnonzero(self.kept)
        k = len(use)
        if not k:
            return None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, second = np.zeros(k), np.zeros((k, k))
            for x in _slices(batches):
                z = self._whiten(_centred(x, m.n, m.sums, m.most))[:, use]
                first += z.sum(axis=0)
                second += z.T @ z
            total = np.concatenate([first, second.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["place", "total"])

        parts = df.select(F.col(f"`{vector_col}`").alias("x")).mapInArrow(run, "place int, total double")
        total = np.zeros(k + k * k)
        for r in parts.groupBy("place").agg(F.sum("total").alias("total")).collect():  # k + k^2 rows
            total[r["place"]] = r["total"] / m.n
        mean, second = total[:k], total[k:].reshape(k, k)
        return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitening(df: DataFrame, vector_col: str, k: int | None = None) -> Whitening:
    """The first ``k`` components (all if None) of the covariance of an array<bigint> column."""
    m = moments(df, vector_col)
    if not m.cross:
        return Whitening(m, np.zeros((len(m.sums), 0)), np.zeros(0), [])
    values, vectors = np.linalg.eigh(m.covariance())
    order = np.argsort(-values, kind="stable")[:k]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    trace = sum(m.cross[i][i] for i in range(len(m.sums))) / m.n ** 3
    return Whitening(m, vectors, values, [float(v) / trace if trace and math.isfinite(trace) else None for v in values])
