"""Weighted inversions of a rank in a given order, by radix counts.

An inversion is a pair of rows whose ranks fall while the order rises. It happens in exactly one byte
of the ranks: the bytes above agree and this one falls. So every row is dealt once per byte (three
copies for up to 16 million ranks), ordered by (byte, bytes above, order) in range partitions, and
each task reads its rows as a stream: a batch counts its own inversions, and a table of 256 counts
carries what came before in the same group. Only the groups at a task's two ends can go on elsewhere;
their tables are handed over and summed across partitions. Memory is one batch and three tables,
whatever the size of a group, and no pair of rows is formed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.exprs import q
from kiln.operators.order import written

DIGIT_BITS = 8
DIGITS = 1 << DIGIT_BITS
_OUT = {"part": pa.int32(), "level": pa.int32(), "above": pa.int64(), "digit": pa.int32(), "n": pa.int64(),
        "greater": pa.int64(), "inside": pa.decimal128(38, 0)}


def _dot(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of two lists of counts, exact beyond 64 bits as well."""
    if not len(a) or int(a.max()) * int(b.max()) * len(a) < 1 << 62:
        return int(a @ b)
    return int(a.astype(object) @ b.astype(object))


def _inside(group: np.ndarray, digit: np.ndarray, count: np.ndarray) -> int:
    """Weighted inversions of the digits inside every group of an ordered batch."""
    value, total = group * DIGITS + digit, 0
    for bit in range(DIGIT_BITS):
        above = value >> (bit + 1)
        order = np.argsort(above, kind="stable")
        one = (value[order] >> bit & 1) == 1
        c = count[order]
        ones = np.where(one, c, 0)
        seen = np.cumsum(ones)
        first = np.flatnonzero(np.diff(above[order], prepend=-1))
        base = np.repeat((seen - ones)[first], np.diff(first, append=len(order)))
        total += _dot(c - ones, seen - base)
    return total


def _greater(table: np.ndarray) -> np.ndarray:
    """For each digit, the count of the greater ones."""
    return table[::-1].cumsum()[::-1] - table


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range partition in order: its own inversions, and the tables of its first and last group."""
    part, total, edges = TaskContext.get().partitionId(), 0, []
    for batch in batches:
        if not batch.num_rows:
            continue
        level, above, digit, count = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
        start = np.flatnonzero(np.concatenate([[True], (np.diff(level) != 0) | (np.diff(above) != 0)]))
        end = np.append(start[1:], len(level))
        total += _inside(np.repeat(np.arange(len(start)), end - start), digit, count)
        for j in sorted({0, len(start) - 1}):  # the groups between them begin and end in this batch
            key = (int(level[start[j]]), int(above[start[j]]))
            table = np.zeros(DIGITS, dtype=np.int64)
            np.add.at(table, digit[start[j]: end[j]], count[start[j]: end[j]])
            if edges and edges[-1][0] == key:
                total += _dot(table, _greater(edges[-1][1]))
                edges[-1][1] += table
            else:
                edges = [*edges[:1], [key, table]]
    rows = [(part, None, None, None, None, None, Decimal(total))]
    for (level, above), table in edges:
        greater = _greater(table)
        rows += [(part, level, above, d, int(table[d]), int(greater[d]), None) for d in np.flatnonzero(table + greater).tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.values())], names=list(_OUT))


def inversions(df: DataFrame, order: Sequence[str], rank: str, count: str, ranks: int) -> DataFrame:
    """One row ``inversions`` (decimal): the sum of count * count over the pairs of rows whose ``rank``
    (0 .. ranks - 1, below 2^56) falls as ``order`` rises. ``order`` must tell rows apart."""
    levels = max(1, -(-max(0, ranks - 1).bit_length() // DIGIT_BITS))
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = df.select(q(rank).cast("long").alias("_r"), q(count).cast("long").alias("n"), *[q(c).alias(k) for c, k in zip(order, keys)],
                      F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    dealt = dealt.select("level", F.expr(f"shiftright(_r, (level + 1) * {DIGIT_BITS})").alias("above"),
                         F.expr(f"cast(shiftright(_r, level * {DIGIT_BITS}) & {DIGITS - 1} as int)").alias("digit"), "n", *keys)
    sort = ["level", "above", *keys]
    streamed = (dealt.repartitionByRange(*sort).sortWithinPartitions(*sort).select("level", "above", "digit", "n")
                .mapInArrow(_stream, "part int, level int, above long, digit int, n long, greater long, inside decimal(38,0)"))
    tables = written(streamed, "inversions")  # some hundred rows a partition, read twice
    before = Window.partitionBy("level", "above", "digit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    across = (tables.filter(F.col("inside").isNull())
              .select((F.col("n").cast("decimal(18,0)") * F.sum("greater").over(before).cast("decimal(18,0)")).cast("decimal(38,0)").alias("inside")))
    return tables.select("inside").unionByName(across).agg(F.coalesce(F.sum("inside"), F.lit(0).cast("decimal(38,0)")).alias("inversions"))
