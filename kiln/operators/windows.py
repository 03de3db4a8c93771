"""Supervised sequence windows (P5) and context / target windows.

Windows of neighbouring starts share nearly all their rows, so the stored form is one array per
block of ``block`` consecutive starts of a series: the block's rows and the ``reach`` rows behind
them (``sequence_blocks``, ``context_blocks``). It holds n + reach * blocks rows, where a window per
start would hold n * L; windows are cut from it at use (``cut_sequences``, ``cut_context``), or read
in place (``operators.window_fit``). A task needs one block at a time. Window contents are
``array<array<double>>`` ordered by time step (outer) and channel (inner).
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.exprs import q
from kiln.operators.order import assign_row_id, keys_of

MIN_TRAIN_MARGIN = 50
FEW_WINDOWS = 50
#: Window starts in a block, or four times the reach of a window where that is more: at most a
#: quarter is halo, and where Spark copies a block's row for each window cut from it, it stays small.
WINDOW_BLOCK = 256


def _blocks(df: DataFrame, keys: Sequence[str], reach: int, values: Sequence[Column], per_series: Sequence[str],
            block: int | None) -> tuple[DataFrame, int]:
    """(keys, _blk, _rows, per_series): the rows of every block of starts and the ``reach`` rows
    behind it, in order; and the block's number of starts. ``df`` has positions ``_rid``."""
    b = block or max(WINDOW_BLOCK, 4 * (reach + 1))
    if b <= reach:
        raise ValueError(f"block size {b} must exceed the frame reach {reach}")
    own = F.floor(F.col("_rid") / F.lit(b)).cast("bigint")
    before = F.when((F.col("_rid") % b < reach) & (own > 0), own - 1)
    rows = df.select(*[q(k) for k in keys], *per_series, F.struct("_rid", *values).alias("_row"),
                     F.explode(F.filter(F.array(own, before), lambda x: x.isNotNull())).alias("_blk"))
    return rows.groupBy(*keys, "_blk").agg(F.sort_array(F.collect_list("_row")).alias("_rows"),
                                           *[F.max(c).alias(c) for c in per_series]), b


def _cut(blocks: DataFrame, stride: int) -> DataFrame:
    """One row per window, with its number ``_i`` in the block and its ``start``. What is not plain
    code generation (higher-order functions) stays below the generator, once per block."""
    every = F.sequence(F.lit(0), F.col("n_windows") - 1)
    if stride > 1:
        every = F.filter(every, lambda i: (F.col("first") + i) % stride == 0)
    return blocks.withColumn("_every", every).withColumn("_i", F.explode("_every")).withColumn("start", F.col("first") + F.col("_i"))


def sequence_blocks(df: DataFrame, features: Sequence[str], target: str, L: int, h: int = 1,
                    order_cols: Sequence[str] | None = None, key=None, block: int | None = None,
                    adapt_length: bool = True) -> DataFrame:
    """The windows of ``sequences`` by block: (key, ``first`` start, ``n_windows``, ``seq_len``,
    ``x`` = the n_windows + seq_len - 1 feature rows, ``y`` = the target of each window)."""
    keys = keys_of(key)
    if h < 1 or L < 1:
        raise ValueError("L and h must be >= 1")
    chans = list(features) or [target]
    x = assign_row_id(df, list(order_cols), key=keys, row_id="_rid", with_count="_n")
    if adapt_length:
        longest = int(x.agg(F.max("_n")).first()[0] or 0)
        if longest - h - MIN_TRAIN_MARGIN < 1:
            raise ValueError(f"series too short ({longest} rows) for a window with horizon {h}")
        x = x.withColumn("_len", F.least(F.lit(L), F.greatest(F.col("_n") - h - MIN_TRAIN_MARGIN, F.lit(0))).cast("int"))
    else:
        x = x.withColumn("_len", F.lit(L))
    step = F.array(*[q(c).cast("double") for c in chans])
    out, b = _blocks(x, keys, L + h - 1, [step.alias("c"), q(target).cast("double").alias("t")], ["_n", "_len"], block)
    out = out.withColumn("first", F.col("_blk") * b).withColumn(
        "n_windows", F.least(F.lit(b), F.col("_n") - F.col("_len") - h + 1 - F.col("first")).cast("int"))
    out = out.filter((F.col("_len") >= 1) & (F.col("n_windows") >= 1))
    return out.select(*[q(k) for k in keys], "first", "n_windows", F.col("_len").alias("seq_len"),
                      F.slice(F.col("_rows.c"), F.lit(1), F.col("n_windows") + F.col("_len") - 1).alias("x"),
                      F.slice(F.col("_rows.t"), F.col("_len") + h, F.col("n_windows")).alias("y"))


def cut_sequences(blocks: DataFrame, key=None, stride: int = 1) -> DataFrame:
    """The windows of ``sequence_blocks``, one row each, as ``sequences`` gives them."""
    return _cut(blocks, stride).select(*[q(k) for k in keys_of(key)], "start", F.slice("x", F.col("_i") + 1, F.col("seq_len")).alias("x"),
                                       F.get("y", "_i").alias("y"), "seq_len")


def sequences(df: DataFrame, features: Sequence[str], target: str, L: int, h: int = 1,
              order_cols: Sequence[str] | None = None, key=None, stride: int = 1,
              block: int | None = None, adapt_length: bool = True) -> DataFrame:
    """Window i: ``x`` = rows i..i+L-1 of the features (the target alone when no features
    are given), ``y`` = target at row i+L+h-1; ``n-L-h+1`` windows per series. A series with
    ``L > n-h-50`` has its own length lowered to that (``seq_len``); one too short for any
    window has none, and it is an error if that holds for every series."""
    return cut_sequences(sequence_blocks(df, features, target, L, h, order_cols, key, block, adapt_length), key, stride)


def context_blocks(df: DataFrame, channels: Sequence[str], L: int, H: int,
                   order_cols: Sequence[str] | None = None, key=None, block: int | None = None) -> DataFrame:
    """The windows of ``context_windows`` by block: (key, ``first`` start, ``n_windows``, ``steps`` =
    the n_windows + L + H - 1 rows of the channels)."""
    keys = keys_of(key)
    bad = [c for c in channels if not isinstance(df.schema[c].dataType, T.NumericType)]
    if bad:
        raise ValueError(f"non-numeric channels: {bad}")
    known = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.abs(q(c).cast("double")) == float("inf")).alias(f"w{i}") for i, c in enumerate(channels)],
                                  *[F.count_if(q(c).isNull()).alias(f"z{i}") for i, c in enumerate(channels)])
    found = known.agg(F.min("n").alias("n"), *[F.sum(f"{k}{i}").alias(f"{k}{i}") for k in "wz" for i in range(len(channels))]).first()
    if any(found[f"w{i}"] for i in range(len(channels))):
        raise ValueError("channels hold infinite values")
    empty = [c for i, c in enumerate(channels) if found[f"z{i}"]]
    if empty:
        warnings.warn(f"channels hold NULLs, which past_observed marks: {empty}", stacklevel=3)
    least = max(0, (found["n"] or 0) - L - H + 1)
    if least < FEW_WINDOWS:
        warnings.warn(f"{least} windows of the shortest series; {FEW_WINDOWS} or more are advised", stacklevel=3)
    x = assign_row_id(df, list(order_cols), key=keys, row_id="_rid", with_count="_n")
    step = F.array(*[q(c).cast("double") for c in channels])
    out, b = _blocks(x, keys, L + H - 1, [step.alias("c")], ["_n"], block)
    out = out.withColumn("first", F.col("_blk") * b).withColumn(
        "n_windows", F.least(F.lit(b), F.col("_n") - (L + H - 1) - F.col("first")).cast("int"))
    return out.filter("n_windows >= 1").select(*[q(k) for k in keys], "first", "n_windows",
                                               F.slice(F.col("_rows.c"), F.lit(1), F.col("n_windows") + (L + H - 1)).alias("steps"))


def cut_context(blocks: DataFrame, L: int, H: int, key=None, stride: int = 1) -> DataFrame:
    """The windows of ``context_blocks``, one row each, as ``context_windows`` gives them."""
    known = blocks.withColumn("_known", F.transform("steps", lambda s: F.transform(s, lambda v: v.isNotNull())))
    past = F.col("_i") + 1
    return _cut(known, stride).select(*[q(k) for k in keys_of(key)], "start", F.slice("steps", past, F.lit(L)).alias("past"),
                                      F.slice("steps", past + L, F.lit(H)).alias("future"), F.slice("_known", past, F.lit(L)).alias("past_observed"))


def context_windows(df: DataFrame, channels: Sequence[str], L: int, H: int,
                    order_cols: Sequence[str] | None = None, key=None, stride: int = 1,
                    block: int | None = None) -> DataFrame:
    """Window i: ``past`` = rows i..i+L-1, ``future`` = rows i+L..i+L+H-1, all channels in
    both, plus ``past_observed`` (not NULL) masks; ``n-L-H+1`` windows per series.
    Non-numeric channels and infinite values raise; NULLs, and a series with fewer than 50 windows,
    give a warning."""
    return cut_context(context_blocks(df, channels, L, H, order_cols, key, block), L, H, key, stride)


def window_counts(windows: DataFrame, key=None) -> DataFrame:
    keys = keys_of(key)
    return windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"))
