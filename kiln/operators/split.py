"""Column validation, stratified and temporal splits, supervised shift and rolling-origin
folds (P1-P4, P7-P9).

Splits are deterministic: stratified assignment ranks rows by a portable hash of their
id inside each class (range-partitioned, so a dominant class is spread over many tasks);
temporal assignment uses row positions from :func:`kiln.operators.order.assign_row_id`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.exprs import portable_hash, q
from kiln.operators.order import add_lag_columns, assign_row_id, keys_of

RATIO_TOLERANCE = 0.001


def check_ratios(ratios: Sequence[float]) -> tuple[float, float, float]:
    """Three non-negative ratios summing to 1 +- 0.001, train > 0."""
    if len(ratios) != 3:
        raise ValueError("three ratios expected: train, val, test")
    r = tuple(float(x) for x in ratios)
    if any(x < 0 for x in r):
        raise ValueError(f"ratios must be non-negative: {r}")
    if abs(sum(r) - 1.0) > RATIO_TOLERANCE + 1e-12:
        raise ValueError(f"ratios must sum to 1 (+-{RATIO_TOLERANCE}), got {sum(r)}")
    if r[0] <= 0:
        raise ValueError("train ratio must be positive")
    return r  # type: ignore[return-value]


# ----------------------------------------------------------------------------- P1
def validate_data(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Raises on missing columns; returns (column, null_count, warning) for every feature
    and the target (one aggregate)."""
    cols = [*features, target]
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    agg = df.agg(*[F.count_if(q(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    stack = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").cast("bigint").alias("null_count"))
                      for i, c in enumerate(cols)])
    out = agg.select(F.explode(stack).alias("x")).select("x.*")
    return out.withColumn("warning", F.when(F.col("null_count") > 0,
                                            F.concat(F.lit("column "), F.col("column"), F.lit(" has "),
                                                     F.col("null_count").cast("string"), F.lit(" missing values"))))


# ----------------------------------------------------------------------------- P2
def stratified_split(df: DataFrame, label: str, ratios: Sequence[float] = (0.7, 0.15, 0.15),
                     id_cols: Sequence[str] = (), seed: int = 42, out: str = "split") -> DataFrame:
    """Train / val / test inside each class. Rows are ordered by ``portable_hash`` of
    all id columns (then id) within the class; the class keeps ``ceil(n*(val+test))`` rows for the
    second cut, which gives ``ceil(m*test/(val+test))`` to test and the rest to val."""
    r_train, r_val, r_test = check_ratios(ratios)
    if not id_cols:
        raise ValueError("stratified_split needs id columns to hash (row order is not implicit)")
    x = df.withColumn("_h", portable_hash([q(c) for c in id_cols], seed))
    x = assign_row_id(x, ["_h", *id_cols], key=[label], row_id="_pos", with_count="_n")
    temp_share = r_val + r_test
    n_temp = F.ceil(F.col("_n") * F.lit(temp_share) - F.lit(1e-9))
    n_test = F.when(F.lit(temp_share) > 0,
                    F.ceil(n_temp * F.lit(r_test / temp_share if temp_share else 0.0) - F.lit(1e-9))).otherwise(0)
    n_train = F.col("_n") - n_temp
    pos = F.col("_pos")
    split = (F.when(pos < n_train, F.lit("train"))
              .when(pos < n_train + (n_temp - n_test), F.lit("val"))
              .otherwise(F.lit("test")))
    return x.withColumn(out, split).select(*df.columns, out)


# ----------------------------------------------------------------------------- P3
def temporal_split(df: DataFrame, ratios: Sequence[float] = (0.7, 0.15, 0.15),
                   order_cols: Sequence[str] | None = None, key=None, row_id: str | None = None,
                   count_col: str | None = None, out: str = "split", layout: str = "blocked",
                   strict: bool = False) -> DataFrame:
    """First ``int(n*train)`` rows train, next ``int(n*val)`` val, rest test (per key).

    ``layout="blocked"`` computes positions without a per-key window (safe for one huge
    series); ``"keyed"`` uses ``Window.partitionBy(key)`` for series of bounded length.
    With ``strict`` an empty part raises (the context-window variant)."""
    r_train, r_val, _ = check_ratios(ratios)
    keys = keys_of(key)
    x = df
    if row_id is None or count_col is None:
        if layout == "keyed" and keys:  # without a key the whole table would be one partition
            w = Window.partitionBy(*[q(k) for k in keys]).orderBy(*[q(c) for c in order_cols])
            x = df.withColumn("_pos", F.row_number().over(w) - 1) \
                  .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*[q(k) for k in keys])))
        else:
            x = assign_row_id(df, list(order_cols), key=keys, row_id="_pos", with_count="_n")
        pos, n = F.col("_pos"), F.col("_n")
    else:
        pos, n = q(row_id), q(count_col)
    n_train = F.floor(n * F.lit(r_train))
    n_val = F.floor(n * F.lit(r_val))
    split = F.when(pos < n_train, F.lit("train")).when(pos < n_train + n_val, F.lit("val")).otherwise(F.lit("test"))
    res = x.withColumn(out, split).select(*df.columns, out)
    if strict:
        counts = {r[out]: r["count"] for r in res.groupBy(out).count().collect()}
        empty = [s for s in ("train", "val", "test") if counts.get(s, 0) == 0]
        if empty:
            raise ValueError(f"empty split part(s): {empty}")
    return res


# ----------------------------------------------------------------------------- P4
def supervised(df: DataFrame, target: str, features: Sequence[str], h: int = 1,
               order_cols: Sequence[str] | None = None, key=None, ratios: Sequence[float] | None = None,
               y: str = "y", block: int | None = None) -> DataFrame:
    """Target ``h`` steps ahead as ``y`` beside the features now; the last ``h`` rows of
    each series and rows with a NULL in X or y are dropped; optionally split (P3)."""
    if h < 1:
        raise ValueError("forecast horizon must be >= 1")
    keys = keys_of(key)
    x = assign_row_id(df, list(order_cols), key=keys, row_id="_rid", with_count="_n")
    x = add_lag_columns(x, keys, "_rid", [(y, target, -h)], block=block)
    x = x.filter(F.col("_rid") < F.col("_n") - h)
    x = x.dropna(how="any", subset=[*features, y])
    cols = [*keys, *[c for c in (order_cols or []) if c not in keys], *[f for f in features if f not in keys], y]
    x = x.select(*dict.fromkeys(cols))
    if ratios is not None:
        x = temporal_split(x, ratios, order_cols=order_cols, key=keys)
    return x


# ----------------------------------------------------------------------------- P8
def rolling_folds(df: DataFrame, W: int, h: int, folds: int = 5, order_cols: Sequence[str] | None = None,
                  key=None, row_id: str | None = None, count_col: str | None = None) -> DataFrame:
    """Rolling-origin folds: fold f trains on rows [f*h, f*h+W) and tests on the next h
    rows (the last fold may be short; folds with no test row are not emitted). Needs
    n >= W + h. Each row is exploded only into the folds that use it (computed range),
    giving (fold, role) beside the row."""
    if W < 1 or h < 1:
        raise ValueError("W and h must be positive")
    keys = keys_of(key)
    x = df
    if row_id is None:
        x = assign_row_id(df, list(order_cols), key=keys, row_id="_rid", with_count="_n")
        rid, n = F.col("_rid"), F.col("_n")
    else:
        rid, n = q(row_id), q(count_col)
    max_fold = F.least(F.lit(folds - 1), F.floor((n - W - 1) / F.lit(h)))  # last fold with a test row
    tr_lo = F.greatest(F.lit(0), F.ceil((rid - W + 1) / F.lit(h)))
    tr_hi = F.least(max_fold, F.floor(rid / F.lit(h)))
    te_lo = F.greatest(F.lit(0), F.ceil((rid - W - h + 1) / F.lit(h)))
    te_hi = F.least(max_fold, F.floor((rid - W) / F.lit(h)))

    def rng(lo: Column, hi: Column, role: str) -> Column:
        return F.when(hi >= lo, F.transform(F.sequence(lo.cast("int"), hi.cast("int")),
                                            lambda f: F.struct(f.alias("fold"), F.lit(role).alias("role")))) \
                .otherwise(F.array().cast("array<struct<fold:int,role:string>>"))

    tagged = x.withColumn("_fr", F.explode(F.concat(rng(tr_lo, tr_hi, "train"), rng(te_lo, te_hi, "test"))))
    tagged = tagged.filter(n >= W + h)
    return tagged.select(*df.columns, F.col("_fr.fold").alias("fold"), F.col("_fr.role").alias("role"))


# ----------------------------------------------------------------------------- P9
def numeric_features(df: DataFrame, cols: Sequence[str], strict: bool = False) -> tuple[list[str], list[str]]:
    """Split requested features into numeric (kept) and the rest (reported); ``strict``
    raises instead."""
    keep, bad = [], []
    for c in cols:
        (keep if isinstance(df.schema[c].dataType, T.NumericType) else bad).append(c)
    if bad and strict:
        raise ValueError(f"non-numeric features: {bad}")
    return keep, bad


def default_window_size(n: int, train_ratio: float) -> int:
    return int(math.floor(n * train_ratio))
