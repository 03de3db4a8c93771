"""Residual diagnostics: normal Q-Q points (X13), autocorrelation (X14) and partial
autocorrelation (X15).

The ACF sums are one aggregate over halo-block lags (all lags of all series at once); the
Durbin-Levinson recursion then runs on the <= 21 numbers per series, one small pandas
call per series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.exprs import inv_norm, q
from kiln.operators.order import add_lag_columns, assign_row_id, join_small, keys_of

MAX_ACF_LAG = 20


# ----------------------------------------------------------------------------- X13
def qq_points(df: DataFrame, col: str) -> DataFrame:
    """(i, theoretical, sample) for every non-null value in order: the normal quantile at
    Filliben's order-statistic median of its rank, against the value itself. Ranks come from
    the range-partitioned row ids, so no list of positions exists anywhere."""
    x = df.filter(q(col).isNotNull()).select(q(col).cast("double").alias("sample"))
    x = assign_row_id(x, ["sample"], row_id="i", with_count="_n")
    n, i = F.col("_n"), F.col("i")
    last = F.pow(F.lit(0.5), 1.0 / n)
    p = (F.when(n == 1, F.lit(0.5)).when(i == 0, 1 - last).when(i == n - 1, last)
          .otherwise((i + 1 - 0.3175) / (n + 0.365)))
    return x.select("i", inv_norm(p).alias("theoretical"), "sample")


# ----------------------------------------------------------------------------- X14
def acf(df: DataFrame, col: str, order_cols: Sequence[str], key=None, max_lag: int = MAX_ACF_LAG,
        block: int | None = None) -> DataFrame:
    """(keys, lag, acf) for lags 0..min(max_lag, n//4) per series:
    sum_t (x_t - m)(x_{t-k} - m) / sum_t (x_t - m)^2; NULL for a constant series."""
    keys = keys_of(key)
    x = df.filter(q(col).isNotNull()).select(*[q(k) for k in keys], *[q(c) for c in order_cols if c not in keys],
                                             q(col).cast("double").alias("_x"))
    x = assign_row_id(x, list(order_cols), key=keys, row_id="_rid", with_count="_n")
    means = x.groupBy(*keys).agg(F.avg("_x").alias("_m"))
    x = join_small(x, means, keys)
    x = x.withColumn("_d", F.col("_x") - F.col("_m"))
    x = add_lag_columns(x, keys, "_rid", [(f"_l{k}", "_d", k) for k in range(1, max_lag + 1)], block=block)
    sums = x.groupBy(*keys).agg(F.first("_n").alias("_n"), F.sum(F.col("_d") * F.col("_d")).alias("_s0"),
                                *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, max_lag + 1)])
    arr = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_s{k}"), F.col("_s0")).alias("acf"))
                    for k in range(0, max_lag + 1)])
    out = sums.select(*keys, "_n", F.explode(arr).alias("r")).select(*keys, "_n", "r.*")
    return out.filter(F.col("lag") <= F.least(F.lit(max_lag), F.floor(F.col("_n") / 4))).drop("_n")


# ----------------------------------------------------------------------------- X15
def pacf_from_acf(r: Sequence[float]) -> list[float]:
    """Durbin-Levinson recursion: partial autocorrelations for lags 0..len(r)-1."""
    K = len(r) - 1
    out = [1.0 if r[0] == r[0] else float("nan")]
    phi_prev: list[float] = []
    for k in range(1, K + 1):
        if k == 1:
            phi_kk = r[1]
            phi = [phi_kk]
        else:
            num = r[k] - sum(phi_prev[j] * r[k - 1 - j] for j in range(k - 1))
            den = 1 - sum(phi_prev[j] * r[j + 1] for j in range(k - 1))
            phi_kk = num / den if den != 0 else float("nan")
            phi = [phi_prev[j] - phi_kk * phi_prev[k - 2 - j] for j in range(k - 1)] + [phi_kk]
        out.append(float(phi_kk))
        phi_prev = phi
    return out


def pacf(df: DataFrame, col: str, order_cols: Sequence[str], key=None, max_lag: int = MAX_ACF_LAG,
         block: int | None = None) -> DataFrame:
    """(keys, lag, pacf) from the ACF of each series (one small task per series)."""
    keys = keys_of(key)
    a = acf(df, col, order_cols, keys, max_lag, block)
    per = a.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("_a"))
    key_fields = [f for f in per.schema.fields if f.name in keys]
    schema = T.StructType([*key_fields, T.StructField("lag", T.IntegerType()), T.StructField("pacf", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            vals = [s["acf"] if isinstance(s, dict) else s[1] for s in r["_a"]]
            vals = [float("nan") if v is None else float(v) for v in vals]
            for lag, v in enumerate(pacf_from_acf(vals)):
                rec = {k: r[k] for k in keys}
                rec.update(lag=lag, pacf=None if np.isnan(v) else v)
                rows.append(rec)
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    if keys:
        return per.groupBy(*keys).applyInPandas(run, schema)
    return per.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(lambda p: run(p.drop(columns=["_g"])), schema)
