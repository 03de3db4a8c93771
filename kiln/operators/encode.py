"""Categorical encodings, boolean casts and lag features.

Dummy columns are metadata: their category lists are read with one ``distinct`` and the
encoding itself is a single projection. Label codes need no list: they are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.exprs import MISSING_CATEGORY, q
from kiln.operators.order import add_lag_columns, assign_row_id, forward_fill, keys_of, look_up, written

def categories(df: DataFrame, cols: Sequence[str], max_categories: int | None = None,
               include_null: bool = False) -> dict[str, list]:
    """Sorted distinct values per column in one job; raises past ``max_categories`` where the
    caller names one (a dummy column per value is as wide as the values are many)."""
    cols = list(cols)
    if not cols:
        return {}
    items = F.array(*[F.struct(F.lit(i).alias("c"), q(c).cast("string").alias("v"),
                               (q(c).cast("double") if isinstance(df.schema[c].dataType, T.NumericType)
                                else F.lit(None).cast("double")).alias("n"))
                      for i, c in enumerate(cols)])
    u = df.select(F.explode(items).alias("x")).select("x.*").distinct()
    if not include_null:
        u = u.filter(F.col("v").isNotNull())
    rows = (u if max_categories is None else u.limit(len(cols) * max_categories + 1)).collect()
    out: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        out[cols[r["c"]]].append((r["n"], r["v"]))
    res = {}
    for c in cols:
        vals = out[c]
        if max_categories is not None and len(vals) > max_categories:
            raise ValueError(f"column {c!r} has more than {max_categories} categories")
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        if numeric:
            vals.sort(key=lambda t: (t[1] is None, t[0] if t[0] is not None else 0.0))
        else:
            vals.sort(key=lambda t: (t[1] is None, t[1] or ""))
        res[c] = [v for _, v in vals]
    return res


def _value_label(v) -> str:
    return "nan" if v is None else str(v)


# ----------------------------------------------------------------------------- E1 / E2
def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = True, dtype: str = "int",
            max_categories: int | None = None, sort_columns: bool = False) -> DataFrame:
    """Dummy columns ``{col}_{value}`` for string input columns (numeric ones are left
    alone), categories sorted, the first dropped, NULL -> all zeros; dummies appended at
    the end, sources removed. ``dtype="double"`` with ``sort_columns`` is the TS variant."""
    targets = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    if not targets:
        return df
    cats = categories(df, targets, max_categories)
    dummies = []
    for c in targets:
        vals = cats[c][1:] if drop_first else cats[c]
        for v in vals:
            dummies.append(F.when(q(c) == F.lit(v), F.lit(1)).otherwise(F.lit(0)).cast(dtype).alias(f"{c}_{v}"))
    keep = [q(c) for c in df.columns if c not in targets]
    out = df.select(*keep, *dummies)
    if sort_columns:
        names = [n for c in targets for n in sorted(f"{c}_{v}" for v in (cats[c][1:] if drop_first else cats[c]))]
        return out.select(*keep, *[q(n) for n in names])
    return out


# ----------------------------------------------------------------------------- E3
def one_hot_target(df: DataFrame, cols: Sequence[str], max_categories: int | None = None) -> DataFrame:
    """All categories kept as float 0/1 ``{col}_{value}``; NULL is its own ``nan``
    category; string and integer columns only."""
    targets = [c for c in cols if isinstance(df.schema[c].dataType, (T.StringType, T.IntegralType))]
    if not targets:
        return df
    cats = categories(df, targets, max_categories, include_null=True)
    dummies = []
    for c in targets:
        for v in cats[c]:
            cond = q(c).isNull() if v is None else (q(c).cast("string") == F.lit(v))
            dummies.append(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{_value_label(v)}"))
    return df.select(*[q(c) for c in df.columns if c not in targets], *dummies)


# ----------------------------------------------------------------------------- E4
#: Rows that one task may hold where all share a label; labels of larger tables are looked up.
TOGETHER_ROWS = 1_000_000


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """0..k-1 by sorted distinct value (numeric order for numbers); NULL stays NULL. Columns
    of any number of values: the distinct values are numbered by the order layer and looked up
    by the rows, so no value list passes through the driver or the plan, and no value fills a task."""
    out = df
    for n, c in enumerate(c for c in cols if c in df.columns):
        known = df.filter(q(c).isNotNull())
        codes = assign_row_id(known.groupBy(q(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), ["_v"], row_id="_code").select(
            "_v", "_n", F.col("_code").cast("int").alias(f"_code{n}"))
        total = known.count()
        if total <= TOGETHER_ROWS:
            codes = codes.select(F.col("_v").alias(f"_v{n}"), f"_code{n}")
            out = out.join(codes, q(c) == F.col(f"_v{n}"), "left").drop(f"_v{n}")
        else:
            out = look_up(out, c, written(codes, "codes"), "_v", "_n", total, [f"_code{n}"])
    done = {c: f"_code{n}" for n, c in enumerate(c for c in cols if c in df.columns)}
    return out.select(*[F.col(done[c]).alias(c) if c in done else q(c) for c in df.columns])


# ----------------------------------------------------------------------------- E5
def bool_to_int(df: DataFrame) -> DataFrame:
    return df.select(*[q(f.name).cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType) else q(f.name)
                       for f in df.schema.fields])


# ----------------------------------------------------------------------------- E6 / E11
def usable(cols: Sequence[str], token: str = MISSING_CATEGORY) -> list[str]:
    """Drop requested names that end in ``_{token}`` (dummies of the missing category)."""
    return [c for c in cols if not c.endswith(f"_{token}")]


def require_columns(df: DataFrame, inputs: Sequence[str], targets: Sequence[str],
                    allow_empty_inputs: bool = False) -> None:
    missing = [c for c in [*inputs, *targets] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    if not inputs and not allow_empty_inputs:
        raise ValueError("at least one input column is required")
    if not targets:
        raise ValueError("at least one target column is required")


def check_target_encodings(one_hot_targets: Sequence[str], label_targets: Sequence[str]) -> None:
    both = set(one_hot_targets) & set(label_targets)
    if one_hot_targets and label_targets:
        raise ValueError(f"choose one-hot or label encoding for targets, not both ({sorted(both)})")


# ----------------------------------------------------------------------------- E7
def add_lags(df: DataFrame, features: Sequence[str], n: int, order_cols: Sequence[str] | None = None,
             key=None, row_id: str | None = None, block: int | None = None) -> DataFrame:
    """``{f}_lag_1 .. {f}_lag_n`` for each feature in row order (``order_cols`` or an
    existing ``row_id``). All lags share one halo-block window, no global sort."""
    if n <= 0 or not features:
        return df
    keys = keys_of(key)
    x = df
    rid = row_id
    if rid is None:
        if not order_cols:
            raise ValueError("add_lags needs order_cols or row_id")
        x = assign_row_id(df, list(order_cols), key=keys, row_id="_lag_rid")
        rid = "_lag_rid"
    specs = [(f"{f}_lag_{i}", f, i) for f in features for i in range(1, n + 1)]
    out = add_lag_columns(x, keys, rid, specs, block=block)
    return out.select(*df.columns, *[s[0] for s in specs])


# ----------------------------------------------------------------------------- E8-E10
def handle_lag_nulls(df: DataFrame, policy: str = "leave_as_is", order_cols: Sequence[str] | None = None,
                     key=None, row_id: str | None = None, block: int | None = None) -> DataFrame:
    """``drop``: rows with a NULL in any column; ``forward_fill``: last non-NULL above,
    all columns (leading NULLs stay); ``leave_as_is``: identity; other names: error."""
    if policy == "drop":
        return df.dropna(how="any")
    if policy in ("forward_fill", "ffill"):
        keys = keys_of(key)
        x, rid = df, row_id
        if rid is None:
            if not order_cols:
                raise ValueError("forward fill needs order_cols or row_id")
            x = assign_row_id(df, list(order_cols), key=keys, row_id="_ff_rid")
            rid = "_ff_rid"
        cols = [c for c in df.columns if c not in keys and c != rid and c not in (order_cols or [])]
        return forward_fill(x, keys, rid, cols, block=block).select(*df.columns)
    if policy in ("leave_as_is", "keep"):
        return df
    raise ValueError(f"unknown lag NULL policy {policy!r}")
