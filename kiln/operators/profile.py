"""Profiling (G1, G2, G10-G14): one wide aggregate per question, categorical columns
handled on the unpivoted (column, value) form so every column is covered by one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.exprs import numeric_columns, q, string_columns
from kiln.functions.quantiles import exact_quantiles
from kiln.operators.metrics import histogram
from kiln.operators.order import attach_row, join_small, keys_of, written


# ----------------------------------------------------------------------------- G1
def overview(df: DataFrame) -> DataFrame:
    """rows, columns, missing cells and duplicate rows in one grouped pass: rows are
    grouped on all columns, so duplicates = sum(count - 1) and missing cells =
    sum(count * NULLs in the group key)."""
    nulls = sum([F.when(q(c).isNull(), 1).otherwise(0) for c in df.columns], F.lit(0))
    g = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_c")).select("_c", nulls.alias("_m"))
    return g.agg(F.sum("_c").cast("bigint").alias("n_rows"),
                 F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
                 F.sum(F.col("_c") * F.col("_m")).cast("bigint").alias("missing_cells"),
                 F.sum(F.col("_c") - 1).cast("bigint").alias("duplicate_rows"))


# ----------------------------------------------------------------------------- G2
def _unpivot_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("double").alias("value")) for c in cols])
    return df.select(F.explode(arr).alias("u")).select("u.*")


def profile(df: DataFrame, cols: Sequence[str] | None = None, exact_distinct: bool = True,
            quantile_method: str = "exact") -> DataFrame:
    """Numeric columns: count, missing, distinct, min, max, mean, std (sample), q25, q50,
    q75, zeros - one row per column, from the unpivoted (column, value) table."""
    num = numeric_columns(df, cols)
    u = _unpivot_numeric(df, num)
    distinct = F.count_distinct("value") if exact_distinct else F.approx_count_distinct("value")
    base = u.groupBy("column").agg(
        F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("missing"),
        distinct.alias("distinct"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.count_if(F.col("value") == 0).alias("zeros"))
    qs = exact_quantiles(u, "value", [0.25, 0.5, 0.75], by="column", method=quantile_method)
    out = join_small(base, qs.select("column", F.col("q0").alias("q25"), F.col("q1").alias("q50"),
                                     F.col("q2").alias("q75")), ["column"], how="left")
    return out.select("column", F.col("count").cast("bigint"), F.col("missing").cast("bigint"),
                      F.col("distinct").cast("bigint"), "min", "max", "mean", "std", "q25", "q50", "q75",
                      F.col("zeros").cast("bigint"))


def profile_all(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Every column, whatever its type: (column, type, count, missing, distinct, min, max, top,
    top_count), values as text, from one aggregate over (column, value) counts; numeric columns
    get their moments and quantiles from :func:`profile`."""
    names = list(cols or df.columns)
    arr = F.array(*[F.struct(F.lit(i).alias("i"), q(c).cast("string").alias("value")) for i, c in enumerate(names)])
    counts = df.select(F.explode(arr).alias("u")).select("u.*").groupBy("i", "value").agg(F.count(F.lit(1)).alias("c"))
    seen = F.col("value").isNotNull()
    per = counts.groupBy("i").agg(
        F.sum(F.when(seen, F.col("c")).otherwise(0)).alias("count"), F.sum(F.when(seen, 0).otherwise(F.col("c"))).alias("missing"),
        F.count("value").alias("distinct"), F.max(F.when(seen, F.col("c"))).alias("top_count"),
        F.min_by("value", F.when(seen, F.struct(-F.col("c"), F.col("value")))).alias("top"))
    ranges = df.agg(*[f(q(c)).cast("string").alias(f"{n}{i}") for i, c in enumerate(names) for n, f in (("a", F.min), ("z", F.max))])
    kinds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"),
                               F.col(f"a{i}").alias("min"), F.col(f"z{i}").alias("max")) for i, c in enumerate(names)])
    return join_small(ranges.select(F.explode(kinds).alias("k")).select("k.*"), per, ["i"], how="left").select(
        "column", "type", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), F.coalesce("missing", F.lit(0)).cast("bigint").alias("missing"),
        F.coalesce("distinct", F.lit(0)).cast("bigint").alias("distinct"), "min", "max", "top", F.col("top_count").cast("double").alias("top_count"))


def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Most frequent values of each string column (ties by value), as (column, value,
    count, rank). The per-column limit is applied before the final exchange."""
    cats = string_columns(df, cols)
    arr = F.array(*[F.struct(F.lit(c).alias("column"), q(c).alias("value")) for c in cats])
    u = df.select(F.explode(arr).alias("u")).select("u.*").filter(F.col("value").isNotNull())
    counts = u.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
                 .select("column", "value", F.col("count").cast("bigint"), F.col("rank").cast("int"))


# ----------------------------------------------------------------------------- G10
def classify(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, kind, n_distinct): 2 distinct values -> binary; string -> categorical;
    64-bit integer / floating -> numerical; anything else (also the narrower numbers) ->
    unclassified."""
    cols = list(cols or df.columns)
    agg = df.agg(*[F.count_distinct(q(c)).alias(f"d{i}") for i, c in enumerate(cols)])
    recs = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        base = ("categorical" if isinstance(dt, T.StringType) else
                "numerical" if isinstance(dt, (T.LongType, T.DoubleType)) else "unclassified")
        kind = F.when(F.col(f"d{i}") == 2, F.lit("binary")).otherwise(F.lit(base))
        recs.append(F.struct(F.lit(c).alias("column"), kind.alias("kind"), F.col(f"d{i}").cast("bigint").alias("n_distinct")))
    return agg.select(F.explode(F.array(*recs)).alias("r")).select("r.*")


# ----------------------------------------------------------------------------- G11
def crosstab(df: DataFrame, a: str, b: str, max_columns: int | None = None) -> DataFrame:
    """Counts of (a, b) with one column per value of b (sorted); NULL pairs excluded, empty
    cells 0. The table is as wide as b has values: a caller who wants a bound names it, and
    :func:`crosstab_long` has no width at all."""
    vals = [r[0] for r in df.filter(q(b).isNotNull()).select(q(b).cast("string")).distinct().orderBy(1).collect()]
    if max_columns is not None and len(vals) > max_columns:
        raise ValueError(f"{b!r} has more than {max_columns} values")
    x = df.filter(q(a).isNotNull() & q(b).isNotNull()).select(q(a), q(b).cast("string").alias("_b"))
    return x.groupBy(a).pivot("_b", vals).count().na.fill(0)


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, count) of the pairs that occur, for columns of any number of values."""
    x = df.filter(q(a).isNotNull() & q(b).isNotNull())
    return x.groupBy(q(a), q(b)).agg(F.count(F.lit(1)).alias("count"))


# ----------------------------------------------------------------------------- G12
def box_stats(df: DataFrame, num: str, by=None, whisker: float = 1.5, method: str = "exact") -> DataFrame:
    """Per group: n, q1, median, q3, whisker_low / whisker_high (most extreme points within
    1.5 IQR of the box) and the outlier count."""
    keys = keys_of(by)
    x = df.filter(q(num).isNotNull()).select(*[q(k) for k in keys], q(num).cast("double").alias("_x"))
    qs = exact_quantiles(x, "_x", [0.25, 0.5, 0.75], by=keys, method=method)
    if keys:
        qs = written(qs, "boxes")  # counted, or few groups would be few tasks
    j = join_small(x, qs, keys, bound=qs.count()) if keys else attach_row(x, qs)
    iqr = F.col("q2") - F.col("q0")
    lo = F.col("q0") - whisker * iqr
    hi = F.col("q2") + whisker * iqr
    inside = (F.col("_x") >= lo) & (F.col("_x") <= hi)
    return j.groupBy(*keys).agg(
        F.first("n").cast("bigint").alias("n"), F.first("q0").alias("q1"), F.first("q1").alias("median"),
        F.first("q2").alias("q3"), F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).cast("bigint").alias("outliers"))


# ----------------------------------------------------------------------------- G13
def density_hist(df: DataFrame, num: str, by: str, bins: int = 10) -> DataFrame:
    """Histogram per group, each normalised on its own (density integrates to 1)."""
    return histogram(df, num, bins=bins, by=by, density=True)


# ----------------------------------------------------------------------------- G14
def standardize(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(x - mean) / population std; constant columns become 0."""
    num = numeric_columns(df, cols)
    row = df.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(num)],
                 *[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(num)]).first()
    exprs = []
    for c in df.columns:
        if c in num:
            i = num.index(c)
            m, s = row[f"m{i}"], row[f"s{i}"]
            if s is None or s == 0:
                exprs.append(F.when(q(c).isNotNull(), F.lit(0.0)).alias(c))
            else:
                exprs.append(((q(c) - F.lit(m)) / F.lit(s)).alias(c))
        else:
            exprs.append(q(c))
    return df.select(*exprs)


# ----------------------------------------------------------------------------- G15-G17
def _fit_pca(x: DataFrame, cols: Sequence[str], k: int):
    from pyspark.ml.feature import PCA, VectorAssembler

    vec = VectorAssembler(inputCols=list(cols), outputCol="_vec", handleInvalid="skip").transform(x)
    model = PCA(k=k, inputCol="_vec", outputCol="_pc").fit(vec)
    return model, vec


def pca(df: DataFrame, num: Sequence[str], k: int = 2, keep: Sequence[str] = ()):
    """PCA on standardised numerics (population std). Returns (row coordinates, model);
    the covariance (Gram) matrix is computed distributed, d x d on the driver."""
    from pyspark.ml.functions import vector_to_array

    z = standardize(df.select(*[q(c) for c in [*keep, *num]]), num)
    model, vec = _fit_pca(z, num, k)
    coords = model.transform(vec).select(*[q(c) for c in keep], vector_to_array("_pc").alias("coords"))
    return coords, model


def famd(df: DataFrame, num: Sequence[str], cat: Sequence[str], k: int = 2, keep: Sequence[str] = (),
         max_categories: int | None = None):
    """Factor analysis of mixed data: standardised numerics plus category indicators
    scaled by 1/sqrt(share) and centred, then PCA. Returns (row coordinates, model)."""
    from pyspark.ml.functions import vector_to_array

    from kiln.operators.encode import categories

    z = standardize(df, num)
    cats = categories(df, list(cat), max_categories)
    ind = {f"{c}={v}": F.when(q(c) == F.lit(v), 1.0).otherwise(0.0) for c in cat for v in cats[c]}
    shares = df.agg(*[F.avg(e).alias(f"s{i}") for i, e in enumerate(ind.values())]).first()
    cols = [q(c) for c in keep] + [q(c) for c in num]
    names = list(num)
    for i, (name, e) in enumerate(ind.items()):
        p = shares[f"s{i}"] or 0.0
        if p > 0:
            cols.append(((e - F.lit(p)) / F.lit(p ** 0.5)).alias(f"_i{i}"))
            names.append(f"_i{i}")
    x = z.select(*cols)
    model, vec = _fit_pca(x, names, k)
    coords = model.transform(vec).select(*[q(c) for c in keep], vector_to_array("_pc").alias("coords"))
    return coords, model


def explained(model, names: Sequence[str] | None = None):
    """(component, variance_ratio, cumulative) from a fitted PCA model or wide factor axes."""
    from pyspark.sql import SparkSession

    shares = model.explainedVariance
    ev = [float(v) for v in (shares.toArray() if hasattr(shares, "toArray") else shares)]
    rows, cum = [], 0.0
    for i, v in enumerate(ev):
        cum += v
        rows.append((i + 1, v, cum))
    return SparkSession.getActiveSession().createDataFrame(rows, "component int, variance_ratio double, cumulative double")
