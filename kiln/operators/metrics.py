"""Classification and forecast metrics, residual data and histograms.

Every metric is one aggregate (optionally grouped by ``by``). Rank-based metrics (AUC,
ROC) group rows by distinct score first and take cumulative counts over the distinct
scores with the blocked prefix sum, so no global row window is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import q
from kiln.operators.order import add_lag_columns, assign_row_id, attach_row, join_small, keys_of, running_sum


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


# ----------------------------------------------------------------------------- X1
def binary_metrics(df: DataFrame, y: str, yhat: str, positive=1, by=None) -> DataFrame:
    """accuracy, precision, recall, f1 (0 where undefined) and n."""
    keys = keys_of(by)
    pos_t = q(y) == F.lit(positive)
    pos_p = q(yhat) == F.lit(positive)
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(q(y) == q(yhat)).alias("_ok"),
        F.count_if(pos_t & pos_p).alias("_tp"),
        F.count_if(~pos_t & pos_p).alias("_fp"),
        F.count_if(pos_t & ~pos_p).alias("_fn"),
    )
    prec = _safe_div(F.col("_tp"), F.col("_tp") + F.col("_fp"))
    rec = _safe_div(F.col("_tp"), F.col("_tp") + F.col("_fn"))
    f1 = _safe_div(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn"))
    return agg.select(*keys, F.col("n"), _safe_div(F.col("_ok"), F.col("n")).alias("accuracy"),
                      prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


# ----------------------------------------------------------------------------- X5
def _class_counts(df: DataFrame, y: str, yhat: str, keys) -> DataFrame:
    return df.groupBy(*keys, q(y).cast("string").alias("actual"), q(yhat).cast("string").alias("predicted")) \
             .agg(F.count(F.lit(1)).alias("count"))


def confusion(df: DataFrame, y: str, yhat: str, by=None) -> DataFrame:
    """(actual, predicted, count) over every pair of classes seen in y or yhat, zero
    cells included (classes as text)."""
    keys = keys_of(by)
    cells = _class_counts(df, y, yhat, keys)
    classes = cells.select(*keys, F.explode(F.array("actual", "predicted")).alias("c")) \
                   .groupBy(*keys).agg(F.array_sort(F.collect_set("c")).alias("_cls"))
    grid = classes.select(*keys, F.explode("_cls").alias("actual"), F.col("_cls")) \
                  .select(*keys, "actual", F.explode("_cls").alias("predicted"))
    out = join_small(grid, cells, [*keys, "actual", "predicted"], how="left")
    return out.select(*keys, "actual", "predicted", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


# ----------------------------------------------------------------------------- X2
def macro_metrics(df: DataFrame, y: str, yhat: str, by=None) -> DataFrame:
    """Macro precision / recall / F1 over the classes in y and yhat, plus accuracy."""
    keys = keys_of(by)
    cells = _class_counts(df, y, yhat, keys)
    per = cells.select(*keys, F.explode(F.array(
        F.struct(F.col("actual").alias("cls"), F.col("count").alias("act"), F.lit(0).cast("bigint").alias("pred"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0).cast("bigint").alias("tp")),
        F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("bigint").alias("act"), F.col("count").alias("pred"),
                 F.lit(0).cast("bigint").alias("tp")))).alias("x")).select(*keys, "x.*")
    cls = per.groupBy(*keys, "cls").agg(F.sum("act").alias("act"), F.sum("pred").alias("pred"), F.sum("tp").alias("tp"))
    p = _safe_div(F.col("tp"), F.col("pred"))
    r = _safe_div(F.col("tp"), F.col("act"))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return cls.groupBy(*keys).agg(
        F.sum("act").alias("n"),
        (F.sum("tp") / F.sum("act")).alias("accuracy"),
        F.avg(p).alias("precision_macro"), F.avg(r).alias("recall_macro"), F.avg(f).alias("f1_macro"),
        F.count(F.lit(1)).alias("n_classes"))


# ----------------------------------------------------------------------------- X3 / X6
def _score_table(df: DataFrame, y: str, score: str, positive, keys) -> DataFrame:
    """(keys, score, pos, neg) per distinct score."""
    ispos = q(y) == F.lit(positive)
    return df.filter(q(score).isNotNull() & q(y).isNotNull()).groupBy(*keys, q(score).cast("double").alias("s")).agg(
        F.count_if(ispos).alias("pos"), F.count_if(~ispos).alias("neg"))


def roc_auc(df: DataFrame, y: str, score: str, positive=1, by=None) -> DataFrame:
    """Mann-Whitney AUC with ties counted one half; NULL when a class is absent."""
    keys = keys_of(by)
    t = _score_table(df, y, score, positive, keys)
    return _auc_from_scores(t, keys)


def _auc_from_scores(t: DataFrame, keys) -> DataFrame:
    t = assign_row_id(t, ["s"], key=keys, row_id="_r")
    t = running_sum(t, keys, "_r", "neg", "_negc")
    below = F.col("_negc") - F.col("neg")
    agg = t.groupBy(*keys).agg(F.sum(F.col("pos") * (below + F.col("neg") * 0.5)).alias("_u"),
                               F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    auc = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n")))
    return agg.select(*keys, auc.alias("auc"))


def roc_curve(df: DataFrame, y: str, score: str, positive=1, by=None, drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr): the origin at +inf, then one point per distinct score in
    descending order. ``drop_intermediate`` leaves out points that lie evenly between their
    neighbours, as the usual library default does; the first and the last point stay."""
    keys = keys_of(by)
    t = _score_table(df, y, score, positive, keys).withColumn("_ns", -F.col("s"))
    t = assign_row_id(t, ["_ns"], key=keys, row_id="_r")
    t = running_sum(t, keys, "_r", "pos", "_tp")
    t = running_sum(t, keys, "_r", "neg", "_fp")
    if drop_intermediate:
        near = [(f"{c}{k}", c, d) for c in ("_tp", "_fp") for k, d in (("b", 1), ("a", -1))]
        t = add_lag_columns(t, keys, "_r", near)
        bend = lambda c: F.col(f"{c}a") - 2 * F.col(c) + F.col(f"{c}b") != 0
        edge = F.col("_tpb").isNull() | F.col("_tpa").isNull()
        t = t.withColumn("_keep", edge | bend("_tp") | bend("_fp"))
    else:
        t = t.withColumn("_keep", F.lit(True))
    tot = t.groupBy(*keys).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    t = join_small(t, tot, keys) if keys else attach_row(t, tot)
    pts = t.filter("_keep").select(*keys, F.col("s").alias("threshold"),
                   F.when(F.col("_N") > 0, F.col("_fp") / F.col("_N")).alias("fpr"),
                   F.when(F.col("_P") > 0, F.col("_tp") / F.col("_P")).alias("tpr"))
    origin = tot.select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                        F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


def roc_curves_ovr(df: DataFrame, y: str, prob_col: str, classes: Sequence, by=None, drop_intermediate: bool = True) -> DataFrame:
    """Multiclass ROC: one curve per class (that class against the rest, scored by its
    probability in ``prob_col``, an array in ``classes`` order), as (class, threshold, fpr,
    tpr). Rows are exploded once per class, then each curve is an ordinary ROC keyed by class."""
    keys = keys_of(by)
    recs = F.array(*[F.struct(F.lit(str(c)).alias("_class"), q(prob_col)[i].cast("double").alias("_s"),
                              (q(y) == F.lit(c)).cast("int").alias("_pos")) for i, c in enumerate(classes)])
    ex = df.select(*keys, F.explode(recs).alias("r")).select(*keys, "r.*")
    return roc_curve(ex, "_pos", "_s", positive=1, by=[*keys, "_class"], drop_intermediate=drop_intermediate).withColumnRenamed("_class", "class")


# ----------------------------------------------------------------------------- X4
def roc_auc_ovo(df: DataFrame, y: str, prob_col: str, classes: Sequence, by=None) -> DataFrame:
    """One-vs-one macro AUC: for each class pair (a, b), the rows of a or b; AUC of
    P(a) for a-vs-b and of P(b) for b-vs-a averaged; then the mean over pairs. ``prob_col``
    is an array of class probabilities in ``classes`` order. NULL when not computable."""
    keys = keys_of(by)
    k = len(classes)
    pairs = [(i, j) for i in range(k) for j in range(k) if i != j]  # ordered: (pos class, neg class)
    recs = []
    for i, j in pairs:
        a, b = classes[i], classes[j]
        recs.append(F.when(q(y).isin(a, b),
                           F.struct(F.lit(f"{min(i, j)}_{max(i, j)}").alias("pair"), F.lit(f"{i}>{j}").alias("dir"),
                                    q(prob_col)[i].cast("double").alias("s"), (q(y) == F.lit(a)).alias("ispos"))))
    ex = df.select(*keys, F.explode(F.filter(F.array(*recs), lambda x: x.isNotNull())).alias("r")).select(*keys, "r.*")
    t = ex.groupBy(*keys, "pair", "dir", "s").agg(F.count_if("ispos").alias("pos"), F.count_if(~F.col("ispos")).alias("neg"))
    aucs = _auc_from_scores(t, [*keys, "pair", "dir"])
    per_pair = aucs.groupBy(*keys, "pair").agg(F.avg("auc").alias("auc"), F.count("auc").alias("_c"))
    return per_pair.groupBy(*keys).agg(
        F.when(F.count_if(F.col("_c") < 2) == 0, F.avg("auc")).alias("auc_ovo"))


# ----------------------------------------------------------------------------- X7-X9
def regression_metrics(df: DataFrame, y: str, yhat: str, by=None, mape_eps: float | None = 1e-10,
                       empty_mape: float | None = None) -> DataFrame:
    """n, mse, rmse, mae and MAPE %. ``mape_eps`` = 1e-10 keeps rows with |y| > eps (X8);
    0 keeps y != 0 (X9). No row left -> ``empty_mape`` (NULL, or +inf for searches)."""
    keys = keys_of(by)
    err = q(y).cast("double") - q(yhat).cast("double")
    keep = (F.abs(q(y)) > F.lit(mape_eps)) if mape_eps else (q(y) != 0)
    ape = F.when(keep, F.abs(err / q(y)))
    valid = df.filter(q(y).isNotNull() & q(yhat).isNotNull())
    agg = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        (F.avg(ape) * 100).alias("_mape"))
    mape = F.col("_mape") if empty_mape is None else F.coalesce(F.col("_mape"), F.lit(float(empty_mape)))
    return agg.select(*keys, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", mape.alias("mape"))


# ----------------------------------------------------------------------------- X10
def key_horizons(H: int) -> list[tuple[str, int]]:
    """(name, 0-based index): h1, h{H//2}, h{H} for H >= 3; h1, h2 for H = 2; h1 for H = 1."""
    if H >= 3:
        return [("h1", 0), (f"h{H // 2}", H // 2 - 1), (f"h{H}", H - 1)]
    if H == 2:
        return [("h1", 0), ("h2", 1)]
    return [("h1", 0)]


def horizon_metrics(df: DataFrame, y_arr: str, yhat_arr: str, H: int, by=None) -> DataFrame:
    """Metrics over all steps and channels (``horizon = 'all'``) plus the key horizons.
    ``y_arr`` / ``yhat_arr`` are ``array<array<double>>`` [step][channel] (or flat
    ``array<double>`` [step])."""
    keys = keys_of(by)
    nested = df.schema[y_arr].dataType.elementType.typeName() == "array"
    z = df.select(*keys, F.posexplode(F.arrays_zip(q(y_arr).alias("t"), q(yhat_arr).alias("p"))).alias("step", "v"))
    if nested:
        z = z.select(*keys, "step", F.explode(F.arrays_zip(F.col("v.t").alias("t"), F.col("v.p").alias("p"))).alias("c"))
        z = z.select(*keys, "step", F.col("c.t").alias("t"), F.col("c.p").alias("p"))
    else:
        z = z.select(*keys, "step", F.col("v.t").alias("t"), F.col("v.p").alias("p"))
    names = key_horizons(H)
    tag = F.lit(None).cast("string")
    for name, idx in reversed(names):
        tag = F.when(F.col("step") == idx, F.lit(name)).otherwise(tag)
    z = z.withColumn("horizon", F.explode(F.array_compact(F.array(F.lit("all"), tag))))
    return regression_metrics(z, "t", "p", by=[*keys, "horizon"], mape_eps=0)


# ----------------------------------------------------------------------------- X11 / X12
def residuals(df: DataFrame, y: str, yhat: str, keep: Sequence[str] = ()) -> DataFrame:
    """Residual ``y - yhat`` beside the kept columns, the prediction and the actual."""
    return df.select(*[q(c) for c in keep], q(y).cast("double").alias("actual"),
                     q(yhat).cast("double").alias("predicted"),
                     (q(y).cast("double") - q(yhat).cast("double")).alias("residual"))


def histogram(df: DataFrame, col: str, bins: int = 30, by=None, density: bool = False) -> DataFrame:
    """Equal-width bins between min and max (last bin closed), every bin emitted:
    (bin, lo, hi, count[, density]). A constant group has width 0: all rows in bin 0, and no
    density (NULL)."""
    keys = keys_of(by)
    x = df.filter(q(col).isNotNull() & ~F.isnan(q(col).cast("double"))).select(*keys, q(col).cast("double").alias("_x"))
    st = x.groupBy(*keys).agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"), F.count(F.lit(1)).alias("_n"))
    w = (F.col("_mx") - F.col("_mn")) / F.lit(bins)
    j = join_small(x, st, keys) if keys else attach_row(x, st)
    b = F.when(F.col("_mx") == F.col("_mn"), F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(F.col("_x") - F.col("_mn"), w)), F.lit(bins - 1))).cast("int")
    counts = j.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = st.select(*keys, "_mn", "_mx", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = join_small(grid, counts, [*keys, "bin"], how="left")
    lo = F.col("_mn") + F.col("bin") * w
    hi = F.when(F.col("bin") == bins - 1, F.col("_mx")).otherwise(F.col("_mn") + (F.col("bin") + 1) * w)
    cols = [*keys, "bin", lo.alias("lo"), hi.alias("hi"), F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")]
    if density:
        cols.append(F.try_divide(F.coalesce(F.col("count"), F.lit(0)), F.col("_n") * w).alias("density"))
    return out.select(*cols)


# ----------------------------------------------------------------------------- X16
def forecast_frame(train: DataFrame, val: DataFrame, test: DataFrame, ts: str, y: str, yhat: str,
                   key=None, tail: int = 50) -> DataFrame:
    """Plot context: the last ``tail`` training rows (per key), all validation rows and
    the test rows with actual and forecast, as (keys, ts, part, actual, forecast)."""
    keys = keys_of(key)
    from pyspark.sql import Window

    w = Window.partitionBy(*[q(k) for k in keys] or [F.lit(0)]).orderBy(q(ts).desc())
    last = train.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= tail)
    parts = [
        last.select(*keys, q(ts), F.lit("train").alias("part"), q(y).cast("double").alias("actual"),
                    F.lit(None).cast("double").alias("forecast")),
        val.select(*keys, q(ts), F.lit("val").alias("part"), q(y).cast("double").alias("actual"),
                   F.lit(None).cast("double").alias("forecast")),
        test.select(*keys, q(ts), F.lit("test").alias("part"), q(y).cast("double").alias("actual"),
                    q(yhat).cast("double").alias("forecast")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
