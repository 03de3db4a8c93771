"""Training, scoring and forecasting (M1-M7, M13-M15) on Spark ML.

Classifiers and the boosted-tree forecaster are Spark ML estimators wrapped with their
feature assembly in a ``PipelineModel`` so that scoring takes the raw table. The
autoregressive model is fitted by conditional least squares on mergeable triangular factors
(``operators.factors``): every task reduces its rows of each series, and only factors of a few
numbers meet.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       OneVsRest)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.exprs import q
from kiln.operators import tree_cells
from kiln.operators.boosting import BoostedTrees, fit_boosted
from kiln.operators.perceptron import Perceptron, fit_perceptron
from kiln.operators.factors import Factor, Model, least_squares, partial_factors, solve_factors
from kiln.operators.order import add_lag_columns, assign_row_id, attach_row, join_small, keys_of

FEATURES = "features"


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="keep")


def _label(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("_label", q(label).cast("double"))


#: Rows of a boosting task. It reads them from several cached layers, so that bytes are a multiple.
TREE_TASK_ROWS = 500_000


def _spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns, dealt to tasks of at most about ``TREE_TASK_ROWS`` rows where there are more."""
    n, x = df.count(), df.select(*[q(c) for c in columns])
    return x if n <= TREE_TASK_ROWS else x.repartition(max(-(-n // TREE_TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism))


def _fit(features: Sequence[str], estimator, df: DataFrame, spread: bool = False) -> PipelineModel:
    """Assemble once, persist the (features, label) columns for the iterative solver,
    fit, and wrap assembler + model so scoring takes the raw table."""
    from pyspark import StorageLevel

    asm = _assembler(features)
    if spread:
        df = _spread(df, [*dict.fromkeys(features), "_label", *(["_val"] if "_val" in df.columns else [])])
    keep = [FEATURES, "_label", *(["_val"] if "_val" in df.columns else [])]
    data = asm.transform(df).select(*keep).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = estimator.fit(data)
    finally:
        data.unpersist()
    return PipelineModel(stages=[asm, fitted])


def _fit_cells(features: Sequence[str], estimator: OneVsRest, df: DataFrame, n: int, k: int, seed: int) -> PipelineModel | None:
    """The fit of boosted trees on the counted cells of the rows; None where these may not be far fewer."""
    rows, share = tree_cells.drawn(df, features, n, seed)
    cuts = [tree_cells.split_points(rows[:, i], n, share, min(tree_cells.BINS, n)) for i in range(len(features))]
    if tree_cells.most_cells(cuts, k) > n * tree_cells.CELL_SHARE:
        return None
    cells = tree_cells.counted(df, features, "_label", cuts, FEATURES)
    try:
        estimator.setClassifier(estimator.getClassifier().copy().setMaxBins(tree_cells.bins_for(cells.n)))
        fitted = estimator.setWeightCol(tree_cells.WEIGHT).fit(cells.table)
    finally:
        cells.table.unpersist()
    coder = tree_cells.bucketizer(features, cells.cuts, [f"_bin_{c}" for c in features])
    asm = VectorAssembler(inputCols=coder.getOutputCols(), outputCol=FEATURES, handleInvalid="keep")
    return PipelineModel(stages=[coder, asm, fitted])


def _n_classes(df: DataFrame, label: str) -> int:
    return _seen(df, label)[0]


def _seen(df: DataFrame, label: str, *counts) -> tuple[int, ...]:
    """The number of classes, and how many rows meet each condition of ``counts``, in one job."""
    row = df.agg(F.max(q(label)).alias("m"), F.count_distinct(q(label)).alias("k"),
                 *[F.count(F.when(c, 1)).alias(f"n{i}") for i, c in enumerate(counts)]).first()
    return max(int(row["m"] or 0) + 1, int(row["k"] or 0), 2), *row[2:]


# ----------------------------------------------------------------------------- M1
# The penalties each solver name accepts.
SOLVER_PENALTIES = {"lbfgs": ("l2", None), "newton-cg": ("l2", None), "newton-cholesky": ("l2", None), "sag": ("l2", None),
                    "liblinear": ("l1", "l2"), "saga": ("l1", "l2", "elasticnet", None)}


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, C: float = 1.0, max_iter: int = 100,
                 tol: float = 1e-6, penalty: str | None = "l2", solver: str = "lbfgs", l1_ratio: float = 0.5) -> PipelineModel:
    """Logistic regression with the usual ``C``: regParam = 1 / (C * n), no standardisation (so
    the penalty is on the raw coefficients). ``penalty``: l2, l1, elasticnet (with
    ``l1_ratio``) or None. ``solver`` names are checked against the penalty they accept;
    Spark picks its own optimiser for each."""
    if C <= 0:
        raise ValueError("C must be positive")
    penalty = None if penalty in (None, "none") else penalty
    if penalty not in SOLVER_PENALTIES.get(solver, ()):
        raise ValueError(f"solver {solver!r} with penalty {penalty!r} is not available")
    mix = {"l1": 1.0, "elasticnet": float(l1_ratio)}.get(penalty, 0.0)
    reg = 0.0 if penalty is None else 1.0 / (C * max(df.count(), 1))
    lr = LogisticRegression(featuresCol=FEATURES, labelCol="_label", regParam=reg, elasticNetParam=mix,
                            standardization=False, maxIter=max_iter, tol=tol)
    return _fit(features, lr, _label(df, label))


# ----------------------------------------------------------------------------- M2
def parse_hidden(hidden) -> list[int]:
    if isinstance(hidden, int):
        return [hidden]
    if isinstance(hidden, str):
        return [int(x) for x in hidden.replace(" ", "").split(",") if x]
    return [int(x) for x in hidden]


def fit_mlp(df: DataFrame, features: Sequence[str], label: str, hidden=(100,), max_iter: int = 200,
            step_size: float | None = None, seed: int = 42, activation: str = "logistic", solver: str = "l-bfgs",
            **training) -> PipelineModel | Perceptron:
    """Multilayer perceptron: layers [d, *hidden, k]. Adam and SGD train any activation by
    minibatches (``operators.perceptron``, which takes ``training``); l-bfgs and gd are Spark's, with
    sigmoid hidden units."""
    if solver in ("adam", "sgd"):
        return fit_perceptron(df, features, label, parse_hidden(hidden), "logistic" if activation == "sigmoid" else activation, solver,
                              int(max_iter), 0.001 if step_size is None else step_size, seed=seed, **training)
    if activation not in ("logistic", "sigmoid"):
        raise ValueError(f"activation {activation!r} not available with solver {solver!r} (adam or sgd)")
    if solver not in ("l-bfgs", "lbfgs", "gd") or training:
        raise ValueError(f"solver {solver!r} not available (adam, sgd, l-bfgs or gd)" if not training else f"{sorted(training)} belong to adam and sgd")
    k = _n_classes(df, label)
    layers = [len(features), *parse_hidden(hidden), k]
    mlp = MultilayerPerceptronClassifier(featuresCol=FEATURES, labelCol="_label", layers=layers, maxIter=max_iter,
                                         stepSize=0.03 if step_size is None else step_size, seed=seed, solver="gd" if solver == "gd" else "l-bfgs")
    return _fit(features, mlp, _label(df, label))


# ----------------------------------------------------------------------------- M3 / M4
def _feature_subset(colsample: float) -> str:
    return "all" if colsample >= 1.0 else str(float(colsample))


def fit_gbt_classifier(df: DataFrame, features: Sequence[str], label: str, learning_rate: float = 0.1,
                       n_trees: int = 100, max_depth: int = 3, subsample: float = 1.0, colsample: float = 1.0,
                       validation_col: str | None = None, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees; early stopping on ``validation_col`` rows when given;
    more than two classes go through one-vs-rest. Large tables of more than two classes are
    trained on their counted cells (``operators.tree_cells``) where all rows and features take part in every tree."""
    params = dict(featuresCol=FEATURES, labelCol="_label", stepSize=learning_rate, maxIter=n_trees,
                  maxDepth=max_depth, subsamplingRate=subsample, featureSubsetStrategy=_feature_subset(colsample),
                  seed=seed)
    if validation_col:
        params["validationIndicatorCol"] = "_val"
    gbt = GBTClassifier(**params)
    features = list(features)
    whole = not validation_col and subsample >= 1.0 and colsample >= 1.0 and tree_cells.countable(df, features)
    k, n, flaws = _seen(df, label, F.lit(True), tree_cells.flawed(features)) if whole else (_n_classes(df, label), 0, 0)
    est = gbt if k <= 2 else OneVsRest(classifier=gbt, featuresCol=FEATURES, labelCol="_label")
    if k > 2 and n > tree_cells.CELL_ROWS and not flaws:
        fitted = _fit_cells(features, est, _label(df, label), n, k, seed)
        if fitted is not None:
            return fitted
    return _fit(features, est, _label(df, label).withColumn("_val", q(validation_col)) if validation_col
                else _label(df, label), spread=True)


def fit_gbt_forecaster(df: DataFrame, features: Sequence[str], label: str, learning_rate: float = 0.1,
                       n_trees: int = 100, max_depth: int = 3, subsample: float = 1.0, colsample: float = 1.0,
                       validation_col: str | None = None, seed: int = 42) -> PipelineModel:
    params = dict(featuresCol=FEATURES, labelCol="_label", stepSize=learning_rate, maxIter=n_trees,
                  maxDepth=max_depth, subsamplingRate=subsample, featureSubsetStrategy=_feature_subset(colsample),
                  seed=seed)
    if validation_col:
        params["validationIndicatorCol"] = "_val"
    x = _label(df, label)
    if validation_col:
        x = x.withColumn("_val", q(validation_col))
    return _fit(features, GBTRegressor(**params), x, spread=True)


# ----------------------------------------------------------------------------- M5
def feature_importance(model: PipelineModel, names: Sequence[str], top: int = 20):
    """(feature, importance) sorted descending, first ``top``; from the tree stage, or the gains of
    boosted trees."""
    if isinstance(model, BoostedTrees):
        vals = model.importances()
    else:
        imp = getattr(model.stages[-1], "featureImportances", None)
        if imp is None:
            raise ValueError("model has no feature importances")
        vals = imp.toArray().tolist()
    rows = sorted(zip(names, vals), key=lambda t: (-t[1], t[0]))[:top]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


# ----------------------------------------------------------------------------- M13 / M14
def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Batch scoring: ``prediction`` plus ``probability`` as an array (classifiers)."""
    cols = [q(c) for c in (keep if keep is not None else df.columns)]
    by_region = tree_cells.predicted(model, df, cols) if isinstance(model, PipelineModel) else None
    if by_region is not None:
        return by_region
    out = model.transform(df)
    extra = [F.col("prediction").cast("double").alias("prediction")]
    if isinstance(model, (BoostedTrees, Perceptron)):
        extra.append(F.col("probability"))
    elif "probability" in out.columns:
        extra.append(vector_to_array("probability").alias("probability"))
    return out.select(*cols, *extra)


def save_model(model: PipelineModel | BoostedTrees | Perceptron, path: str) -> None:
    if isinstance(model, (BoostedTrees, Perceptron)):
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(type(model).__name__, model.to_json())], "kind string, model string").coalesce(1).write.mode("overwrite").json(path)
        return
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | BoostedTrees | Perceptron:
    spark = SparkSession.getActiveSession()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path, "metadata")  # Spark ML's own layout
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return PipelineModel.load(path)
    row = spark.read.schema("kind string, model string").json(path).first()
    return {c.__name__: c for c in (BoostedTrees, Perceptron)}[row["kind"]].from_json(row["model"])


# ----------------------------------------------------------------------------- M15
def forecast_naive(df: DataFrame, target: str, lag_col: str | None = None, season: int | None = None,
                   order_cols: Sequence[str] | None = None, key=None, out: str = "forecast",
                   block: int | None = None) -> DataFrame:
    """Last value (or the value one season back) as the forecast."""
    if lag_col:
        return df.withColumn(out, q(lag_col).cast("double"))
    keys = keys_of(key)
    x = assign_row_id(df, list(order_cols), key=keys, row_id="_nrid")
    x = add_lag_columns(x, keys, "_nrid", [(out, target, season or 1)], block=block)
    return x.select(*df.columns, q(out).cast("double").alias(out))


# ----------------------------------------------------------------------------- M6
def forecast_recursive(model: PipelineModel, last_rows: DataFrame, target: str, n_lags: int, h: int,
                       key=None, step_col: str = "step") -> DataFrame:
    """Recursive multi-step forecast over one row per series: predict, write the
    prediction into ``{target}_lag_1``, shift the longer lags, repeat ``h`` times. Other
    features stay frozen. Work grows with the number of series, not rows."""
    keys = keys_of(key)
    lag = [f"{target}_lag_{i}" for i in range(1, n_lags + 1)]
    cur, done = last_rows, []
    for step in range(1, h + 1):
        # one chain of h projections: the forecasts so far ride along as columns of the same row
        shifted = {lag[0]: F.col("prediction").cast("double")} | {lag[i]: F.col(lag[i - 1]) for i in range(1, n_lags)}
        pred = model.transform(cur)
        cur = pred.select(*[shifted[c].alias(c) if c in shifted else q(c) for c in last_rows.columns], *done,
                          F.col("prediction").cast("double").alias(f"_step_{step}"))
        done.append(f"_step_{step}")
    rows = F.array(*[F.struct(F.lit(i + 1).alias(step_col), F.col(c).alias("forecast")) for i, c in enumerate(done)])
    return cur.select(*[q(k) for k in keys], F.explode(rows).alias("_r")).select(*[q(k) for k in keys], "_r.*")


# ----------------------------------------------------------------------------- M7 / X17
def difference_weights(d: int = 0, D: int = 0, s: int = 0) -> dict[int, float]:
    """Weights by lag of ``(1 - B)^d (1 - B^s)^D``; lag 0 has weight 1."""
    if (D and s < 2) or min(d, D, s) < 0:
        raise ValueError("seasonal differences need a season of 2 or more")
    w = np.array([1.0])
    for _ in range(d):
        w = np.convolve(w, [1.0, -1.0])
    for _ in range(D):
        w = np.convolve(w, [1.0, *[0.0] * (s - 1), -1.0])
    return {k: float(v) for k, v in enumerate(w) if v}


def ar_lags(p: int, P: int = 0, s: int = 0) -> dict[str, int]:
    """Names and lags of the autoregressive terms; seasonal ones are ``sar_i`` at lag i*s."""
    if P and s < 2:
        raise ValueError("seasonal lags need a season of 2 or more")
    return {**{f"ar_{i}": i for i in range(1, p + 1)}, **{f"sar_{i}": i * s for i in range(1, P + 1) if i * s > p}}


def reach_of(p: int, d: int, P: int, D: int, s: int) -> int:
    """Rows before t that a model of this order looks at."""
    return d + D * s + max([0, *ar_lags(p, P, s).values()])


def with_lag_table(df: DataFrame, columns: dict[str, int], order_cols, keys, row_id: str | None, block) -> DataFrame:
    """(keys, _rid, name@0..name@k): each column with its lags, from one halo-block window."""
    x, rid = df, row_id
    if rid is None:
        x = assign_row_id(df, list(order_cols), key=keys, row_id="_rid")
        rid = "_rid"
    x = x.select(*[q(k) for k in keys], F.col(rid).alias("_rid"), *[q(c).cast("double").alias(f"{c}@0") for c in columns])
    specs = [(f"{c}@{k}", f"{c}@0", k) for c, most in columns.items() for k in range(1, most + 1)]
    return add_lag_columns(x, keys, "_rid", specs, block=block) if specs else x


class Design:
    """The columns (name, lag) that models need, and the models over them."""

    def __init__(self):
        self.columns: list[tuple[str, int]] = []

    def _at(self, name: str, lag: int = 0) -> int:
        if (name, lag) not in self.columns:
            self.columns.append((name, lag))
        return self.columns.index((name, lag)) + 1

    def form(self, name: str, weights: dict[int, float], shift: int = 0) -> dict[int, float]:
        """The differenced column ``shift`` rows back."""
        return {self._at(name, shift + lag): w for lag, w in weights.items()}

    def model(self, target: str, p: int, d: int, exog: Sequence[str], trend: str | None, P: int, D: int, s: int, start: int = 0) -> Model:
        """``start``: the row at which the trend counts 0."""
        w = difference_weights(d, D, s)
        form = lambda name, shift=0: self.form(name, w, shift)
        terms: list[tuple[str, dict[int, float]]] = []
        if trend in ("c", "ct"):
            terms.append(("const", {0: 1.0}))
        if trend in ("t", "ct"):
            terms.append(("trend", {self._at("_rid"): 1.0, 0: -float(start)} if start else {self._at("_rid"): 1.0}))
        terms += [(name, form(target, lag)) for name, lag in ar_lags(p, P, s).items()]
        terms += [(f"exog_{e}", form(e)) for e in exog]
        return Model([n for n, _ in terms], [t for _, t in terms], form(target))

    def expressions(self) -> list:
        return [F.col("_rid") if name == "_rid" else F.col(f"`{name}@{lag}`") for name, lag in self.columns]


FIT_FIELDS = ("coef_names array<string>, coef array<double>, n bigint, rss double, sigma2 double, aic double, bic double, "
              "p int, d int, sp int, sd int, season int")


def fit_row(factor: Factor, m: Model, order: dict) -> dict:
    """A row of ``FIT_FIELDS``; AIC / BIC from the residual sum. Too few rows give NULLs."""
    n, k = factor.n, len(m.names)
    out = {"coef_names": m.names, "coef": None, "n": n, "rss": None, "sigma2": None, "aic": None, "bic": None,
           "p": order["p"], "d": order["d"], "sp": order["P"], "sd": order["D"], "season": order["s"]}
    if n >= max(k, 1):
        fit = least_squares(factor, m)
        out |= {"coef": fit.coef, "rss": fit.rss, "sigma2": fit.rss / n,
                "aic": float(n * np.log(fit.rss / n) + 2 * (k + 1)), "bic": float(n * np.log(fit.rss / n) + (k + 1) * np.log(n))}
    return out


def fit_ar(df: DataFrame, target: str, p: int = 1, d: int = 0, exog: Sequence[str] = (), trend: str | None = "c",
           order_cols: Sequence[str] | None = None, key=None, block: int | None = None,
           P: int = 0, D: int = 0, s: int = 0, ma: int = 0, Q: int = 0) -> DataFrame:
    """AR(p) on d-th (and D-th seasonal) differences with seasonal lags, trend and exogenous
    regressors by conditional least squares. One row per series: coefficient names and values,
    sigma2, rss, n, aic, bic (Gaussian log-likelihood from the residual sum, constants
    dropped); the order stands in p, d, sp, sd (seasonal lags and differences) and season.
    With moving-average terms (``ma``, seasonal ``Q``) the fit is ``arma.fit_arma``."""
    if ma or Q:
        from kiln.operators.arma import fit_arma

        return fit_arma(df, target, p, d, ma, exog, trend, order_cols, key, P, D, Q, s)
    keys = keys_of(key)
    order = dict(p=p, d=d, P=P, D=D, s=s)
    x = with_lag_table(df, {target: reach_of(**order), **{e: d + D * s for e in exog}}, order_cols, keys, None, block)
    design = Design()
    m = design.model(target, exog=exog, trend=trend, **order)
    return solve_factors(partial_factors(x, keys, design.expressions()), keys, FIT_FIELDS, lambda _, factor: [fit_row(factor, m, order)])


def fit_ar_grid(df: DataFrame, target: str, grid: Sequence[dict], order_cols: Sequence[str], key=None,
                block: int | None = None, exog: Sequence[str] = ()) -> DataFrame:
    """Every candidate (p, d, trend, P, D, s) of every series from one pass: one lag table, one
    factor that serves all candidates, over the rows that all of them can use
    (differencing has a unit Jacobian, so on equal rows their AIC compare). Adds ``candidate``.
    Candidates with moving-average terms (q, Q) are fitted one by one from the same first row on."""
    keys = keys_of(key)
    design, orders = Design(), [{c: int(g.get(c) or 0) for c in ("p", "d", "P", "D", "s")} for g in grid]
    reach = max(reach_of(**o) for o in orders)
    moving = {i: {"q": int(g.get("q") or 0), "Q": int(g.get("Q") or 0)} for i, g in enumerate(grid) if g.get("q") or g.get("Q")}
    models = {i: design.model(target, exog=exog, trend=g.get("trend"), **orders[i]) for i, g in enumerate(grid) if i not in moving}
    fits = [_plain_grid(df, target, models, orders, design, reach, exog, order_cols, keys, block)] if models else []
    for i, ma in moving.items():
        from kiln.operators.arma import fit_arma

        fit = fit_arma(df, target, exog=exog, trend=grid[i].get("trend"), order_cols=order_cols, key=keys, skip=reach, **orders[i], **ma)
        fits.append(fit.drop("resid").withColumn("candidate", F.lit(i)))
    out = fits[0]
    for more in fits[1:]:
        out = out.unionByName(more)
    return out


def _plain_grid(df: DataFrame, target: str, models: dict[int, Model], orders: list[dict], design: Design, reach: int, exog, order_cols, keys,
                block) -> DataFrame:
    x = with_lag_table(df, {target: reach, **{e: max(o["d"] + o["D"] * o["s"] for o in orders) for e in exog}}, order_cols, keys, None, block)
    needed = [F.col(f"`{target}@{k}`") for k in range(reach + 1)]
    return solve_factors(partial_factors(x, keys, design.expressions(), needed), keys, FIT_FIELDS + ", candidate int",
                         lambda _, factor: [fit_row(factor, m, orders[i]) | {"candidate": i} for i, m in models.items()])


def forecast_ar(fit: DataFrame, history: DataFrame, target: str, steps: int, order_cols: Sequence[str],
                key=None, future: DataFrame | None = None) -> DataFrame:
    """Recursive forecast ``steps`` ahead in levels. The trend goes on counting rows; residuals
    after the fitted rows count as 0 (``history`` has to end where they do if there are
    moving-average terms); a model with exogenous regressors needs their future levels in ``future`` (keys, step 1..steps, the
    columns), else it is an error. Uses only the last rows of every series (top-k per key,
    limited before the shuffle); one small row per series is solved in Python."""
    keys = keys_of(key)
    shape = fit.agg(F.max(F.col("p") + F.col("d") + (F.col("sp") + F.col("sd")) * F.col("season")).alias("m"),
                    F.array_distinct(F.flatten(F.collect_set("coef_names"))).alias("names")).first()
    need = int(shape["m"] or 0)
    exog = sorted(n[5:] for n in (shape["names"] or []) if n.startswith("exog_"))
    if exog and future is None:
        raise ValueError(f"the model needs future values of {exog}")
    w = Window.partitionBy(*[q(k) for k in keys] or [F.lit(0)]).orderBy(*[q(c).desc() for c in order_cols])
    tail = history.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= need + 1)
    past = F.struct((-F.col("_r")).alias("o"), q(target).cast("double").alias("y"), F.array(*[q(e).cast("double") for e in exog]).cast("array<double>").alias("x"))
    grouped = tail.groupBy(*keys).agg(F.sort_array(F.collect_list(past)).alias("_h"))  # need + 1 rows each
    counts = history.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    grouped = join_small(grouped, counts, keys) if keys else attach_row(grouped, counts)
    return project_ar(fit, grouped, steps, keys, exog, future)


def project_ar(fit: DataFrame, grouped: DataFrame, steps: int, keys: Sequence[str], exog: Sequence[str] = (),
               future: DataFrame | None = None, known: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Forecasts from (keys, _h: the last levels in order, _rows: how many rows there were). Future
    levels of regressors are in ``future``, or (``known``) in a column _f: array<struct(step, x)>,
    which may end early; the columns ``keep`` stay beside every step."""
    resid = F.col("resid") if "resid" in fit.columns else F.lit(None).cast("array<double>")
    meta = fit.select(*keys, "coef_names", "coef", "p", "d", "sp", "sd", "season", resid.alias("resid"))
    j = join_small(grouped, meta, keys) if keys else attach_row(grouped, meta)
    if known:
        pass
    elif exog:
        ahead = F.struct(F.col("step"), F.array(*[q(e).cast("double") for e in exog]).alias("x"))
        given = future.filter(F.col("step").between(1, steps)).groupBy(*keys).agg(F.sort_array(F.collect_list(ahead)).alias("_f"))
        if keys:
            j = join_small(j, given, keys, how="left")
        else:  # one row on either side
            j = j.withColumn("_one", F.lit(1)).join(given.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    else:
        j = j.withColumn("_f", F.lit(None).cast("array<struct<step:int,x:array<double>>>"))
    j = j.withColumn("_ahead", _ahead_udf(list(exog), steps, known)(F.struct("_h", "_rows", "_f", "coef_names", "coef", "p", "d", "sp", "sd", "season", "resid")))
    return j.select(*[q(k) for k in keys], *keep, F.posexplode("_ahead").alias("_step", "forecast")).select(
        *[q(k) for k in keys], (F.col("_step") + 1).alias("step"), *keep, "forecast")


def _ahead_udf(exog: list[str], steps: int, known: bool):
    """Forecasts of a batch of series as array<double>, one small row each."""
    @F.pandas_udf("array<double>")
    def ahead(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([_ahead(r, exog, steps, known) for r in rows.to_dict("records")])

    return ahead


def _ahead(r: dict, exog: Sequence[str], steps: int, known: bool = False) -> list[float | None]:
    """The forecasts of one series from its last levels, its coefficients and future levels. With
    ``known``, they end where the given levels do."""
    if r["coef"] is None:
        return [None] * steps
    names, coef = list(r["coef_names"]), np.asarray(r["coef"], dtype=float)
    w = difference_weights(int(r["d"]), int(r["sd"]), int(r["season"]))
    lags = ar_lags(int(r["p"]), int(r["sp"]), int(r["season"]))
    y = [h["y"] for h in r["_h"]]
    x = [list(h["x"]) for h in r["_h"]]
    given = {f["step"]: list(f["x"]) for f in (r["_f"] if r["_f"] is not None else ())}

    def changed(levels, back):
        """The differenced value ``back`` steps before the end of ``levels``."""
        at = len(levels) - 1 - back
        return sum(v * levels[at - k] for k, v in w.items()) if at >= max(w) else float("nan")

    out: list[float | None] = []
    for step in range(1, steps + 1):
        if exog:
            if step not in given and known:
                return out + [None] * (steps - len(out))
            if step not in given:
                raise ValueError(f"no future values for step {step}")
            x.append(given[step])
        value = 0.0
        for name, c in zip(names, coef):
            if name == "const":
                value += c
            elif name == "trend":
                value += c * (int(r["_rows"]) + step - 1)
            elif name in lags:
                value += c * changed(y, lags[name] - 1)
            elif name.startswith(("ma_", "sma_")):
                lag = int(name.split("_")[1]) * (int(r["season"]) if name[0] == "s" else 1)
                value += c * float(r["resid"][lag - step]) if lag >= step else 0.0
            else:
                e = exog.index(name[5:])
                value += c * changed([v[e] for v in x], 0)
        value -= sum(v * y[len(y) - k] for k, v in w.items() if k) if len(y) >= max(w) else float("nan")
        y.append(value)
        out.append(None if np.isnan(value) else float(value))
    return out
