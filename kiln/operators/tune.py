"""Parameter grids and draws, grid / random search, walk-forward validation.

Searches fan the candidate models out with Spark ML's ``fitMultiple`` (one pass over the
cached training data per candidate, several candidates in flight); selection is done on
validation metrics computed as DataFrame aggregates. Folds come from deterministic
hashes (classification) or row positions (time series), never from random splits.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.exprs import portable_hash, q
from kiln.operators import metrics
from kiln.operators.factors import partial_factors, solve_factors
from kiln.operators.model import FIT_FIELDS, Design, fit_ar_grid, fit_row, project_ar, reach_of, with_lag_table
from kiln.operators.order import assign_row_id, keys_of, written


# ----------------------------------------------------------------------------- M8
def param_grid(space: dict[str, Sequence]) -> list[dict]:
    """Cartesian product of the listed values (keys in the given order)."""
    names = list(space)
    return [dict(zip(names, combo)) for combo in itertools.product(*[list(space[n]) for n in names])]


def ar_grid(spec: dict) -> list[dict]:
    """Candidates of an autoregressive grid, from lists of p, d, q, P, D, Q, s and trend.

    * All seasonal lists empty: every (p, d, q).
    * p, d and q all empty, some seasonal list not: P, D, Q are taken as p, d, q, without seasons.
    * Else the seasonal products over every s; a ``None`` in ``s`` adds the non-seasonal ones.

    A list that is empty beside others that are not leaves its product empty. Trend 'n', or none
    given, is no trend."""
    p, d, qq, P, D, Q = (list(spec.get(c) or []) for c in ("p", "d", "q", "P", "D", "Q"))
    s = list(spec.get("s") or [])
    trends = [None if t in ("n", None) else t for t in (spec.get("trend") or ["n"])]
    seasonal = bool(P or D or Q or s)
    if seasonal and not (p or d or qq):
        p, d, qq, seasonal = P, D, Q, False
    out = []
    if not seasonal or None in s:
        out += [dict(p=int(a), d=int(b), q=int(c), P=0, D=0, Q=0, s=0, trend=t) for a, b, c, t in itertools.product(p, d, qq, trends)]
    if seasonal:
        out += [dict(p=int(a), d=int(b), q=int(c), P=int(A), D=int(B), Q=int(C), s=int(v), trend=t)
                for a, b, c, A, B, C, v, t in itertools.product(p, d, qq, P, D, Q, [v for v in s if v is not None], trends)]
    return out


def params_table(spark, grid: list[dict]):
    """The grid as a DataFrame (one row per candidate, values as text)."""
    names = sorted({k for g in grid for k in g})
    rows = [(i, *[None if g.get(n) is None else str(g.get(n)) for n in names]) for i, g in enumerate(grid)]
    return spark.createDataFrame(rows, ", ".join(["candidate int", *[f"`{n}` string" for n in names]]))


# ----------------------------------------------------------------------------- M9
def param_samples(space: dict[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """Seeded draws. Space entries: ('loguniform', lo, hi), ('uniform', lo, hi),
    ('int', lo, hi) inclusive, ('int_excl', lo, hi) exclusive upper, ('choice', [..])."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        d = {}
        for name, spec in space.items():
            kind = spec[0]
            if kind == "loguniform":
                d[name] = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
            elif kind == "uniform":
                d[name] = rng.uniform(spec[1], spec[2])
            elif kind == "int":
                d[name] = rng.randint(spec[1], spec[2])
            elif kind == "int_excl":
                d[name] = rng.randrange(spec[1], spec[2])
            elif kind == "choice":
                d[name] = rng.choice(list(spec[1]))
            else:
                raise ValueError(f"unknown space kind {kind!r}")
        if d.get("solver") == "liblinear" and d.get("penalty") not in (None, "l1", "l2"):
            d["penalty"] = "l2"
        out.append(d)
    return out


# ----------------------------------------------------------------------------- M10 / M11 (classification)
def hash_folds(df: DataFrame, id_col: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Deterministic fold ids 0..k-1 from the portable hash of an id (of any type)."""
    h = F.conv(F.substring(portable_hash([q(id_col)], seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(out, F.pmod(h, F.lit(k)).cast("int"))


def grid_search_cv(estimator: Estimator, grid: list[dict], df: DataFrame, label: str, id_col: str,
                   folds: int = 5, parallelism: int = 4, metric: str = "accuracy", seed: int = 42):
    """k-fold cross-validated grid search (folds from the id hash); returns the fitted
    ``CrossValidatorModel`` (``avgMetrics`` per candidate, ``bestModel``)."""
    maps = [{estimator.getParam(k): v for k, v in g.items()} for g in grid] or ParamGridBuilder().build()
    # stored: every fit and score reads the columns it needs, and nothing before them runs again
    data = written(hash_folds(df, id_col, folds, seed).withColumn("_label", q(label).cast("double")), "folds")
    sizes = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    for f in range(folds):
        if not sum(n for of, n in sizes.items() if of != f):
            raise ValueError(f"The training data at fold {f} is empty.")
        if not sizes.get(f):
            raise ValueError(f"The validation data at fold {f} is empty.")
    ev = MulticlassClassificationEvaluator(labelCol="_label", predictionCol="prediction", metricName=metric)

    def scored(f: int, candidate: dict) -> float:
        model = estimator.fit(data.filter(F.col("fold") != f), candidate)
        return float(ev.evaluate(model.transform(data.filter(F.col("fold") == f))))

    jobs = [(f, candidate) for f in range(folds) for candidate in maps]
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(maps)))) as pool:
        scores = list(pool.map(lambda job: scored(*job), jobs))
    by_candidate = [scores[i:: len(maps)] for i in range(len(maps))]
    means = [sum(s) / folds for s in by_candidate]
    spread = [math.sqrt(sum((v - m) ** 2 for v in s) / folds) for s, m in zip(by_candidate, means)]
    best = max(range(len(maps)), key=lambda i: (means[i] if ev.isLargerBetter() else -means[i], -i))
    return CrossValidatorModel(estimator.fit(data, maps[best]), means, stdMetrics=spread)


def search_cv(fit, grid: list[dict], df: DataFrame, label: str, id_cols: Sequence[str], folds: int = 5, seed: int = 42):
    """Grid search for anything that ``fit(train, **candidate)`` fits: accuracy averaged over the folds
    of the ids' hash, the earlier candidate on ties. A candidate that fails in a fold is out; it
    is an error if all are. Returns (best candidate, its model on all rows, [(candidate, accuracy)])."""
    ev = MulticlassClassificationEvaluator(labelCol="_label", predictionCol="prediction", metricName="accuracy")
    ids = F.concat_ws("\x1f", *[q(c).cast("string") for c in id_cols])
    x = hash_folds(df.withColumn("_label", q(label).cast("double")).withColumn("_ids", ids), "_ids", folds, seed, out="_fold").drop("_ids").cache()
    results, last = [], None
    try:
        for candidate in grid:
            try:
                scores = [float(ev.evaluate(fit(x.filter(F.col("_fold") != f), **candidate).transform(x.filter(F.col("_fold") == f)))) for f in range(folds)]
                results.append((candidate, sum(scores) / folds))
            except Exception as failed:  # noqa: BLE001 - whatever this candidate broke
                results.append((candidate, None))
                last = failed
        scored = [i for i, (_, a) in enumerate(results) if a is not None]
        if not scored:
            raise ValueError(f"every candidate failed, the last with: {last}")
        best = max(scored, key=lambda i: (results[i][1], -i))
        return grid[best], fit(x, **grid[best]), results
    finally:
        x.unpersist()


def holdout_search(estimator: Estimator, grid: list[dict], train: DataFrame, val: DataFrame, label: str,
                   parallelism: int = 4, minimize: bool = True):
    """Time-series hold-out search: fit every candidate on ``train`` (fitMultiple, bounded
    pool), score ``val`` with MSE (the reference compares MSE), return (best_params,
    best_model, [(params, mse)])."""
    maps = [{estimator.getParam(k): v for k, v in g.items()} for g in grid]
    tr = train.withColumn("_label", q(label).cast("double")).cache()
    results = []
    models = {}
    try:
        it = estimator.fitMultiple(tr, maps)

        def step(_):
            return next(it)

        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            for idx, model in pool.map(step, range(len(maps))):
                models[idx] = model
    finally:
        tr.unpersist()
    for idx, g in enumerate(grid):
        pred = models[idx].transform(val)
        m = metrics.regression_metrics(pred, label, "prediction").first()
        results.append((g, float(m["mse"]) if m["mse"] is not None else float("inf")))
    best = min(range(len(grid)), key=lambda i: results[i][1]) if minimize else \
        max(range(len(grid)), key=lambda i: results[i][1])
    return grid[best], models[best], results


def random_search(estimator: Estimator, space: dict, n: int, train: DataFrame, val: DataFrame, label: str,
                  seed: int = 42, parallelism: int = 4):
    """Seeded random draws evaluated like the hold-out grid search; failed draws are
    skipped, all failed -> error."""
    draws = param_samples(space, n, seed)
    ok = []
    for d in draws:
        try:
            estimator.copy({estimator.getParam(k): v for k, v in d.items()})
            ok.append(d)
        except Exception:  # noqa: BLE001 - invalid draw
            continue
    if not ok:
        raise ValueError("every random draw failed")
    return holdout_search(estimator, ok, train, val, label, parallelism)


def accuracy_search(fit, space: dict, n: int, train: DataFrame, val: DataFrame, label: str, seed: int = 42):
    """Seeded random draws for a classifier, compared by accuracy on ``val``. ``fit(train,
    **draw)`` returns a fitted model; a draw whose *fit* fails is skipped, and it is an error
    if all fail. Returns (best draw, best model, [(draw, accuracy or None)])."""
    ev = MulticlassClassificationEvaluator(labelCol="_label", predictionCol="prediction", metricName="accuracy")
    known = val.withColumn("_label", q(label).cast("double"))
    results, best = [], None
    for draw in param_samples(space, n, seed):
        try:
            model = fit(train, **draw)
        except Exception as failed:  # noqa: BLE001 - whatever this draw broke
            results.append((draw, None))
            last = failed
            continue
        acc = float(ev.evaluate(model.transform(known)))
        results.append((draw, acc))
        if best is None or acc > best[2]:
            best = (draw, model, acc)
    if best is None:
        raise ValueError(f"every draw failed, the last with: {last}")
    return best[0], best[1], results


# ----------------------------------------------------------------------------- M11 (autoregressive)
def ar_search(df: DataFrame, target: str, grid: list[dict], order_cols: Sequence[str], key=None, exog: Sequence[str] = ()) -> DataFrame:
    """The (p, d, trend, P, D, s) candidate with the lowest AIC of every series (the earlier
    one on ties). All candidates without moving-average terms come from one factor over the rows
    that all can use; those with such terms are fitted one by one on the same rows."""
    keys = keys_of(key)
    fits = fit_ar_grid(df, target, grid, order_cols, keys, exog=exog).filter(F.col("aic").isNotNull())
    cols = [c for c in fits.columns if c not in keys]
    return fits.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct("aic", "candidate")).alias("best")).select(*keys, "best.*")


# ----------------------------------------------------------------------------- M12
def walk_forward(df: DataFrame, target: str, order_cols: Sequence[str], W: int, h: int, folds: int = 5,
                 p: int = 1, d: int = 0, trend: str | None = "c", key=None, exog: Sequence[str] = (), P: int = 0, D: int = 0, s: int = 0,
                 block: int | None = None) -> DataFrame:
    """Fit on each rolling-origin fold's training rows, forecast its test rows, pool all
    predictions in time order; the first half are validation, the rest test
    (``n // 2``). Returns (keys, fold, step, order columns, actual, forecast, part). Fold f
    trains on rows [f h, f h + W) and is tested on the next h. Fewer than two predictions of a
    series are an error, and so is a window too short for the model's lags.

    No row is copied into the folds that train on it. The folds' first and last usable rows
    cut a series into at most 2 * folds segments; each row goes into the triangular factor of
    its segment, and a fold merges the factors of its segments. Only a fold's last levels (as
    many as the model looks back) and its test rows are dealt to it."""
    keys = keys_of(key)
    order = dict(p=p, d=d, P=P, D=D, s=s)
    reach = reach_of(**order)
    if W < 1 or h < 1 or reach >= W:
        raise ValueError(f"a window of {W} rows (horizon {h}) is too short for a model that looks {reach} rows back")
    fk = [*keys, "fold"]
    kept = list(dict.fromkeys([*keys, *order_cols, target, *exog]))
    x = assign_row_id(df.select(*[q(c) for c in kept]), list(order_cols), key=keys, row_id="_rid", with_count="_n")
    rid = F.col("_rid")

    # factors by segment, merged by fold
    design = Design()
    design.model(target, exog=exog, trend=trend, **order)
    first, last = {f: f * h + reach for f in range(folds)}, {f: f * h + W for f in range(folds)}
    bounds = sorted({*first.values(), *last.values()})
    cuts = F.array(*[F.lit(b) for b in bounds])
    lagged = with_lag_table(x, {target: reach, **{e: d + D * s for e in exog}}, None, keys, "_rid", block)
    lagged = lagged.filter(rid.between(bounds[0], bounds[-1] - 1)).withColumn("_seg", F.size(F.filter(cuts, lambda b: b <= rid)))
    parts = partial_factors(lagged, [*keys, "_seg"], design.expressions())
    low = F.element_at(cuts, F.col("_seg"))
    uses = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: (f * h + reach <= low) & (low < f * h + W))
    parts = parts.withColumn("fold", F.explode(uses)).drop("_seg")
    fit = solve_factors(parts, fk, FIT_FIELDS, lambda k, factor: [fit_row(factor, design.model(target, exog=exog, trend=trend, start=k[-1] * h, **order), order)])

    # each fold's last levels and test rows
    most = F.least(F.lit(folds - 1), F.floor((F.col("_n") - W - 1) / F.lit(h)))  # the last fold with a test row
    def dealt(lo, hi, from_row):  # folds whose rows from_row .. hold this row, with its place
        lo, hi = F.greatest(F.lit(0), lo).cast("int"), F.least(most, hi).cast("int")
        return F.when(hi >= lo, F.transform(F.sequence(lo, hi), lambda f: F.struct(f.alias("fold"), (rid - f * h - from_row).cast("int").alias("place"))))

    back = reach + 1
    tail = dealt(F.ceil((rid - W + 1) / F.lit(h)), F.floor((rid - W + back) / F.lit(h)), W)  # places -back .. -1
    test = dealt(F.ceil((rid - W - h + 1) / F.lit(h)), F.floor((rid - W) / F.lit(h)), W)  # places 0 .. h - 1
    none = F.array().cast("array<struct<fold:int,place:int>>")
    rows = x.filter(F.col("_n") >= W + h).withColumn("_f", F.explode(F.concat(F.coalesce(tail, none), F.coalesce(test, none)))).select("*", "_f.fold", "_f.place")
    level = F.struct(F.col("place").cast("bigint").alias("o"), q(target).cast("double").alias("y"), F.array(*[q(e).cast("double") for e in exog]).cast("array<double>").alias("x"))
    tested = F.struct((F.col("place") + 1).alias("step"), *[q(c).alias(c) for c in order_cols], q(target).cast("double").alias("actual"),
                      F.array(*[q(e).cast("double") for e in exog]).cast("array<double>").alias("x"))
    # reach + 1 + h rows of a fold
    by_fold = rows.groupBy(*fk).agg(F.sort_array(F.collect_list(F.when(F.col("place") < 0, level))).alias("_h"),
                                    F.sort_array(F.collect_list(F.when(F.col("place") >= 0, tested))).alias("_t")).withColumn("_rows", F.lit(W))
    ahead = by_fold.withColumn("_f", F.transform("_t", lambda t: F.struct(t["step"].alias("step"), t["x"].alias("x"))))
    out = project_ar(fit, ahead, h, fk, exog, known=True, keep=["_t"])
    pooled = out.withColumn("_t", F.try_element_at("_t", F.col("step"))).filter(F.col("_t").isNotNull()).select(*fk, "_t.*", "forecast").drop("x")
    pooled = pooled.select(*fk, "step", *order_cols, "actual", "forecast")
    counted = pooled.groupBy(*keys).count().agg(F.min("count").alias("least"), F.count(F.lit(1)).alias("k")).first()
    if not counted["k"] or counted["least"] < 2:
        raise ValueError("walk-forward validation needs two predictions or more of every series")
    wp = Window.partitionBy(*[q(k) for k in keys] or [F.lit(0)])  # folds * h rows of a series
    wo = wp.orderBy(*[q(c) for c in order_cols], "fold")
    pooled = pooled.withColumn("_i", F.row_number().over(wo) - 1).withColumn("_n", F.count(F.lit(1)).over(wp))
    return pooled.withColumn("part", F.when(F.col("_i") < F.floor(F.col("_n") / 2), "val").otherwise("test")) \
                 .drop("_i", "_n")


def walk_forward_metrics(pooled: DataFrame, key=None) -> DataFrame:
    """Forecast metrics of the validation and the test half of ``walk_forward``'s predictions."""
    return metrics.regression_metrics(pooled, "actual", "forecast", by=[*keys_of(key), "part"])
