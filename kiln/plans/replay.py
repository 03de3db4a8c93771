"""Replay a recorded step list on fresh data.

A record is ``{"steps": [...]}``. Cleaning is ``steps[0]``; profiling runs when flagged or when
the record holds it; the first ``data_encoding`` step encodes; the first step whose name starts
with ``train`` trains on the encoded table, or on the cleaned one without encoding. Two kinds of
record are read: tabular ones (cleaning switches, encoders, classifiers) and time-series ones
(a list of cleaning methods, lags, a horizon, forecasters). What a record says in a key that is
not known here, or with an algorithm that is not, is an error, never a default. A recorded grid or
random search is searched again: classifiers by accuracy (five folds, or the validation part),
autoregressions by AIC.

Everything up to training stays one lazy plan; only declared outputs are materialised.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.operators import boosting, clean, encode, model, profile, split, tune

# The keys of recorded parameters, and what they are here.
CLEANING_KEYS = {"eliminar_duplicados": "remove_duplicates", "filtrar_outliers": "remove_outliers",
                 "relleno_valores_numericos": "numeric_fill", "valor_imputacion": "fill_value"}
SERIES_CLEANING_KEYS = ("optional_methods",)
ENCODING_KEYS = ("input_features", "target_variables", "encode_target_ohe", "encode_target_label",
                 "date_column", "lag_periods", "lag_nan_handling")
STEP_KEYS = ("step", "algorithm", "input_features", "target_variable", "target_variables", "problem_type", "split_ratios", "hyperparameters", "params",
             "model_name", "date_col_name", "forecast_horizon")
SEARCH_KEYS = ("hyperparameter_search_strategy", "grid_search", "random_search", "bayesian_search", "bayesian_config", "hyperparameter_search",
               "optimization_metric")
# What a training step records about its own run; without effect on a replay.
RECORDED = ("schema_version", "timestamp", "run_id", "metrics", "train_metrics", "val_metrics", "test_metrics", "model_path", "artifacts", "energy_metrics",
            "features", "lstm_metadata")
# The training steps' names, by kind of model.
TABULAR = {"train_logistic_regression": "logistic", "train_mlp_model": "mlp", "train_mlp": "mlp", "train_xgboost": "gbt"}
SERIES = {"train_arima": "ar", "train_sarimax": "ar", "train_xgboost": "gbt_forecast"}
HYPER = {
    "logistic": {"C": "C", "regularization": "C", "max_iter": "max_iter", "maxIter": "max_iter", "solver": "solver",
                 "penalty": "penalty", "l1_ratio": "l1_ratio"},
    "mlp": {"hidden_layer_sizes": "hidden", "max_iter": "max_iter", "maxIter": "max_iter", "activation": "activation",
            "solver": "solver", "learning_rate_init": "step_size"},
    "gbt": {"learning_rate": "learning_rate", "n_estimators": "n_trees", "max_depth": "max_depth", "subsample": "subsample",
            "colsample_bytree": "colsample"},
    "ar": {"p": "p", "d": "d", "P": "P", "D": "D", "Q": "Q", "s": "s", "q": "ma", "trend": "trend"},
}
HYPER["gbt_forecast"] = HYPER["gbt"]
# What a record leaves out.
DEFAULTS = {"mlp": {"hidden": "4", "activation": "relu", "solver": "adam", "max_iter": 200}}
# The grids that a recorded grid search without lists of its own goes through.
GRIDS = {
    "logistic": {"C": [0.1, 1, 10, 100], "max_iter": [100, 200], "solver": ["lbfgs", "liblinear"]},
    "gbt": {"learning_rate": [0.01, 0.1, 0.2], "n_estimators": [50, 100, 200], "max_depth": [3, 5, 7], "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0]},
    "mlp": {"hidden_layer_sizes": [(4,), (10,), (10, 5), (100, 50, 10)], "activation": ["relu", "tanh"], "solver": ["adam", "sgd"], "max_iter": [200, 300]},
}
# The ranges of a recorded random search, where the record gives none.
RANGES = {"logistic": {"C_range": [0.001, 100.0], "max_iter_range": [100, 1000], "solver_options": ["lbfgs", "liblinear", "saga"], "penalty_options": ["l2", "none"]}}
#: Ranges drawn on a logarithmic scale.
LOGARITHMIC = ("C", "learning_rate_init")
# Recorded beside the hyperparameters, without effect on a fit here.
REMARKS = ("random_state", "verbose", "val_accuracy", "best_iteration", "objective", "eval_metric", "n_jobs", "seed", "num_class")


@dataclass
class ReplayResult:
    cleaned: DataFrame
    encoded: DataFrame | None = None
    profile: DataFrame | None = None
    splits: DataFrame | None = None
    model: object | None = None
    forecast: DataFrame | None = None
    best: dict | None = None
    search: list | None = None
    reports: dict = field(default_factory=dict)

    @property
    def training_table(self) -> DataFrame:
        return self.encoded if self.encoded is not None else self.cleaned


def _only(given: dict, known, where: str) -> dict:
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ValueError(f"{where}: unknown keys {unknown}")
    return given


def _first(steps: Sequence[dict], pred):
    return next((s for s in steps if pred(str(s.get("step", "")).lower())), None)


def _ratios(given) -> tuple[float, float, float]:
    if isinstance(given, dict):
        _only(given, ("train", "val", "validation", "test"), "split_ratios")
        return float(given["train"]), float(given.get("val", given.get("validation", 0.0))), float(given["test"])
    return tuple(float(r) for r in given)


def replay_steps(df: DataFrame, config: dict, train: bool = True, with_report: bool = False,
                 id_cols: Sequence[str] = (), order_cols: Sequence[str] = ()) -> ReplayResult:
    """``id_cols`` identify rows for the stratified split, ``order_cols`` put a series in order
    (the recorded date column is taken first): rows have no implicit order in Spark."""
    steps = list(config.get("steps") or [])
    if not steps:
        raise ValueError("the record has no steps")
    p = dict(steps[0].get("parameters") or {})
    if "optional_methods" in p:
        _only(p, SERIES_CLEANING_KEYS, "cleaning")
        cleaned, rep = clean.apply_cleaning(df, p["optional_methods"], strict=True)
    else:
        _only(p, CLEANING_KEYS, "cleaning")
        defaults = {"remove_duplicates": True, "remove_outliers": True, "numeric_fill": "media", "fill_value": None}
        cleaned, rep = clean.clean_table(df, with_report=with_report, **defaults | {CLEANING_KEYS[k]: v for k, v in p.items()})
    res = ReplayResult(cleaned=cleaned, reports={"cleaning": rep})
    if config.get("run_eda") or _first(steps, lambda name: name == "generate_eda"):
        res.profile = profile.profile_all(cleaned)
    enc = _first(steps, lambda name: name == "data_encoding")
    if enc is not None and enc.get("parameters"):
        res.encoded = _encoded(cleaned, enc["parameters"], order_cols)
    tr = _first(steps, lambda name: name.startswith("train"))
    if tr is not None:
        _train(res, tr, train, id_cols, order_cols)
    return res


def _encoded(x: DataFrame, ep: dict, order_cols: Sequence[str]) -> DataFrame:
    _only(ep, ENCODING_KEYS, "encoding")
    if not ep.get("input_features") or not ep.get("target_variables"):
        raise ValueError("encoding needs input_features and target_variables")
    inputs, targets = encode.usable(ep["input_features"]), encode.usable(ep["target_variables"])
    encode.require_columns(x, inputs, targets)
    if ep.get("encode_target_ohe") and ep.get("encode_target_label"):
        raise ValueError("one-hot or label encoding of the targets, not both")
    lags = int(ep.get("lag_periods") or 0)
    if lags > 0:
        date = ep.get("date_column") or x.columns[0]
        order = list(dict.fromkeys([date, *order_cols]))
        kept, _ = split.numeric_features(x, [c for c in inputs if c != date and c not in targets])
        x = encode.handle_lag_nulls(encode.add_lags(x, kept, lags, order_cols=order), ep.get("lag_nan_handling") or "leave_as_is", order_cols=order)
    x = encode.one_hot(x, inputs)
    if ep.get("encode_target_ohe"):
        x = encode.one_hot_target(x, targets)
    elif ep.get("encode_target_label"):
        x = encode.label_encode(x, targets)
    return encode.bool_to_int(x)


def _train(res: ReplayResult, tr: dict, fit: bool, id_cols: Sequence[str], order_cols: Sequence[str]) -> None:
    name = str(tr["step"]).lower()
    series = "date_col_name" in tr or "forecast_horizon" in tr
    if name == "train_model":  # newer records name the algorithm beside the step
        name = f"train_{str(tr.get('algorithm', '')).lower()}"
    kind = (SERIES if series else TABULAR).get(name)
    if kind is None:
        raise ValueError(f"unknown training step {tr['step']!r} (algorithm {tr.get('algorithm')!r})")
    _only(tr, [*STEP_KEYS, *SEARCH_KEYS, *RECORDED], f"training step {tr['step']}")
    strategy = _strategy(tr)
    given = dict(tr.get("hyperparameters") or tr.get("params") or {})
    params = _named(kind, given) if strategy == "none" else {}  # a search replaces what it found before
    target = tr.get("target_variable") or (tr.get("target_variables") or [None])[0]
    if not target:
        raise ValueError("the training step names no target_variable")
    table, ratios = res.training_table, _ratios(tr.get("split_ratios") or (0.7, 0.15, 0.15))
    wanted = [c for c in encode.usable(tr.get("input_features") or []) if c != target]
    feats = _expanded(table, wanted)
    if series:
        date = tr.get("date_col_name") or table.columns[0]
        order, h = list(dict.fromkeys([date, *order_cols])), int(tr.get("forecast_horizon") or 1)
        feats = [c for c in feats if c != date]
        if kind == "ar":
            res.splits = split.temporal_split(table, ratios, order_cols=order)
            if fit:
                _train_ar(res, tr, strategy, params, target, split.numeric_features(table, feats)[0], order)
            return
        if strategy != "none" and fit:
            raise ValueError(f"{strategy} search of a boosted forecaster is not replayed")
        res.splits = split.supervised(table, target, feats, h=h, order_cols=order, ratios=ratios)
        if fit:
            res.model = model.fit_gbt_forecaster(res.splits.filter("split = 'train'"), feats, "y", **params)
        return
    if not id_cols:
        raise ValueError("a stratified split needs id_cols")
    res.splits = split.stratified_split(table, target, ratios, id_cols=list(id_cols))
    if fit:
        run = {"logistic": model.fit_logistic, "mlp": model.fit_mlp, "gbt": model.fit_gbt_classifier}[kind]
        feats = [c for c in feats if c not in id_cols]
        past, val = (res.splits.filter(f"split = '{part}'") for part in ("train", "val"))
        fitted = lambda df, **g: run(df, feats, target, **_named(kind, g))
        if strategy == "grid":
            lists = _grid_lists(tr) or GRIDS[kind]
            res.best, res.model, res.search = tune.search_cv(fitted, tune.param_grid(lists), past, target, list(id_cols))
        elif strategy == "random":
            space, draws = _random_space(tr, kind)
            res.best, res.model, res.search = tune.accuracy_search(fitted, space, draws, past, val, target)
        else:
            if kind == "gbt":  # watched by the validation part, as recorded
                seen = res.splits.filter("split != 'test'").withColumn("_watch", F.col("split") == "val")
                res.model = boosting.fit_boosted(seen, feats, target, validation_col="_watch", **params)
            else:
                res.model = run(past, feats, target, **DEFAULTS.get(kind, {}) | params)


def _named(kind: str, given: dict) -> dict:
    """Recorded hyperparameters under the names used here."""
    _only(given, [*HYPER[kind], *REMARKS], "hyperparameters")
    return {HYPER[kind][k]: v for k, v in given.items() if k in HYPER[kind] and v is not None}


def _strategy(tr: dict) -> str:
    """none, grid or random. Older records only say whether a grid was searched."""
    nested = tr.get("hyperparameter_search") or {}
    named = tr.get("hyperparameter_search_strategy") or nested.get("strategy")
    if named is None:
        named = "grid" if (tr.get("grid_search") or {}).get("use_grid_search") else "none"
    named = {"manual": "none"}.get(named, named)
    if named not in ("none", "grid", "random"):
        raise ValueError(f"{named!r} search is not replayed")
    return named


def _grid_lists(tr: dict) -> dict:
    """The lists of a grid search as recorded, or nothing."""
    grid = dict(tr.get("grid_search") or {})
    own = {k: v for k, v in grid.items() if k not in ("use_grid_search", "best_params", "grid_search_params")}
    return (tr.get("hyperparameter_search") or {}).get("grid_search_params") or grid.get("grid_search_params") or own


def _random_space(tr: dict, kind: str) -> tuple[dict, int]:
    """The space of a random search and its number of draws: ``<name>_range`` holds two bounds,
    ``<name>_options`` values."""
    nested, plain = tr.get("hyperparameter_search") or {}, tr.get("random_search") or {}
    draws = int(nested.get("n_random_iterations") or plain.get("n_random_iterations") or 100)
    given = {**RANGES.get(kind, {}), **(nested.get("random_search_params") or plain.get("random_search_params") or {})}
    space: dict[str, tuple] = {}
    for key, value in given.items():
        if key.endswith("_options"):
            space[key[:-8]] = ("choice", list(value))
        elif key.endswith("_range") and len(value) == 2:
            whole = all(isinstance(v, int) for v in value)
            name = key[:-6]
            space[name] = ("int" if whole else "loguniform" if name in LOGARITHMIC else "uniform", *value)
        else:
            raise ValueError(f"random search: {key!r} is neither a range nor a list of options")
    if not space:
        raise ValueError("the random search records no ranges")
    return space, draws


def _train_ar(res: ReplayResult, tr: dict, strategy: str, params: dict, target: str, exog: list[str], order: list[str]) -> None:
    """Fits on the training rows and forecasts as many steps as there are test rows, whose
    regressors are taken as the future ones; the forecast starts behind the training rows."""
    past, test = (res.splits.filter(f"split = '{part}'") for part in ("train", "test"))
    if strategy == "random":
        raise ValueError("random search of an autoregression is not replayed")
    if strategy == "grid":
        grid = tune.ar_grid({k: v for k, v in _grid_lists(tr).items() if k not in ("enforce_stationarity", "enforce_invertibility")})
        if not grid:
            raise ValueError("the grid search has no candidates")
        won = tune.ar_search(past, target, grid, order, exog=exog).first()
        if won is None:
            raise ValueError("no candidate of the grid could be fitted")
        res.best = grid[won["candidate"]]
        params = {k: v for k, v in res.best.items() if k != "q"} | {"ma": res.best["q"]}
    res.model = model.fit_ar(past, target, order_cols=order, exog=exog, **{"p": 1, "trend": "c"} | params)
    from kiln.operators.order import assign_row_id

    rows = assign_row_id(test, order, row_id="_step").withColumn("step", (F.col("_step") + 1).cast("int"))
    future = rows.select("step", *[F.col(f"`{e}`") for e in exog])
    ahead = model.forecast_ar(res.model, past, target, test.count(), order, future=future if exog else None)
    res.forecast = ahead.join(rows.select("step", F.col(f"`{target}`").cast("double").alias("actual")), "step")


def _expanded(table: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns as they stand after encoding: a one-hot feature by its dummies, a
    lagged one with its lags."""
    out: list[str] = []
    for c in wanted:
        if c in table.columns:
            out += [c, *[x for x in table.columns if x.startswith(f"{c}_lag_")]]
        else:
            dummies = [x for x in table.columns if x.startswith(f"{c}_")]
            if not dummies:
                raise ValueError(f"training feature {c!r} is not in the table")
            out += dummies
    return list(dict.fromkeys(out))


def record_of(docs: DataFrame, run_id: str, doc_col: str = "doc", id_col: str = "run_id") -> dict:
    """One recorded document by its id, ready for :func:`replay_steps`."""
    import json

    row = docs.filter(F.col(id_col) == run_id).select(doc_col).first()
    if row is None:
        raise ValueError(f"no record {run_id!r}")
    return json.loads(row[0])
