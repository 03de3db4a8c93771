"""Run records as tables.

A run document is JSON ``{"steps": [{...}, ...]}``; many documents are processed at once
as rows of a DataFrame. Appending is a Parquet append (safe under concurrency, unlike a
read-modify-write of one JSON file).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.functions.exprs import q
from kiln.operators.order import keys_of

# Record versions, field names and allowed names that run records use.
V11_TOP_LEVEL = ["schema_version", "step", "algorithm", "params", "metrics", "hyperparameter_search",
                 "lstm_metadata"]
V11_METRICS = ["val_rmse", "val_mae", "val_mape", "test_rmse", "test_mae", "test_mape"]
V11_SEARCH = ["strategy", "iterations_total", "best_iteration", "best_val_loss"]
V11_STRATEGIES = ["none", "grid", "random", "bayesian"]
V11_STRATEGY_NEEDS = {"grid": ["grid_search_params"], "random": ["random_search_params", "n_random_iterations"]}
V11_BAYESIAN = ["n_trials", "n_initial_points", "optimization_metric", "best_trial_number", "n_completed_trials",
                "best_params", "seed"]
V11_LSTM_META = ["sequence_length", "model_architecture", "total_params", "cpu_only"]
TRAINING_MODES = ["univariate", "multivariate"]
V10_REQUIRED = ["step", "algorithm"]

LONG_LIST = 15
LIST_PART = 10


# ----------------------------------------------------------------------------- R1
def append_run(spark: SparkSession, path: str, records: DataFrame) -> None:
    """Append step records (run_id, step_no, doc JSON) to the run table."""
    records.write.mode("append").parquet(path)


def steps_of(docs: DataFrame, doc_col: str = "doc", id_col: str = "run_id") -> DataFrame:
    """(run_id, step_no 1-based, step_json) from run documents."""
    arr = F.from_json(q(doc_col), "struct<steps: array<string>>")["steps"]
    return docs.select(q(id_col), F.posexplode(arr).alias("pos", "step_json")) \
               .select(id_col, (F.col("pos") + 1).alias("step_no"), "step_json")


# ----------------------------------------------------------------------------- R2
def flatten_runs(docs: DataFrame, doc_col: str = "doc", id_col: str = "run_id") -> DataFrame:
    """(run_id, step_no, step, key, part, value): one row per top-level field of every
    step; lists longer than 15 are cut in parts of 10 (part 1, 2, ...; part 0 = the whole
    value); other values as text (nested values as compact JSON)."""
    s = steps_of(docs, doc_col, id_col)
    kv = s.select(id_col, "step_no", F.get_json_object("step_json", "$.step").alias("step"),
                  F.explode(F.from_json("step_json", "map<string,string>")).alias("key", "value"))
    n = F.json_array_length(F.when(F.col("value").startswith("["), F.col("value")))
    long_list = F.coalesce(n, F.lit(0)) > LONG_LIST
    items = F.from_json(F.col("value"), "array<string>")
    def as_json(e):
        # elements come back as raw JSON text for numbers / literals / nested values and as
        # bare text for strings, which are quoted again
        raw = e.rlike("^-?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?$") | e.isin("true", "false", "null") | \
            e.startswith("{") | e.startswith("[")
        quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(e, "\\\\", "\\\\\\\\"), '"', '\\\\"'),
                          F.lit('"'))
        return F.when(e.isNull(), F.lit("null")).when(raw, e).otherwise(quoted)

    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / LIST_PART).cast("int")),
                        lambda i: F.struct((i + 1).alias("part"),
                                           F.concat(F.lit("["), F.array_join(F.transform(
                                               F.slice(items, i * LIST_PART + 1, LIST_PART), as_json), ","),
                                               F.lit("]")).alias("value")))
    one = F.array(F.struct(F.lit(0).alias("part"), F.col("value").alias("value")))
    out = kv.select(id_col, "step_no", "step", "key", F.explode(F.when(long_list, parts).otherwise(one)).alias("p"))
    return out.select(id_col, F.col("step_no").cast("int").alias("step_no"), "step", "key",
                      F.col("p.part").alias("part"), F.col("p.value").alias("value"))


# ----------------------------------------------------------------------------- R3
class _Step:
    """Typed looks into one step's JSON (a variant, so text is told from numbers)."""

    def __init__(self, js: Column):
        self.v = F.try_parse_json(js)

    def at(self, path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(self.v, f"$.{path}", kind)

    def kind(self, path: str) -> Column:
        """BIGINT, DOUBLE, DECIMAL(..), STRING, BOOLEAN, VOID (a JSON null), ...; NULL if absent."""
        return F.schema_of_variant(self.at(path))

    def there(self, path: str) -> Column:
        return self.kind(path).isNotNull()

    def filled(self, path: str) -> Column:
        return F.coalesce(self.kind(path) != "VOID", F.lit(False))

    def numeric(self, path: str) -> Column:
        k = self.kind(path)
        return F.coalesce(k.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | k.startswith("DECIMAL"), F.lit(False))

    def number(self, path: str) -> Column:
        return self.at(path, "double")

    def named(self, path: str, names: Sequence[str]) -> Column:
        return F.coalesce((self.kind(path) == "STRING") & self.at(path, "string").isin(*names), F.lit(False))


def _rules(s: _Step) -> list[tuple[str, str, str, Column]]:
    """The rules as (version, code, path, broken when): ``absent``, ``not_a_number``,
    ``not_allowed``, ``needed_by_strategy``, ``too_small``, ``not_below_n_trials``."""
    out = [("1.0", "absent", f, ~s.there(f)) for f in V10_REQUIRED]

    def v11(code: str, path: str, broken: Column) -> None:
        out.append(("1.1", code, path, broken))

    def absent_below(parent: str, fields: Sequence[str], when: Column) -> None:
        for f in fields:
            v11("absent", f"{parent}.{f}", when & ~s.there(f"{parent}.{f}"))

    for f in V11_TOP_LEVEL:
        v11("absent", f, ~s.there(f))
    absent_below("metrics", V11_METRICS, s.there("metrics"))
    for m in V11_METRICS:
        v11("not_a_number", f"metrics.{m}", s.filled(f"metrics.{m}") & ~s.numeric(f"metrics.{m}"))
    search, strategy = "hyperparameter_search", "hyperparameter_search.strategy"
    absent_below(search, V11_SEARCH, s.there(search))
    v11("not_allowed", strategy, s.there(strategy) & ~s.named(strategy, V11_STRATEGIES))
    for name, needs in V11_STRATEGY_NEEDS.items():
        for f in needs:
            v11("needed_by_strategy", f"{search}.{f}", s.named(strategy, [name]) & ~s.filled(f"{search}.{f}"))
    bayes = s.named(strategy, ["bayesian"])
    trials, initial = "bayesian_config.n_trials", "bayesian_config.n_initial_points"
    v11("needed_by_strategy", "bayesian_config", bayes & ~s.there("bayesian_config"))
    absent_below("bayesian_config", V11_BAYESIAN, bayes & s.there("bayesian_config"))
    v11("too_small", trials, bayes & (s.number(trials) < 1))
    v11("not_below_n_trials", initial, bayes & (s.number(initial) >= s.number(trials)))
    absent_below("lstm_metadata", V11_LSTM_META, s.there("lstm_metadata"))
    mode, n_in = "lstm_metadata.training_mode", "lstm_metadata.n_input_features"
    v11("not_allowed", mode, s.there(mode) & ~s.named(mode, TRAINING_MODES))
    whole = F.coalesce(s.kind(n_in).isin("BIGINT", "BOOLEAN") & (s.number(n_in) >= 1), F.lit(False))
    v11("too_small", n_in, s.there(n_in) & ~whole)
    return out


def validate_steps(steps: DataFrame, id_col: str = "run_id") -> DataFrame:
    """(run_id, step_no, version, ok, errors): the rules of the step's record version (1.0
    unless it says otherwise). An error is ``code:path``; a version without rules is the
    error ``unknown_version:`` and its name."""
    s = _Step(F.col("step_json"))
    version = F.coalesce(s.at("schema_version", "string"), F.lit("1.0"))
    rules = _rules(s)
    found = F.lit(None).cast("array<string>")
    for v in sorted({r[0] for r in rules}):
        own = [F.when(broken, F.lit(f"{code}:{path}")) for version_, code, path, broken in rules if version_ == v]
        found = F.when(F.col("version") == v, F.array_compact(F.array(*own))).otherwise(found)
    out = steps.withColumn("version", version)
    out = out.select(id_col, "step_no", "version",
                     F.coalesce(found, F.array(F.concat(F.lit("unknown_version:"), F.col("version")))).alias("errors"))
    return out.select(id_col, "step_no", "version", (F.size("errors") == 0).alias("ok"), "errors")


def validate_runs(docs: DataFrame, doc_col: str = "doc", id_col: str = "run_id", strict: bool = False) -> DataFrame:
    res = validate_steps(steps_of(docs, doc_col, id_col), id_col)
    if strict:
        bad = res.filter(~F.col("ok")).limit(1).collect()
        if bad:
            raise ValueError(f"run record validation failed: {bad[0]['errors']}")
    return res


# ----------------------------------------------------------------------------- R5
def metrics_long(docs: DataFrame, doc_col: str = "doc", id_col: str = "run_id",
                 prefixes: Sequence[str] = ("val_", "test_")) -> DataFrame:
    """(run_id, step_no, metric, value) for every numeric val/test metric, NULLs removed."""
    s = steps_of(docs, doc_col, id_col)
    m = s.select(id_col, "step_no", F.explode(F.from_json(F.get_json_object("step_json", "$.metrics"),
                                                         "map<string,string>")).alias("metric", "raw"))
    keep = None
    for p in prefixes:
        c = F.col("metric").startswith(p)
        keep = c if keep is None else keep | c
    return m.filter(keep).select(id_col, "step_no", "metric", F.col("raw").try_cast("double").alias("value")) \
            .filter(F.col("value").isNotNull())


# ----------------------------------------------------------------------------- R6
ERROR_METRICS = ("rmse", "mae", "mape", "mse", "loss", "aic", "bic")


def best_runs(metrics: DataFrame, metric: str, by=None, id_col: str = "run_id") -> DataFrame:
    """Best run per group by one metric: min for errors, max for scores (accuracy...)."""
    keys = keys_of(by)
    x = metrics.filter(F.col("metric") == metric)
    minimize = any(metric.endswith(e) or e in metric for e in ERROR_METRICS)
    pick = F.min_by if minimize else F.max_by
    best = F.min("value") if minimize else F.max("value")
    return x.groupBy(*keys).agg(pick(q(id_col), F.struct(F.col("value"), q(id_col))).alias(id_col),
                                best.alias("value"))
