"""Moving-average terms (M7) by Gauss-Newton rounds over an affine-recurrence scan.

The residuals of a model with moving-average lags follow ``e_t = z_t - x_t b - sum_l theta_l e_(t-l)``,
so a row needs the residuals before it. The recurrence is affine in its state, the last L residuals:
a run of n rows takes a state s to ``M s + v``, where v is what the run leaves on its own and M is
the n-th power of the companion matrix. A series is stored once in blocks of rows; in each round
every block runs on its own, the few numbers (v) of a series' blocks are composed in order, and each
block runs again from its true state. Inside a block the same trick cuts the rows into about sqrt(n)
runs that go side by side.

A round regresses the filtered response on the filtered terms and on the derivatives by theta
(which follow the same recurrence) through mergeable factors, which is the Gauss-Newton step for the
conditional sum of squares. A step that raises the sum is halved, as is one that leaves the
invertible region. The start comes from one factor of lag columns: a long autoregression gives
residuals as linear forms of these columns, and the model is fitted on them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.exprs import q as quoted
from kiln.operators import model as m
from kiln.operators.factors import Factor, Model, least_squares, partial_factors, solve_factors
from kiln.operators.order import keys_of, written

BLOCK = 8192
#: Rounds at most. A series is done when no coefficient moves by more than TOLERANCE of its size (or of
#: 1), or when the sum of squares changes by no more than rounding.
ROUNDS, TOLERANCE, ROUNDING = 40, 1e-8, 1e-13
#: Lags of the long autoregression.
LONG = 12
#: The companion matrix's spectral radius stays below this.
INVERTIBLE = 0.9999
HALVINGS = 25


def ma_lags(q: int, Q: int = 0, s: int = 0) -> dict[str, int]:
    """Names and lags of the moving-average terms; seasonal ones are ``sma_i`` at lag i*s."""
    if Q and s < 2:
        raise ValueError("seasonal lags need a season of 2 or more")
    return {**{f"ma_{i}": i for i in range(1, q + 1)}, **{f"sma_{i}": i * s for i in range(1, Q + 1) if i * s > q}}


# ----------------------------------------------------------------------------- the recurrence
def _loop(u: np.ndarray, lags: Sequence[int], theta: Sequence[float], past: np.ndarray) -> np.ndarray:
    """out_t = u_t - sum theta_l out_(t-l) along the first axis; ``past[i]`` is out_(-1-i)."""
    depth = len(past)
    full = np.concatenate([past[::-1], u])
    for t in range(depth, len(full)):
        for lag, w in zip(lags, theta):
            full[t] -= w * full[t - lag]
    return full[depth:]


def recur(u: np.ndarray, lags: Sequence[int], theta: Sequence[float], past: np.ndarray) -> np.ndarray:
    """The same for an (n, columns) array, in about sqrt(n) steps: runs side by side, then their states
    in order."""
    n, depth = len(u), len(past)
    size = max(depth, int(np.ceil(np.sqrt(n))))
    if n <= 2 * size:
        return _loop(u, lags, theta, past)
    runs = -(-n // size)
    padded = np.concatenate([u, np.zeros((runs * size - n, u.shape[1]))]).reshape(runs, size, -1).transpose(1, 0, 2)
    own = _loop(padded, lags, theta, np.zeros((depth, runs, u.shape[1])))
    echo = _loop(np.zeros((size, depth)), lags, theta, np.eye(depth))
    out, state = np.empty((runs, size, u.shape[1])), past
    for k in range(runs):
        out[k] = own[:, k] + echo @ state
        state = out[k, size - depth:][::-1]
    return out.reshape(runs * size, -1)[:n]


def after(past: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The state behind the last row."""
    depth = len(past)
    return np.concatenate([past[::-1], out])[-depth:][::-1]


def companion(lags: Sequence[int], theta: Sequence[float], feed: int | None = None) -> np.ndarray:
    """One step of the state; with ``feed``, of the state and of a second one that the first feeds at
    that lag."""
    depth = max(lags)
    step = np.eye(depth, k=-1)
    for lag, w in zip(lags, theta):
        step[0, lag - 1] -= w
    if feed is None:
        return step
    both = np.zeros((2 * depth, 2 * depth))
    both[:depth, :depth] = both[depth:, depth:] = step
    both[depth, feed - 1] = 1.0
    return both


def invertible(lags: Sequence[int], theta: Sequence[float]) -> bool:
    return bool(np.isfinite(theta).all()) and np.abs(np.linalg.eigvals(companion(lags, theta))).max() < INVERTIBLE


class Run:
    """A block's rows filtered from given states: ``f`` of the terms and the response, residuals ``e``,
    ``g`` of the residuals at each moving-average lag."""

    def __init__(self, rows: np.ndarray, means: np.ndarray, beta: np.ndarray, theta: np.ndarray, lags: Sequence[int], past_f: np.ndarray, past_g: np.ndarray):
        self.known = ~np.isnan(rows).any(axis=1)
        k = rows.shape[1] - 1
        self.f = recur(np.where(self.known[:, None], rows - means, 0.0), lags, theta, past_f)
        self.e = self.f[:, k] - self.f[:, :k] @ beta
        past_e = past_f[:, k] - past_f[:, :k] @ beta
        behind = np.concatenate([past_e[::-1], self.e])
        fed = np.column_stack([behind[len(past_e) - lag:len(past_e) - lag + len(rows)] for lag in lags])
        self.g = recur(fed, lags, theta, past_g)
        self.end_f, self.end_g = after(past_f, self.f), after(past_g, self.g)
        self.end_e = after(past_e[:, None], self.e[:, None])[:, 0]


# ----------------------------------------------------------------------------- one series' parameters
PARAMETERS = ("means array<double>, beta array<double>, theta array<double>, best array<double>, best_ss double, n bigint, halvings int, done boolean, "
              "resid array<double>")


def _advance(p: dict, factor: Factor, ss: float, resid: list[float], lags: Sequence[int], k: int) -> dict:
    """The parameters of the next round from this one's sum of squares and factor."""
    now = np.concatenate([p["beta"], p["theta"]])
    best = None if p["best"] is None else np.array(p["best"])
    out = dict(p)
    still = best is not None and abs(ss - p["best_ss"]) <= ROUNDING * p["best_ss"]
    if best is None or ss <= p["best_ss"]:
        columns = len(now)
        fit = least_squares(factor, Model([""] * columns, [{i + 1: 1.0} for i in range(columns)], {columns + 1: 1.0}))
        step = np.array(fit.coef)
        step[k:] += p["theta"]
        out |= {"best": now.tolist(), "best_ss": ss, "n": factor.n, "resid": resid, "halvings": 0}
        move = step - now
        tries = 0
        while not invertible(lags, (now + move)[k:]) and tries < HALVINGS:
            move, tries = move / 2, tries + 1
        small = bool((np.abs(move) <= TOLERANCE * np.maximum(1.0, np.abs(now))).all())
        nxt = now + move
        out["done"] = small or still or tries == HALVINGS or factor.n <= columns
    else:
        nxt = best + (now - best) / 2
        out["halvings"] = p["halvings"] + 1
        out["done"] = still or out["halvings"] >= HALVINGS
    if out["done"]:
        nxt = np.array(out["best"])
    return out | {"beta": nxt[:k].tolist(), "theta": nxt[k:].tolist()}


def _start(factor: Factor, model_: Model, lags: Sequence[int], lagged: list[dict[int, float]]) -> dict:
    """Means of the terms and first parameters from the factor of lag columns. ``lagged[r]`` is the
    differenced response r rows back."""
    k, zero = len(model_.terms), [0.0] * len(lags)
    out = {"means": [0.0] * (k + 1), "beta": [0.0] * k, "theta": zero, "best": None, "best_ss": None, "n": 0, "halvings": 0, "done": False, "resid": None}
    if not factor.n:
        return out
    average = factor.shift + factor.r[0] / factor.r[0, 0]
    average[0] = 1.0
    const = bool(k) and model_.terms[0] == {0: 1.0}
    if const:
        out["means"] = [0.0, *[float(sum(w * average[c] for c, w in t.items())) for t in [*model_.terms[1:], model_.response]]]
    if factor.n > 3 * len(factor.shift):
        long = least_squares(factor, Model([""] * (LONG + 1), [{0: 1.0}, *lagged[1:LONG + 1]], lagged[0]))

        def residual(lag: int) -> dict[int, float]:
            form = dict(lagged[lag])
            form[0] = form.get(0, 0.0) - long.coef[0]
            for i in range(1, LONG + 1):
                for c, w in lagged[lag + i].items():
                    form[c] = form.get(c, 0.0) - long.coef[i] * w
            return form

        fit = least_squares(factor, Model(model_.names, [*model_.terms, *[residual(lag) for lag in lags]], model_.response))
        theta = np.array(fit.coef[k:])
        while not invertible(lags, theta):
            theta = theta / 2 if np.isfinite(theta).all() else np.zeros(len(lags))
        beta = np.array(fit.coef[:k])
        if const:
            beta[0] -= out["means"][-1] - beta[1:] @ out["means"][1:-1]
        if np.isfinite(beta).all():
            out |= {"beta": beta.tolist(), "theta": theta.tolist()}
    return out


# ----------------------------------------------------------------------------- rounds
def _blocks(x: DataFrame, keys: Sequence[str], design: m.Design, model_: Model, start: int, block: int) -> DataFrame:
    """(keys, block, rows): the terms and the response of each block's rows, flattened."""
    column = design.expressions()

    def value(form: dict[int, float]):
        if form == {0: 1.0}:
            return F.lit(1.0)
        out = F.lit(form.get(0, 0.0))
        for c, w in form.items():
            out = out + F.lit(w) * column[c - 1] if c else out
        return out

    rows = x.filter(F.col("_rid") >= start).select(*[quoted(c) for c in keys], ((F.col("_rid") - start) / F.lit(block)).cast("bigint").alias("block"),
                                                   F.struct("_rid", F.array(*[value(t) for t in [*model_.terms, model_.response]]).alias("v")).alias("r"))
    return rows.groupBy(*keys, "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["v"])).alias("rows"))


def _on_key(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins tables on equal keys (NULL is a key)."""
    names = {k: f"_r_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    same = F.lit(True)
    for k, name in names.items():
        same = same & left[k].eqNullSafe(right[name])
    return left.join(right, same, how).drop(*names.values())


def _states(work: DataFrame, keys: Sequence[str], k: int, lags: Sequence[int]) -> DataFrame:
    """(keys, block, past_f, past_g): each block's true states, composed from what blocks leave alone."""
    depth = max(lags)
    kept = [f for f in work.schema.fields if f.name in keys]
    left = T.StructType([*kept, *T.StructType.fromDDL("block bigint, n int, beta array<double>, theta array<double>, v_f array<double>, v_g array<double>").fields])

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                rows = np.array(r["rows"], dtype=float).reshape(-1, k + 1)
                run = Run(rows, np.array(r["means"]), np.array(r["beta"]), np.array(r["theta"]), lags, np.zeros((depth, k + 1)), np.zeros((depth, len(lags))))
                out.append({c: r[c] for c in [*keys, "block", "beta", "theta"]} | {"n": len(rows), "v_f": run.end_f.ravel(), "v_g": run.end_g.ravel()})
            yield pd.DataFrame(out, columns=left.names)

    made = T.StructType([*kept, *T.StructType.fromDDL("block bigint, past_f array<double>, past_g array<double>").fields])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        past_f, past_g, out = np.zeros((depth, k + 1)), np.zeros((depth, len(lags))), []
        power: dict[tuple, np.ndarray] = {}
        for r in pdf.sort_values("block").to_dict("records"):
            out.append({c: r[c] for c in [*keys, "block"]} | {"past_f": past_f.ravel(), "past_g": past_g.ravel()})
            theta = np.array(r["theta"])
            for j, lag in enumerate(lags):
                if (r["n"], j) not in power:
                    power[r["n"], j] = np.linalg.matrix_power(companion(lags, theta, lag), r["n"])
            past_e = past_f[:, k] - past_f[:, :k] @ np.array(r["beta"])
            fed = np.column_stack([power[r["n"], j][depth:] @ np.concatenate([past_e, past_g[:, j]]) for j in range(len(lags))])
            past_f = np.array(r["v_f"]).reshape(depth, -1) + power[r["n"], 0][:depth, :depth] @ past_f
            past_g = np.array(r["v_g"]).reshape(depth, -1) + fed
        return pd.DataFrame(out, columns=made.names)

    return work.mapInPandas(alone, left).groupBy(*keys).applyInPandas(compose, made)


def _round(blocks: DataFrame, params: DataFrame, keys: Sequence[str], k: int, lags: Sequence[int], several: bool) -> DataFrame:
    """The next parameters of all series that are not done."""
    depth = max(lags)
    live = params.filter(~F.col("done"))
    work = _on_key(blocks, live.select(*keys, "means", "beta", "theta"), keys)
    if several:
        work = _on_key(work, _states(work, keys, k, lags), [*keys, "block"])
    else:
        work = work.withColumn("past_f", F.lit(None).cast("array<double>")).withColumn("past_g", F.lit(None).cast("array<double>"))
    kept = [f for f in blocks.schema.fields if f.name in keys]
    part = T.StructType([*kept, *T.StructType.fromDDL("block bigint, n bigint, shift array<double>, r array<double>, ss double, resid array<double>").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                rows = np.array(r["rows"], dtype=float).reshape(-1, k + 1)
                past_f = np.zeros((depth, k + 1)) if r["past_f"] is None else np.array(r["past_f"]).reshape(depth, -1)
                past_g = np.zeros((depth, len(lags))) if r["past_g"] is None else np.array(r["past_g"]).reshape(depth, -1)
                b = Run(rows, np.array(r["means"]), np.array(r["beta"]), np.array(r["theta"]), lags, past_f, past_g)
                factor = Factor.of(np.column_stack([np.ones(len(rows)), b.f[:, :k], b.g, b.f[:, k]])[b.known])
                out.append({c: r[c] for c in [*keys, "block"]} | {"n": factor.n, "shift": factor.shift, "r": factor.r.ravel(), "ss": float((b.e[b.known] ** 2).sum()),
                                                                  "resid": b.end_e})
            yield pd.DataFrame(out, columns=part.names)

    joined = _on_key(work.mapInPandas(run, part), live.withColumnsRenamed({"n": "_n", "resid": "_resid"}), keys)

    def advance(pdf: pd.DataFrame) -> pd.DataFrame:
        total, ss = None, 0.0
        rows = pdf.sort_values("block").to_dict("records")
        for r in rows:
            own = Factor(int(r["n"]), np.array(r["shift"]), np.array(r["r"]).reshape(-1, len(r["shift"])))
            total, ss = own if total is None else total.merged(own), ss + r["ss"]
        last = rows[-1]
        now = {c: last[c] for c in ("means", "beta", "theta", "best", "best_ss", "halvings", "done")} | {"n": last["_n"], "resid": last["_resid"]}
        now |= {c: None if now[c] is None else np.array(now[c], dtype=float) for c in ("beta", "theta", "best")}
        made = {c: last[c] for c in keys} | _advance(now, total, ss, list(last["resid"]), lags, k)
        return pd.DataFrame([{c: made[c].tolist() if isinstance(made[c], np.ndarray) else made[c] for c in [*keys, *names]}])

    names = [f.name for f in T.StructType.fromDDL(PARAMETERS).fields]
    return params.filter("done").unionByName(joined.groupBy(*keys).applyInPandas(advance, T.StructType([*kept, *T.StructType.fromDDL(PARAMETERS).fields])))


ARMA_FIELDS = m.FIT_FIELDS + ", resid array<double>"


def fit_arma(df: DataFrame, target: str, p: int = 0, d: int = 0, q: int = 1, exog: Sequence[str] = (), trend: str | None = "c",
             order_cols: Sequence[str] | None = None, key=None, P: int = 0, D: int = 0, Q: int = 0, s: int = 0,
             block: int = BLOCK, skip: int = 0) -> DataFrame:
    """Like ``fit_ar``, with moving-average terms ``ma_i`` (and seasonal ``sma_i``) by conditional sum
    of squares: residuals before the first usable row are 0, a row with an unknown value passes the
    recurrence as 0 and does not count. ``skip`` leaves out the rows before that position, so that
    candidates compare on equal rows. ``resid`` holds the last residuals, the latest first, from which
    ``forecast_ar`` goes on."""
    lags = list(ma_lags(q, Q, s).values())
    if not lags:
        raise ValueError("a model without moving-average terms is fitted by fit_ar")
    names = list(ma_lags(q, Q, s))
    keys = keys_of(key)
    own = dict(p=p, d=d, P=P, D=D, s=s)
    design = m.Design()
    made = design.model(target, exog=exog, trend=trend, **own)
    weights = m.difference_weights(d, D, s)
    lagged = [design.form(target, weights, back) for back in range(LONG + max(lags) + 1)]
    reach, most = max(m.reach_of(**own), skip), LONG + max(lags) + max(weights)
    held, keys = keys, keys or ["_series"]
    x = m.with_lag_table(df.withColumn("_series", F.lit(0)) if not held else df, {target: max(most, m.reach_of(**own)), **{e: d + D * s for e in exog}},
                         order_cols, keys, None, None)
    k = len(made.terms)
    blocks = written(_blocks(x, keys, design, made, reach, block), "arma-blocks")
    several = (blocks.agg(F.max("block").alias("b")).first()["b"] or 0) > 0
    later = [F.col("_rid") >= reach]
    parts = partial_factors(x.filter(later[0]), keys, design.expressions())
    params = written(solve_factors(parts, keys, PARAMETERS, lambda _, factor: [_start(factor, made, lags, lagged)]), "arma")
    for _ in range(ROUNDS):
        params = written(_round(blocks, params, keys, k, lags, several), "arma")
        if not params.filter(~F.col("done")).limit(1).count():
            break

    kinds = T.StructType([*[f for f in params.schema.fields if f.name in keys], *T.StructType.fromDDL(ARMA_FIELDS).fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            rows = [_row(r, made, names, k, own) for r in batch.to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keys]
            columns += [pa.array([r[f.name] for r in rows], to_arrow_type(f.dataType)) for f in kinds.fields[len(keys):]]
            yield pa.RecordBatch.from_arrays(columns, names=kinds.names)

    out = params.mapInArrow(finish, kinds)
    return out if held else out.drop("_series")


def _row(r: dict, made: Model, ma: Sequence[str], k: int, order: dict) -> dict:
    """A row of ``ARMA_FIELDS`` from a series' last parameters."""
    n, count = r["n"], k + len(ma)
    out = {"coef_names": [*made.names, *ma], "coef": None, "n": n, "rss": None, "sigma2": None, "aic": None, "bic": None, "resid": None,
           "p": order["p"], "d": order["d"], "sp": order["P"], "sd": order["D"], "season": order["s"]}
    if r["best"] is not None and n >= max(count, 1):
        coef = list(r["best"])
        if k and made.terms[0] == {0: 1.0}:
            coef[0] += r["means"][-1] - sum(b * v for b, v in zip(coef[1:k], r["means"][1:k]))
        rss = max(r["best_ss"], 1e-300)
        out |= {"coef": coef, "rss": rss, "sigma2": rss / n, "resid": r["resid"], "aic": float(n * np.log(rss / n) + 2 * (count + 1)),
                "bic": float(n * np.log(rss / n) + (count + 1) * np.log(n))}
    return out
