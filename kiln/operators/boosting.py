"""Gradient-boosted classification trees as rounds of DataFrame aggregates (M3).

Features are cut into bins once and the codes are stored with the label and the margins of every
row. A round grows one tree per class, level by level, and a level is one job: every task routes its
rows through the trees so far and sums gradients and hessians by (tree, node, feature, bin); Spark
adds these up and picks each node's best split, so the driver sees one row per node, whatever the
number of rows or tasks. Gradients are summed as integers in units of 2^-24: a sum does not depend
on the order of its rows, and so neither does a split.

Two classes have one tree a round (logistic loss), more have one per class (softmax). Leaves are
-rate * G / (H + 1); a child needs a hessian of 1 or more. Missing values (NULL, NaN) go to the side
with the larger gain. With rows marked for validation, training ends ``patience`` rounds after their
loss was best, and the model keeps the rounds up to the best.

A task holds trees x nodes x features x bins sums. Margins are stored anew every ``REFRESH`` rounds,
so a level evaluates at most that many rounds per row.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.functions.exprs import q
from kiln.sources.files import scratch_path

#: Gradients are whole numbers of 1 / UNIT.
UNIT = float(1 << 24)
#: Rounds between two stored sets of margins.
REFRESH = 10
#: Added to the hessian of a leaf, and the least hessian of a child.
LAMBDA = 1.0
MIN_CHILD = 1.0
#: A split has to gain more than this.
MIN_GAIN = 1e-6
MISSING = 0


@dataclass
class Tree:
    """Nodes by number: the children of i are 2i + 1 and 2i + 2. A row goes left where its code is
    ``code`` or less; ``feature`` -1 marks a leaf."""
    group: int
    feature: np.ndarray
    code: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(group: int, depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(group, np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def route(self, codes: np.ndarray) -> np.ndarray:
        """The node every row ends in."""
        node = np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            c = codes[rows, np.maximum(f, 0)]
            left = np.where(c == MISSING, self.missing_left[node], c <= self.code[node])
            node = np.where(inner, 2 * node + 2 - left, node)


def encode(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin codes of rows: 0 is missing, b is a value in (cut b-2, cut b-1]."""
    out = np.empty((len(columns[0]) if columns else 0, len(cuts)), dtype="<u2")
    for i, (x, cut) in enumerate(zip(columns, cuts)):
        out[:, i] = np.where(np.isnan(x), MISSING, np.searchsorted(cut, x) + 1)
    return out


def add_margins(margins: np.ndarray, codes: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    for t in trees:
        margins[:, t.group] += t.value[t.route(codes)]
    return margins


def probabilities(margins: np.ndarray) -> np.ndarray:
    """One column of margins is the log odds of class 1; more are softmax scores."""
    if margins.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-np.clip(margins[:, 0], -700, 700)))
        return np.column_stack([1.0 - p, p])
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the log loss by row and tree, in whole units."""
    p = probabilities(margins)
    if margins.shape[1] == 1:
        p = p[:, 1:]
        g, h = p - label[:, None], p * (1.0 - p)
    else:
        g, h = p - (np.arange(p.shape[1])[None, :] == label[:, None]), 2.0 * p * (1.0 - p)
    return np.rint(g * UNIT), np.rint(np.maximum(h, 1.0 / UNIT) * UNIT)


def _drawn(rid: np.ndarray, seed: int, share: float) -> np.ndarray:
    """The rows of a round's sample, by a hash of their number."""
    x = rid.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(int(share * (1 << 64)), (1 << 64) - 1))


@dataclass
class BoostedTrees:
    """A fitted model. ``transform`` adds ``probability`` (array) and ``prediction``."""
    features: list[str]
    cuts: list[np.ndarray]
    n_classes: int
    trees: list[Tree] = field(default_factory=list)
    n_rounds: int = 0
    losses: list[float] = field(default_factory=list)  # of the validation rows, before each round

    @property
    def groups(self) -> int:
        return 1 if self.n_classes <= 2 else self.n_classes

    def transform(self, df: DataFrame) -> DataFrame:
        cuts, trees, groups = self.cuts, self.trees, self.groups

        @F.pandas_udf("array<double>")
        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for x in batches:
                codes = encode([x[c].to_numpy(np.float64, na_value=np.nan) for c in x.columns], cuts)
                yield pd.Series(list(probabilities(add_margins(np.zeros((len(x), groups)), codes, trees))))

        row = F.struct(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(self.features)])
        out = df.withColumn("probability", scored(row))
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

    def importances(self) -> list[float]:
        """Gain of every feature's splits, as shares."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            np.add.at(total, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        return (total / total.sum() if total.sum() else total).tolist()

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "cuts": [c.tolist() for c in self.cuts], "n_classes": self.n_classes,
                           "n_rounds": self.n_rounds, "losses": self.losses,
                           "trees": [{k: v if k == "group" else v.tolist() for k, v in vars(t).items()} for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> BoostedTrees:
        d = json.loads(text)
        kinds = {"feature": np.int64, "code": np.int64, "missing_left": bool, "value": float, "gain": float}
        trees = [Tree(t["group"], **{k: np.array(t[k], dtype=kind) for k, kind in kinds.items()}) for t in d["trees"]]
        return BoostedTrees(d["features"], [np.array(c, dtype=float) for c in d["cuts"]], d["n_classes"], trees, d["n_rounds"], d["losses"])


def bin_cuts(df: DataFrame, features: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Upper edges of every feature's bins: its quantiles, all features in one aggregate."""
    known = [F.when(~F.isnan(q(c).cast("double")), q(c).cast("double")) for c in features]
    steps = [i / max_bins for i in range(1, max_bins + 1)]
    row = df.agg(*[F.percentile_approx(c, steps).alias(f"c{i}") for i, c in enumerate(known)]).first()
    return [np.unique(np.array(r or [], dtype=float))[:-1] for r in row]


def _coded(df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray], label: str, val: str | None, groups: int) -> DataFrame:
    x = df.filter(q(label).isNotNull()).select(
        q(label).cast("int").alias("label"), (F.coalesce(q(val).cast("boolean"), F.lit(False)) if val else F.lit(False)).alias("val"),
        F.monotonically_increasing_id().alias("rid"), *[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = encode([b.column(3 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(cuts))], cuts)
            zero = pa.array([[0.0] * groups] * b.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in codes], pa.binary()), zero],
                                             names=["label", "val", "rid", "codes", "margin"])

    return x.mapInArrow(run, _ROWS)


_ROWS = "label int, val boolean, rid long, codes binary, margin array<double>"
_SUMS = "tree int, node int, feature int, code int, g long, h long"


def _unpacked(b: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u2").reshape(b.num_rows, n_features).astype(np.int64)
    return codes, b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).copy()


def _refreshed(rows: DataFrame, trees: Sequence[Tree], n_features: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, margin = _unpacked(b, n_features)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(list(add_margins(margin, codes, trees)), pa.list_(pa.float64()))],
                                                 names=b.schema.names)

    return rows.mapInArrow(run, _ROWS)


def _sums(rows: DataFrame, done: Sequence[Tree], growing: Sequence[Tree], wanted: Sequence[Sequence[int]], allowed: Sequence[Sequence[int]],
          bins: int, n_features: int, share: float, seed: int, with_loss: bool) -> DataFrame:
    """Per task: gradients and hessians by (tree, node, feature, code) of the nodes ``wanted`` of
    each tree, and the validation rows' loss as tree -1."""
    size = max((len(t.feature) for t in growing), default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2, len(w) * len(a) * bins), np.int64) for w, a in zip(wanted, allowed)]
        loss, n_val = 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            codes, margin = _unpacked(b, n_features)
            label = b.column(0).to_numpy(zero_copy_only=False)
            val = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            add_margins(margin, codes, done)
            if with_loss and val.any():
                p = probabilities(margin[val])[np.arange(int(val.sum())), label[val]]
                loss += int(np.rint(-np.log(np.maximum(p, 1e-15)) * UNIT).sum())
                n_val += int(val.sum())
            use = ~val
            if share < 1.0:
                use &= _drawn(b.column(2).to_numpy(), seed, share)
            codes, label = codes[use], label[use]
            g, h = gradients(margin[use], label)
            for i, t in enumerate(growing):
                place = np.full(size, -1, np.int64)
                place[np.asarray(wanted[i], np.int64)] = np.arange(len(wanted[i]))
                at = place[t.route(codes)]
                here, f = at >= 0, np.asarray(allowed[i], np.int64)
                if not here.any():
                    continue
                cell = ((at[here, None] * len(f) + np.arange(len(f))[None, :]) * bins + codes[here][:, f]).ravel()
                for k, w in enumerate((g, h)):
                    # whole numbers below 2^53 within a batch, so the float sums are exact
                    held[i][k] += np.bincount(cell, np.repeat(w[here, t.group], len(f)), minlength=held[i].shape[1]).astype(np.int64)
        for i, sums in enumerate(held):
            at = np.flatnonzero(sums[1])
            f = np.asarray(allowed[i], np.int64)
            node = np.asarray(wanted[i], np.int64)[at // (bins * len(f))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), i, np.int32)), pa.array(node.astype(np.int32)), pa.array(f[at // bins % len(f)].astype(np.int32)),
                 pa.array((at % bins).astype(np.int32)), pa.array(sums[0][at]), pa.array(sums[1][at])], names=_NAMES)
        if n_val:
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((-1, 0, -1, 1, loss, n_val), [pa.int32()] * 4 + [pa.int64()] * 2)], names=_NAMES)

    return rows.mapInArrow(run, _SUMS)


_NAMES = [c.split()[0] for c in _SUMS.split(", ")]


def best_splits(sums: DataFrame) -> DataFrame:
    """(tree, node, g, h, best) with the best split of each node, whose ``gain`` is -1 where none is
    allowed. Ties go to the smaller feature, then the smaller code, then to missing values right."""
    w = Window.partitionBy("tree", "node", "feature")
    upto = w.orderBy("code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = sums.repartition("tree", "node", "feature").groupBy("tree", "node", "feature", "code").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"))
    known = lambda c: F.when(F.col("code") != MISSING, F.col(c)).otherwise(0)
    absent = lambda c: F.when(F.col("code") == MISSING, F.col(c)).otherwise(0)
    x = x.select("tree", "node", "feature", "code",
                 *[(F.sum(c).over(w) / UNIT).alias(f"t{c}") for c in "gh"],
                 *[F.sum(known(c)).over(upto).alias(f"l{c}") for c in "gh"], *[F.sum(absent(c)).over(w).alias(f"m{c}") for c in "gh"])

    def split(missing_left: bool):
        gl, hl = ((F.col(f"l{c}") + (F.col(f"m{c}") if missing_left else 0)) / UNIT for c in "gh")
        gr, hr = F.col("tg") - gl, F.col("th") - hl
        gain = gl * gl / (hl + LAMBDA) + gr * gr / (hr + LAMBDA) - F.col("tg") * F.col("tg") / (F.col("th") + LAMBDA)
        fits = (F.col("code") != MISSING) & (hl >= MIN_CHILD) & (hr >= MIN_CHILD) & (gain > MIN_GAIN)
        return F.struct(F.when(fits, gain).otherwise(-1.0).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("code")).alias("c"),
                        F.lit(not missing_left).alias("right"), gl.alias("gl"), hl.alias("hl"))

    return x.groupBy("tree", "node").agg(F.max("tg").alias("g"), F.max("th").alias("h"), F.max(F.greatest(split(False), split(True))).alias("best"))


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Removes a scratch table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, learning_rate: float = 0.1, n_trees: int = 100, max_depth: int = 3,
                subsample: float = 1.0, colsample: float = 1.0, validation_col: str | None = None, patience: int = 10, max_bins: int = 256,
                seed: int = 42) -> BoostedTrees:
    """Boosted trees for labels 0..k-1; rows without a label take no part. ``subsample`` draws rows
    per round, ``colsample`` features per tree."""
    spark, features = df.sparkSession, list(features)
    seen = df.agg(F.max(q(label).cast("int")).alias("top"), F.min(q(label).cast("int")).alias("low")).first()
    if seen["low"] is not None and seen["low"] < 0:
        raise ValueError("labels are numbers from 0")
    k = max((seen["top"] or 0) + 1, 2)
    training = df.filter(~F.coalesce(q(validation_col).cast("boolean"), F.lit(False))) if validation_col else df
    made = BoostedTrees(features, bin_cuts(training, features, max_bins), k)
    bins, d, groups = max((len(c) for c in made.cuts), default=0) + 2, len(features), made.groups
    path = scratch_path(spark, "boosting")
    _coded(df, features, made.cuts, label, validation_col, groups).write.parquet(path)
    rows, stored_at, rng = spark.read.schema(_ROWS).parquet(path), 0, random.Random(seed)
    rounds: list[list[Tree]] = []
    best = (float("inf"), 0)

    def judged(loss) -> bool:
        """Takes in the loss after the rounds so far; True where training is over."""
        nonlocal best
        if loss is None:
            return False
        made.losses.append(loss["g"] / (loss["h"] * UNIT))
        if made.losses[-1] < best[0]:
            best = (made.losses[-1], len(rounds))
        return len(rounds) - best[1] >= patience

    for r in range(n_trees):
        if len(rounds) - stored_at == REFRESH:
            later = scratch_path(spark, "boosting")
            _refreshed(rows, sum(rounds[stored_at:], []), d).write.parquet(later)
            drop_scratch(spark, path)
            path, rows, stored_at = later, spark.read.schema(_ROWS).parquet(later), len(rounds)
        done = sum(rounds[stored_at:], [])
        growing = [Tree.empty(i, max_depth) for i in range(groups)]
        allowed = [sorted(rng.sample(range(d), max(1, int(colsample * d)))) for _ in growing]
        wanted = [[0] for _ in growing]
        over = False
        for level in range(max_depth):
            sums = _sums(rows, done, growing, wanted, allowed, bins, d, subsample, seed + r, validation_col is not None and level == 0)
            found = {(x["tree"], x["node"]): x for x in best_splits(sums).collect()}
            if level == 0:
                over = judged(found.pop((-1, 0), None))
                if over:
                    break
            nexts: list[list[int]] = [[] for _ in growing]
            for (i, node), x in sorted((key, x) for key, x in found.items()):
                t, b = growing[i], x["best"]
                t.value[node] = -learning_rate * x["g"] / (x["h"] + LAMBDA)
                if b["gain"] < 0:
                    continue
                t.feature[node], t.code[node], t.missing_left[node], t.gain[node] = -b["f"], -b["c"], not b["right"], b["gain"]
                for child, g, h in ((2 * node + 1, b["gl"], b["hl"]), (2 * node + 2, x["g"] - b["gl"], x["h"] - b["hl"])):
                    t.value[child] = -learning_rate * g / (h + LAMBDA)
                    nexts[i].append(child)
            wanted = nexts
            if not any(wanted):
                break
        if over:
            break
        rounds.append(growing)
    else:
        if validation_col:
            last = _sums(rows, sum(rounds[stored_at:], []), [], [], [], bins, d, 1.0, seed, True)
            judged({(x["tree"], x["node"]): x for x in best_splits(last).collect()}.get((-1, 0)))
    drop_scratch(spark, path)
    made.n_rounds = best[1] if made.losses else len(rounds)
    made.trees = sum(rounds[: made.n_rounds], [])
    return made
