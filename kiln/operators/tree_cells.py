"""Spark's boosted classifiers on tables of many rows (M3): trained on counted cells, scored by region.

Spark's trees see a continuous feature only as the bin between two split candidates, and rows with equal
bins and labels have equal residuals in every round. Such rows are one cell, and a cell with its number
of rows as weight adds to a node what they add. ``counted`` turns the rows into cells in one aggregate, so
that the rounds and levels of a fit read cells: at most bins^features per label, whatever the number of rows.

The candidates are those of Spark's trees: the same draw of max(bins^2, 10,000) rows and the same rule
(``split_points``); every row counts in every split. The fit on cells has to take the bins as they are,
so its features are the numbers of the bins and it may hold as many bins as keep it from drawing cells
(``bins_for``). A ``Bucketizer`` before the assembler makes the numbers of raw rows at scoring.
Sums differ by rounding only: a node whose rows all have one residual, which Spark may split by
rounding errors into sides of equal value, may stay whole.

``predicted`` scores a one-vs-rest model by the regions between the thresholds of its trees.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, OneVsRestModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.exprs import q

#: Bins of a feature (Spark's ``maxBins``), and the least number of rows that its candidates are drawn from.
BINS = 32
DRAWN_ROWS = 10_000
#: Cells are used for more rows than this, where their largest possible number is at most this share of the rows.
CELL_ROWS = 1_000_000
CELL_SHARE = 0.5
#: Nodes and regions of a model that is scored by region.
SCORED_NODES = 5_000
REGIONS = 1 << 18
WEIGHT = "_rows"


def countable(df: DataFrame, features: Sequence[str]) -> bool:
    """Numbers only: vectors have no column per feature."""
    return len(set(features)) == len(features) and all(isinstance(df.schema[c].dataType, T.NumericType) for c in features)


def flawed(features: Sequence[str]) -> Column:
    """Whether a feature is missing or infinite, an error of Spark's trees."""
    out = F.lit(False)
    for c in features:
        x = q(c).cast("double")
        out = out | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return out


def drawn(df: DataFrame, features: Sequence[str], n: int, seed: int) -> tuple[np.ndarray, float]:
    """The rows that Spark's trees draw their candidates from, with the share drawn."""
    spark, most = df.sparkSession, max(min(BINS, n) ** 2, DRAWN_ROWS)
    share = most / n if most < n else 1.0
    x = df.select(*[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    picked = x._jdf.toJavaRDD().sample(False, share, draw)
    rows = DataFrame(spark._jsparkSession.createDataFrame(picked, x._jdf.schema()), spark).toPandas()
    return rows.to_numpy(np.float64).reshape(-1, len(features)), share


def split_points(values: np.ndarray, n: int, share: float, bins: int) -> list[float]:
    """The thresholds of a feature by the rule of Spark's trees: those between all its values, or those
    nearest to equal shares of the rows. Zeros count as the rows expected beyond the other values."""
    value, rows = np.unique(values[values != 0], return_counts=True)
    if not len(value):
        return []
    weight, expected = rows.astype(float), share * n
    if expected - weight.sum() > np.finfo(float).eps * rows.sum() * 100:
        at = int(np.searchsorted(value, 0.0))
        value, weight = np.insert(value, at, 0.0), np.insert(weight, at, expected - weight.sum())
    if len(value) <= bins:
        return [float(a + b) / 2.0 for a, b in zip(value[:-1], value[1:])]
    out, stride, seen = [], expected / bins, float(weight[0])
    target = stride
    for i in range(1, len(value)):
        before, seen = seen, seen + float(weight[i])
        if abs(before - target) < abs(seen - target):
            out.append(float(value[i - 1] + value[i]) / 2.0)
            target += stride
    return out


def bucketizer(features: Sequence[str], cuts: Sequence[Sequence[float]], out: Sequence[str]) -> Bucketizer:
    """Bin numbers of raw rows, the value of a threshold being the last of its bin. A feature without
    thresholds has one bin (the second begins at the largest double, and no tree asks for it)."""
    begins = [[np.nextafter(t, np.inf) for t in cut] or [float(np.finfo(float).max)] for cut in cuts]
    return Bucketizer(inputCols=list(features), outputCols=list(out), handleInvalid="keep",
                      splitsArray=[[-float("inf"), *map(float, b), float("inf")] for b in begins])


def _placed(df: DataFrame, features: Sequence[str], cuts: Sequence[Sequence[float]], kind: str) -> tuple[DataFrame, Column]:
    """The rows with their bins, and the number of their combination of bins. NULL and NaN are above all."""
    asked, place = [i for i, cut in enumerate(cuts) if cut], F.lit(0).cast(kind)
    if asked:
        df = bucketizer([features[i] for i in asked], [cuts[i] for i in asked], [f"__bin{i}" for i in asked]).transform(df)
    for i in asked:
        place = place * (len(cuts[i]) + 1) + F.least(F.col(f"__bin{i}"), F.lit(float(len(cuts[i])))).cast(kind)
    return df, place


@dataclass
class Cells:
    """(features as bin numbers, label, rows) and the raw thresholds between the bins of each feature."""
    table: DataFrame
    cuts: list[list[float]]
    n: int


def most_cells(cuts: Sequence[Sequence[float]], classes: int) -> int:
    """With one more label for NULL."""
    return math.prod(len(c) + 1 for c in cuts) * (classes + 1)


def counted(df: DataFrame, features: Sequence[str], label: str, cuts: Sequence[Sequence[float]], out: str) -> Cells:
    """The cells of the rows, cached: ``table`` is to be unpersisted after use. Bins without rows are
    left out, so the bins of each feature are numbered 0, 1, 2... as the fit's own candidates need it."""
    sizes = [len(c) + 1 for c in cuts]
    x, place = _placed(df, features, cuts, "long")
    cells = x.select(place.alias("_cell"), q(label).alias(label)).groupBy("_cell", label).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT))
    after = [math.prod(sizes[i + 1:]) for i in range(len(sizes))]
    bins = [F.pmod(F.expr(f"_cell div {a}"), F.lit(s)) for a, s in zip(after, sizes)]
    cells = cells.select(*[b.cast("int").alias(f"_b{i}") for i, b in enumerate(bins)], label, WEIGHT).persist()
    row = cells.agg(F.count(F.lit(1)).alias("n"), *[F.sort_array(F.collect_set(f"_b{i}")).alias(f"_b{i}") for i in range(len(cuts))]).first()
    used = [list(row[f"_b{i}"]) for i in range(len(cuts))]
    numbers = [F.element_at(F.array(*[F.lit(float(u.index(b)) if b in u else -1.0) for b in range(s)]), F.col(f"_b{i}") + 1)
               for i, (u, s) in enumerate(zip(used, sizes))]
    table = cells.select(*[x.alias(f"_b{i}") for i, x in enumerate(numbers)], label, WEIGHT)
    made = VectorAssembler(inputCols=[f"_b{i}" for i in range(len(cuts))], outputCol=out).transform(table).select(out, label, WEIGHT).persist()
    made.count()
    cells.unpersist()
    return Cells(made, [[cut[b] for b in u[:-1]] for cut, u in zip(cuts, used)], row["n"])


def bins_for(cells: int) -> int:
    """``maxBins`` with which Spark's trees read all cells for the candidates."""
    return max(BINS, math.isqrt(cells) + 1)


# ----------------------------------------------------------------------------- scoring
def _nodes(node, out: list, cut_of) -> int:
    """Adds (feature, threshold, left, right, value) of the nodes below and returns the node's place."""
    at = len(out)
    out.append(None)
    if node.subtreeDepth() == 0:
        out[at] = (-1, 0.0, at, at, float(node.prediction()))
    else:
        split = node.split()
        feature = split.featureIndex()
        out[at] = (feature, cut_of(feature, split.threshold()), _nodes(node.leftChild(), out, cut_of), _nodes(node.rightChild(), out, cut_of), 0.0)
    return at


def _values(tree: list, codes: np.ndarray, cuts: Sequence[Sequence[float]]) -> np.ndarray:
    """The tree's value in every region."""
    feature, left, right = (np.array([n[i] for n in tree]) for i in (0, 2, 3))
    last = np.array([cuts[n[0]].index(n[1]) if n[0] >= 0 else 0 for n in tree])
    at = np.zeros(len(codes), np.int64)
    while (feature[at] >= 0).any():
        inner = feature[at] >= 0
        goes_left = codes[np.arange(len(codes)), np.maximum(feature[at], 0)] <= last[at]
        at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
    return np.array([n[4] for n in tree])[at]


def predicted(model: PipelineModel, df: DataFrame, keep: Sequence[Column]) -> DataFrame | None:
    """The columns ``keep`` with the ``prediction`` of boosted trees in one-vs-rest. The thresholds of
    all trees cut the features into regions of one prediction each, which is looked up by the region's
    number. None for other models, and where there are more than ``REGIONS``."""
    stages = model.stages
    if not (isinstance(stages[-1], OneVsRestModel) and all(isinstance(m, GBTClassificationModel) for m in stages[-1].models)):
        return None
    kinds = [type(s) for s in stages[:-1]]
    if kinds not in ([VectorAssembler], [Bucketizer, VectorAssembler]) or stages[-2].getHandleInvalid() != "keep":
        return None
    names = stages[0].getInputCols()
    if not countable(df, names) or sum(m.totalNumNodes for m in stages[-1].models) > SCORED_NODES:
        return None
    if kinds[0] is Bucketizer:
        begins = stages[0].getSplitsArray()
        cut_of = lambda i, t: float(np.nextafter(begins[i][int(t) + 1], -np.inf))
    else:
        cut_of = lambda i, t: float(t)
    forests = []
    for m in stages[-1].models:
        forest = []
        for t in m.trees:
            forest.append([])
            _nodes(t._call_java("rootNode"), forest[-1], cut_of)
        forests.append(forest)
    cuts = [sorted({n[1] for forest in forests for tree in forest for n in tree if n[0] == i}) for i in range(len(names))]
    sizes = [len(c) + 1 for c in cuts]
    if math.prod(sizes) > REGIONS:
        return None
    codes = np.stack(np.unravel_index(np.arange(math.prod(sizes)), sizes), axis=1)
    margins = [sum(w * _values(tree, codes, cuts) for tree, w in zip(forest, m.treeWeights)) for forest, m in zip(forests, stages[-1].models)]
    best = np.argmax(np.stack(margins, axis=1), axis=1)  # the first of equal ones
    x, region = _placed(df, names, cuts, "int")
    return x.select(*keep, F.get(F.from_json(F.lit(f"[{','.join(map(str, best))}]"), "array<double>"), region).alias("prediction"))
