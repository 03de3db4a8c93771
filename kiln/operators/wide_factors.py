"""Factor analysis with any number of categories (G15), by a randomised range finder.

The columns are those of :func:`kiln.operators.profile.famd`: standardised numbers, and indicators of
the categories over the root of their share. Here a row is kept as its few numbers and the places of
its categories. A round multiplies the covariance, which is never formed, with a block of k + 10
directions. Rounds go on until the k leading variances stand still.

Up to ``HELD`` columns, tasks sum their sparse rows' outer products, Spark adds them up by column, and
the driver orthogonalises d x (k + 10) numbers. With more, the block is a table with a row per category:
the rows are counted once by pairs of categories, a round joins the block with these counts and sums
by category, and the driver sees sums of products of directions, (k + 10) x (k + 10) numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import q
from kiln.operators.boosting import drop_scratch
from kiln.operators.order import assign_row_id, look_up
from kiln.operators.profile import standardize
from kiln.sources.files import scratch_path

#: Directions beyond those asked for; more make fewer rounds.
OVERSAMPLE = 10
#: Columns and categories whose directions the driver and every task hold; more are kept in tables.
HELD = 65_536
#: Directions of an image that are less than this share apart from the others are left out.
APART = 1e-13


@dataclass
class FactorAxes:
    """Unit axes by falling variance; ``names`` are the columns (``column=value`` for categories)."""
    names: list[str]
    pc: np.ndarray
    explainedVariance: np.ndarray  # noqa: N815 - read like a Spark model's, as shares of the total
    rounds: int


@dataclass
class StoredAxes:
    """The same with the axes in a table: ``loadings`` (place, column, axes), numbers first. ``names``
    and ``pc`` bring it to the driver when they are asked for."""
    loadings: DataFrame
    explainedVariance: np.ndarray  # noqa: N815 - as above
    rounds: int

    @cached_property
    def names(self) -> list[str]:
        return [r["column"] for r in self.loadings.orderBy("place").select("column").collect()]

    @cached_property
    def pc(self) -> np.ndarray:
        return np.array([r["axes"] for r in self.loadings.orderBy("place").select("axes").collect()])


def _numbered(df: DataFrame, cat: Sequence[str]) -> DataFrame:
    """(c, value, n, place): every category once, numbered by column and value."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), q(name).cast("string").alias("value")) for i, name in enumerate(cat)]))
    counts = df.select(cells.alias("x")).select("x.*").filter("value is not null").groupBy("c", "value").agg(F.count("*").alias("n"))
    return assign_row_id(counts, ["c", "value"], row_id="place")


def _products(rows: DataFrame, d: int, m: int, scale, block) -> DataFrame:
    """(j, v0, ..) the sums over the rows x of x (x' block) by column j; without a block, of x and x * x."""
    width = 2 if block is None else block.value.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros((d, width)), scale.value
        for b in batches:
            z, places = _parts(b, m)
            if block is None:
                total[:m] += np.stack([z.sum(axis=0), (z * z).sum(axis=0)], axis=1)
            else:
                y = _times(z, places, weight, block.value, m)
                total[:m] += z.T @ y
            for place in places:
                at = place[place >= 0]
                w = weight[at]
                own = np.stack([w, w * w], axis=1) if block is None else y[place >= 0] * w[:, None]
                np.add.at(total, m + at, own)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(total[at, i]) for i in range(width)]],
                                         names=["j", *[f"v{i}" for i in range(width)]])

    schema = ", ".join(["j int", *[f"v{i} double" for i in range(width)]])
    return rows.select("z", "places").mapInArrow(run, schema).groupBy("j").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(width)])


def _parts(b: pa.RecordBatch, m: int) -> tuple[np.ndarray, np.ndarray]:
    n = b.num_rows
    z, places = (b.column(b.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False) for c in ("z", "places"))
    return z.reshape(n, m), places.reshape(n, -1).T.astype(np.int64)


def _times(z: np.ndarray, places: np.ndarray, weight: np.ndarray, block: np.ndarray, m: int) -> np.ndarray:
    y = z @ block[:m]
    for place in places:
        on = place >= 0
        y[on] += block[m + place[on]] * weight[place[on], None]
    return y


def _dense(sums: DataFrame, d: int) -> np.ndarray:
    got = sums.toPandas()
    out = np.zeros((d, got.shape[1] - 1))
    out[got["j"].to_numpy(np.int64)] = got.drop(columns="j").to_numpy()
    return out


def _normals(place: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Normal numbers by place, whichever task makes them."""
    x = (place.astype(np.uint64)[:, None] * np.uint64(2 * width) + np.arange(2 * width, dtype=np.uint64)) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.sqrt(-2.0 * np.log(1.0 - u[:, :width])) * np.cos(2.0 * np.pi * u[:, width:])


def _cross(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """The sums over the rows of left' right."""
    shape = (len(left), len(right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            total += x[: shape[0]] @ x[shape[0]:].T
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["i", "v"])

    x = df.select(*[F.col(c).alias(f"l{i}") for i, c in enumerate(left)], *[F.col(c).alias(f"r{i}") for i, c in enumerate(right)])
    out = np.zeros(shape[0] * shape[1])
    for r in x.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out.reshape(shape)


def _turned(names: Sequence[str], turn: np.ndarray, out: str) -> list:
    """The columns times a small matrix."""
    return [sum((F.col(c) * F.lit(float(turn[i, j])) for i, c in enumerate(names)), F.lit(0.0)).alias(f"{out}{j}") for j in range(turn.shape[1])]


def _stored(rows: DataFrame, known: DataFrame, num: list[str], cat: list[str], keep: list[str], n_all: int, n: int, k: int, width: int,
            tol: float, max_rounds: int, seed: int) -> tuple[DataFrame, StoredAxes]:
    """``famd_wide`` on tables. A category's column is w = 1 / root of its share on its rows; the
    table ``block`` holds w, the sums over its column (``wc``) and over it times the numbers (``ws``),
    the pairs it is in (``deg``) and its entries of the directions (``v``)."""
    spark, m, paths = rows.sparkSession, len(num), []

    def kept(df: DataFrame, label: str) -> DataFrame:
        paths.append(scratch_path(spark, label))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    x = rows.select(*[F.col("z")[q].alias(f"z{q}") for q in range(m)],
                    *[F.when(F.col("places")[i] >= 0, F.col("places")[i].cast("long")).alias(f"p{i}") for i in range(len(cat))])
    zs, ws, size = [f"z{q}" for q in range(m)], [f"ws{q}" for q in range(m)], max(n, 1)
    ones = x.withColumn("one", F.lit(1.0)).filter(F.lit(bool(m)))
    squares = _cross(ones, [*zs, "one"], zs)
    mean = squares[m] / size
    by_place = by_pair = None
    for i in range(len(cat)):
        own = x.filter(F.col(f"p{i}").isNotNull()).groupBy(F.col(f"p{i}").alias("place")).agg(
            F.count(F.lit(1)).alias("cnt"), *[F.sum(z).alias(f"s{q}") for q, z in enumerate(zs)])
        by_place = own if by_place is None else by_place.unionByName(own)
        for j in range(i + 1, len(cat)):
            both = x.filter(F.col(f"p{i}").isNotNull() & F.col(f"p{j}").isNotNull()).groupBy(F.col(f"p{i}").alias("a"), F.col(f"p{j}").alias("b")).agg(
                F.count(F.lit(1)).alias("c"))
            by_pair = both if by_pair is None else by_pair.unionByName(both)
    if by_pair is None:
        by_pair = spark.createDataFrame([], "a long, b long, c long")
    pairs = kept(by_pair.select(F.explode(F.array(F.struct("a", "b", "c"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "c"))).alias("p")).select("p.*"),
                 "factor-pairs")
    n_pairs = pairs.count()
    w = F.sqrt(F.lit(float(n_all)) / F.col("n"))
    base = known.join(by_place, "place", "left").join(pairs.groupBy(F.col("b").alias("place")).agg(F.count(F.lit(1)).alias("deg")), "place", "left").select(
        "place", w.alias("w"), F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("deg", F.lit(0)).alias("deg"),
        (w * F.coalesce("cnt", F.lit(0))).alias("wc"), *[(w * F.coalesce(f"s{q}", F.lit(0.0))).alias(ws[q]) for q in range(m)])
    base = kept(base, "factor-categories")
    fixed, own = base.columns, F.col("wc") / size
    spread = base.agg(F.sum(F.col("w") * own - own * own)).first()[0] or 0.0
    total = float(np.trace(squares[:m]) / size - mean @ mean + spread)

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _normals(b.column(0).to_numpy(), width, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(v[:, c]) for c in range(width)]], names=[*fixed, *[f"v{c}" for c in range(width)]])

    start = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields] + [f"v{c} double" for c in range(width)])
    block = kept(base.mapInArrow(started, start), "factor-block")
    at_num = np.random.default_rng(seed).normal(size=(m, width))
    values, rounds, leading = np.zeros(min(k, width)), 0, np.eye(width)[:, : min(k, width)]
    while rounds < max_rounds:
        rounds += 1
        v, e = [f"v{c}" for c in range(width)], [f"e{c}" for c in range(width)]
        sums = _cross(block, [*v, "wc", *ws], v)
        gram = sums[:width] + at_num.T @ at_num
        through = sums[width] / size + mean @ at_num
        image_num = (squares[:m] @ at_num + sums[width + 1:]) / size - np.outer(mean, through)
        entries = block.select("place", "deg", *[(F.col("w") * F.col(c)).alias(f"u{i}") for i, c in enumerate(v)])
        met = look_up(pairs, "b", entries, "place", "deg", n_pairs, [f"u{i}" for i in range(width)])
        met = met.groupBy(F.col("a").alias("place")).agg(*[F.sum(F.col("c") * F.col(f"u{i}")).alias(f"p{i}") for i in range(width)])
        image = [((F.col("wc") * F.col(v[c]) * F.col("w") + F.col("w") * F.coalesce(f"p{c}", F.lit(0.0))
                   + sum((F.col(ws[q]) * F.lit(float(at_num[q, c])) for q in range(m)), F.lit(0.0))) / size - own * F.lit(float(through[c]))).alias(e[c])
                 for c in range(width)]
        seen = kept(block.join(met, "place", "left").select(*fixed, *v, *image), "factor-image")
        sums = _cross(seen, [*v, *e], e)
        inner, grown = sums[:width] + at_num.T @ image_num, sums[width:] + image_num.T @ image_num
        lower = np.linalg.cholesky(gram)
        inner = np.linalg.solve(lower, np.linalg.solve(lower, (inner + inner.T) / 2).T)
        found, turn = np.linalg.eigh((inner + inner.T) / 2)
        turn, order = np.linalg.solve(lower.T, turn), np.argsort(-found)
        before, values = values, found[order[: len(values)]]
        leading = turn[:, order[: len(values)]]
        grown = turn.T @ grown @ turn
        long = np.sqrt(np.maximum(np.diag(grown), 0.0))
        some = long > APART * long.max(initial=0.0)
        shares, sides = np.linalg.eigh(grown[np.ix_(some, some)] / np.outer(long[some], long[some]))
        apart = shares > APART
        if rounds == max_rounds or np.abs(values - before).max(initial=0.0) <= tol * max(total, 1e-300) or apart.sum() < len(values) or width == m + known.count():
            break
        step = (turn[:, some] / long[some]) @ (sides[:, apart] / np.sqrt(shares[apart]))
        width = step.shape[1]
        at_num = image_num @ step
        later = kept(seen.select(*fixed, *_turned(e, step, "v")), "factor-block")
        drop_scratch(spark, paths.pop(-3))
        drop_scratch(spark, paths.pop(-2))
        block = later
    k = len(values)
    axes_num = at_num @ leading
    axes = kept(block.select("place", "w", "cnt", *_turned([f"v{c}" for c in range(width)], leading, "a")), "factor-axes")
    for path in paths[:-1]:
        drop_scratch(spark, path)
    tops = axes.agg(*[F.max(F.struct(F.abs(f"a{c}").alias("size"), (-F.col("place")).alias("first"), F.col(f"a{c}").alias("a"))).alias(f"t{c}") for c in range(k)],
                    *[F.sum(F.col(f"a{c}") / F.col("w")).alias(f"c{c}") for c in range(k)]).first()
    sign, centre = np.ones(k), np.zeros(k)
    for c in range(k):
        at = np.abs(axes_num[:, c]).argmax() if m else -1
        top = axes_num[at, c] if m and (tops[f"t{c}"] is None or abs(axes_num[at, c]) >= tops[f"t{c}"]["size"]) else tops[f"t{c}"]["a"]
        sign[c] = -1.0 if top < 0 else 1.0
        centre[c] = sign[c] * (tops[f"c{c}"] or 0.0)
    axes_num = axes_num * sign
    signed = axes.select("place", "cnt", *[(F.col(f"a{c}") * float(sign[c])).alias(f"a{c}") for c in range(k)], *[(F.col(f"a{c}") * F.col("w") * float(sign[c])).alias(f"u{c}") for c in range(k)])
    numbers = spark.createDataFrame([(i, c, axes_num[i].tolist()) for i, c in enumerate(num)], "place long, column string, axes array<double>")
    title = F.concat(F.element_at(F.array(*[F.lit(c) for c in cat]), F.col("c") + 1), F.lit("="), F.col("value"))
    loadings = numbers.unionByName(known.select("place", title.alias("column")).join(signed, "place").select(
        (F.col("place") + m).alias("place"), "column", F.array(*[F.col(f"a{c}") for c in range(k)]).alias("axes")))
    y = [F.lit(-centre[c]) + sum((F.col("z")[q] * F.lit(float(axes_num[q, c])) for q in range(m)), F.lit(0.0)) for c in range(k)]
    out = rows.select(*[f"k{i}" for i in range(len(keep))], *[y[c].alias(f"y{c}") for c in range(k)],
                      *[F.when(F.col("places")[i] >= 0, F.col("places")[i].cast("long")).alias(f"p{i}") for i in range(len(cat))])
    for i in range(len(cat)):
        out = look_up(out, f"p{i}", signed, "place", "cnt", n, [f"u{c}" for c in range(k)]).select(
            *[c for c in out.columns if not c.startswith("y")], *[(F.col(f"y{c}") + F.coalesce(f"u{c}", F.lit(0.0))).alias(f"y{c}") for c in range(k)])
    made = StoredAxes(loadings, np.maximum(values, 0.0) / total if total > 0 else values * 0.0, rounds)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.array(*[F.col(f"y{c}") for c in range(k)]).alias("coords")), made


def famd_wide(df: DataFrame, num: Sequence[str], cat: Sequence[str], k: int = 2, keep: Sequence[str] = (), tol: float = 1e-10,
              max_rounds: int = 50, seed: int = 42, held: int = HELD) -> tuple[DataFrame, FactorAxes | StoredAxes]:
    """(row coordinates, axes). Rows with a missing number are left out; a missing category has no
    indicator. Each axis points to the side of its largest entry. Up to ``held`` columns and
    categories, the driver and every task hold k + 10 numbers for each; with more, tables do."""
    spark, num, cat, keep = df.sparkSession, list(num), list(cat), list(keep)
    n_all, m = df.count(), len(num)
    dictionary = scratch_path(spark, "factor-categories")
    _numbered(df, cat).write.parquet(dictionary)
    known = spark.read.parquet(dictionary)
    d = m + known.count()
    z = standardize(df, num) if num else df
    x = z.select(*[q(c).alias(f"k{i}") for i, c in enumerate(keep)], F.array(*[q(c).cast("double") for c in num]).cast("array<double>").alias("z"),
                 *[q(c).cast("string").alias(f"_c{i}") for i, c in enumerate(cat)]).filter(~F.exists("z", lambda v: v.isNull() | F.isnan(v)))
    for i in range(len(cat)):
        x = look_up(x, f"_c{i}", known.filter(F.col("c") == i).withColumnRenamed("place", f"_p{i}"), "value", "n", n_all, [f"_p{i}"])
    path = scratch_path(spark, "factor-rows")
    places = F.array(*[F.coalesce(f"_p{i}", F.lit(-1)) for i in range(len(cat))]).cast("array<int>")
    x.select(*[f"k{i}" for i in range(len(keep))], "z", places.alias("places")).write.parquet(path)
    rows = spark.read.parquet(path)
    n = rows.count()
    if d > held:
        return _stored(rows, known, num, cat, keep, n_all, n, k, min(d, k + OVERSAMPLE), tol, max_rounds, seed)
    table = known.select("c", "value", "n", "place").orderBy("place").toPandas()
    share = table["n"].to_numpy(float) / max(n_all, 1)
    names = num + [f"{cat[c]}={v}" for c, v in zip(table["c"], table["value"])]
    scale = spark.sparkContext.broadcast(1.0 / np.sqrt(share))
    first = _dense(_products(rows, d, m, scale, None), d) / max(n, 1)
    mean = first[:, 0]
    total = float((first[:, 1] - mean * mean).sum())
    width = min(d, k + OVERSAMPLE)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    values, rounds = np.zeros(min(k, width)), 0
    while rounds < max_rounds and n:
        rounds += 1
        sent = spark.sparkContext.broadcast(basis)
        image = _dense(_products(rows, d, m, scale, sent), d) / n - np.outer(mean, mean @ basis)
        sent.unpersist()
        inner = basis.T @ image
        found, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-found)
        before, values = values, found[order[: len(values)]]
        axes = basis @ turn[:, order[: len(values)]]
        if width == d or np.abs(values - before).max(initial=0.0) <= tol * max(total, 1e-300):
            break
        basis = np.linalg.qr(image)[0]
    if not n:
        axes = basis[:, : len(values)]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    made = FactorAxes(names, axes, np.maximum(values, 0.0) / total if total > 0 else values * 0.0, rounds)
    centre = np.concatenate([np.zeros(m), np.sqrt(share)]) @ axes
    last = spark.sparkContext.broadcast(axes)
    out = rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.array().cast("array<double>").alias("coords")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _times(*_parts(b, m), scale.value, last.value, m) - centre
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(list(y), pa.list_(pa.float64()))], names=[*keep, "coords"])

    drop_scratch(spark, dictionary)
    return rows.mapInArrow(run, out), made
