"""Exact linear-interpolation quantiles (pandas ``quantile`` / DuckDB ``quantile_cont``)
without holding a whole column in one task.

Pass 1: ``percentile_approx`` brackets every wanted order statistic (rank error of the
sketch is at most n/accuracy, so probabilities p +- slack enclose it). Pass 2 counts rows by
value inside the brackets and by side outside them, in one aggregate that combines before the
shuffle: a value that a third of the rows share is one row with a count. A running sum of the
counts then finds the values at the wanted ranks. A bracket holds at most about
``8 n / accuracy`` distinct values; groups where that is too much for one window, and requests
for many probabilities, take the sort-based path with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.order import assign_row_id, join_small, keys_of
from kiln.session import ensure_checkpoint_dir

DEFAULT_ACCURACY = 10_000
# Largest group the bracket path serves: at most about 8 n / accuracy distinct values
# (1e5 here) stand in one window. Bigger groups take the sort-based path, equally exact.
BRACKET_MAX_ROWS = 125_000_000
# Above this many probabilities one distributed sort beats per-probability brackets.
SORT_THRESHOLD = 16


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by=None,
                    accuracy: int = DEFAULT_ACCURACY, method: str = "exact",
                    prefix: str = "q") -> DataFrame:
    """One row per group (or one row): ``n`` (non-null count) and ``{prefix}{i}`` for
    each probability, NULL where the group has no value. ``method``: ``exact`` (bracket),
    ``approx`` (percentile_approx only) or ``builtin`` (Spark ``percentile``; fine for
    small groups)."""
    keys = keys_of(by)
    x = df.select(*[F.col(k) for k in keys], F.col(col).cast("double").alias("_x"))
    x = x.filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    probs = [float(p) for p in probs]
    outs = [f"{prefix}{i}" for i in range(len(probs))]
    if method == "builtin":
        agg = x.groupBy(*keys).agg(F.count("_x").alias("n"),
                                   F.percentile("_x", F.array(*[F.lit(p) for p in probs])).alias("_p"))
        return agg.select(*keys, "n", *[F.col("_p")[i].alias(o) for i, o in enumerate(outs)])
    if method == "approx":
        agg = x.groupBy(*keys).agg(F.count("_x").alias("n"),
                                   F.percentile_approx("_x", [*probs], accuracy).alias("_p"))
        return agg.select(*keys, "n", *[F.col("_p")[i].alias(o) for i, o in enumerate(outs)])
    if method == "sort" or len(probs) > SORT_THRESHOLD:
        return _by_position(x, keys, probs, outs)
    return _bracketed(x, keys, probs, outs, accuracy)


def _by_position(x: DataFrame, keys, probs, outs) -> DataFrame:
    """Exact order statistics from row positions: one range-partitioned sort, then only
    the rows at the needed positions (two per probability) are kept and pivoted."""
    ranked = assign_row_id(x, ["_x"], key=keys, row_id="_pos", with_count="_n")
    # wanted positions as a small table (2 per probability per key), joined to the ranks
    counts = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    pos = F.explode(F.array_distinct(F.array(*[(F.floor(F.lit(p) * (F.col("_n") - 1)) + d).cast("bigint")
                                               for p in probs for d in (0, 1)])))
    wanted = counts.select(*keys, pos.alias("_pos"))
    picked = join_small(ranked, wanted, [*keys, "_pos"])
    m = picked.groupBy(*keys).agg(F.first("_n").alias("n"),
                                  F.map_from_entries(F.collect_list(F.struct("_pos", "_x"))).alias("_m"))
    cols = []
    for i, p in enumerate(probs):
        h = F.lit(p) * (F.col("n") - 1)
        lo = F.floor(h)
        frac = h - lo
        v0 = F.element_at(F.col("_m"), lo)
        v1 = F.coalesce(F.element_at(F.col("_m"), lo + 1), v0)
        cols.append((v0 + (v1 - v0) * frac).alias(outs[i]))
    return m.select(*keys, "n", *cols)


# Slack levels probed together; each group uses the narrowest one that covers its ranks.
_LEVELS = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1.0)


def _bracketed(x: DataFrame, keys, probs, outs, accuracy) -> DataFrame:
    """Two-pass exact quantiles. Pass 1 (per group): count and ``percentile_approx`` at
    p +- s for a ladder of slacks s; the group picks the smallest s with
    s*n >= 3 + 4n/accuracy, which brackets ranks floor(p(n-1)) and +1 whatever the
    sketch's rank convention. Pass 2: counts by value inside the brackets, by side outside."""
    base = 4.0 / accuracy
    levels = sorted({base, *[lv for lv in _LEVELS if lv > base]})
    probe = sorted({min(1.0, max(0.0, p + sgn * lv)) for p in probs for lv in levels for sgn in (-1, 1)})
    idx = {p: i for i, p in enumerate(probe)}
    s1 = x.groupBy(*keys).agg(F.count("_x").alias("_n"), F.percentile_approx("_x", probe, accuracy).alias("_pa"))
    limit = BRACKET_MAX_ROWS * accuracy / DEFAULT_ACCURACY
    if keys:
        ensure_checkpoint_dir(x.sparkSession)
        s1 = s1.checkpoint(eager=True)  # one small row per group, read twice
        groups = s1.agg(F.max("_n").alias("m"), F.count(F.lit(1)).alias("k")).first()
        if (groups["m"] or 0) > limit:
            return _by_position(x, keys, probs, outs)
    need = F.when(F.col("_n") > 0, F.lit(3.0) / F.col("_n")).otherwise(F.lit(1.0)) + F.lit(base)
    bcols = []
    for i, p in enumerate(probs):
        lo = hi = None
        for lv in reversed(levels):  # build CASE from widest to narrowest
            lv_lo = F.col("_pa")[idx[min(1.0, max(0.0, p - lv))]]
            lv_hi = F.col("_pa")[idx[min(1.0, max(0.0, p + lv))]]
            if lo is None:
                lo, hi = lv_lo, lv_hi
            else:
                lo = F.when(F.lit(lv) >= need, lv_lo).otherwise(lo)
                hi = F.when(F.lit(lv) >= need, lv_hi).otherwise(hi)
        bcols += [lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}")]
    b = s1.select(*keys, "_n", *bcols)
    if not keys:
        # one job gives both n and the bracket bounds, injected as literals
        brow = b.first()
        if (brow["_n"] or 0) > limit:
            return _by_position(x, keys, probs, outs)
        j = x.select("*", *[F.lit(brow[f.name]).cast(f.dataType).alias(f.name) for f in b.schema.fields])
    else:
        j = join_small(x, b, keys, bound=groups["k"])  # told, or few groups would be few tasks
    inside = [(F.col("_x") >= F.col(f"_lo{i}")) & (F.col("_x") <= F.col(f"_hi{i}")) for i in range(len(probs))]
    below = [F.col("_x") < F.col(f"_lo{i}") for i in range(len(probs))]
    some = inside[0]
    for c in inside[1:]:
        some = some | c
    counted = j.select(*keys, "_n", F.when(some, F.col("_x")).alias("_v"), F.array(*inside).alias("_in"),
                       F.array(*below).alias("_below")).groupBy(*keys, "_v", "_in", "_below").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    group = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])
    upto = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    ranked = counted.select("*", *[
        (F.sum(F.when(F.col("_below")[i], F.col("_c")).otherwise(0)).over(group)
         + F.sum(F.when(F.col("_in")[i], F.col("_c")).otherwise(0)).over(upto)).alias(f"_r{i}") for i in range(len(probs))])
    aggs = [F.max("_n").alias("_n")]
    for i in range(len(probs)):
        for d in (0, 1):  # the first value whose running count passes the rank
            hit = F.col("_in")[i] & (F.col(f"_r{i}") > F.floor(h[i]) + d)
            aggs.append(F.min(F.when(hit, F.col("_v"))).alias(f"_v{i}_{d}"))
    cols = []
    for i in range(len(probs)):
        v0 = F.col(f"_v{i}_0")
        frac = h[i] - F.floor(h[i])
        cols.append((v0 + (F.coalesce(F.col(f"_v{i}_1"), v0) - v0) * frac).alias(outs[i]))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, F.coalesce("_n", F.lit(0)).alias("n"), *cols)


def exact_quantile_row(df: DataFrame, col: str, probs: Sequence[float], accuracy: int = DEFAULT_ACCURACY,
                       method: str = "exact"):
    """Global quantiles as one collected Row (n, q0, q1, ...)."""
    return exact_quantiles(df, col, probs, accuracy=accuracy, method=method).first()


def quantiles_long(df: DataFrame, col: str, probs: Sequence[float], by=None) -> DataFrame:
    """Exact linear quantiles in long form (keys, i, p, value) for many probabilities:
    one distributed sort for the ranks, then each (key, probability) row looks up the two
    order statistics it needs through an equi-join on the position."""
    keys = keys_of(by)
    x = df.select(*[F.col(k) for k in keys], F.col(col).cast("double").alias("_x"))
    x = x.filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    ranked = assign_row_id(x, ["_x"], key=keys, row_id="_pos", with_count="_n")
    counts = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    wanted = counts.select(*keys, "_n", F.explode(grid).alias("g")).select(*keys, "_n", "g.i", "g.p")
    h = F.col("p") * (F.col("_n") - 1)
    wanted = wanted.withColumn("_lo", F.floor(h).cast("bigint")).withColumn("_frac", h - F.floor(h))
    ends = wanted.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_d")) \
                 .withColumn("_pos", F.col("_lo") + F.col("_d"))
    vals = join_small(ends, ranked.select(*keys, "_pos", "_x"), [*keys, "_pos"], how="left")
    agg = vals.groupBy(*keys, "i").agg(F.first("p").alias("p"), F.first("_frac").alias("_frac"),
                                       F.max(F.when(F.col("_d") == 0, F.col("_x"))).alias("_v0"),
                                       F.max(F.when(F.col("_d") == 1, F.col("_x"))).alias("_v1"))
    v1 = F.coalesce(F.col("_v1"), F.col("_v0"))
    return agg.select(*keys, "i", "p", (F.col("_v0") + (v1 - F.col("_v0")) * F.col("_frac")).alias("value"))
