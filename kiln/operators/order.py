"""Order-dependent building blocks that never put a whole table (or a whole hot key)
into one task.

* ``assign_row_id`` - 0-based position per series in a total order. Range-partitions on
  (key, order), sorts inside each partition, tags every row with its partition id and
  in-partition sequence number, checkpoints (so ids cannot move between jobs), and adds
  per-(partition, key) offsets computed on a small count table.
* ``with_halo`` - splits each series into blocks of ``block`` consecutive rows, copies the
  last ``before`` rows of a block into the next block (and the first ``after`` rows into the
  previous one), runs window expressions per (key, block) and drops the copies. Lags,
  leads and fixed row frames thus see exactly the rows a single global window would.
* ``running_sum`` / ``forward_fill`` - per-block window plus a carry computed on the tiny
  per-block table.

All take ``key=None`` for one series; a hot key is split into blocks like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.session import ensure_checkpoint_dir

DEFAULT_BLOCK = 262_144
# Keyed row numbering (a plain partitionBy(key) window) is used when every series is short,
# or moderately long with enough keys to keep all tasks busy; otherwise range partitioning.
KEYED_SMALL_ROWS = 50_000
KEYED_MAX_ROWS = 2_000_000
# Largest small-side row count we broadcast explicitly when a static bound is known.
BROADCAST_MAX_ROWS = 1_000_000
# ``look_up``: value tables up to this size are broadcast whole; of larger ones, the values that
# more than this share of the rows have.
LOOKUP_MAX_ROWS = 100_000
HOT_SHARE = 1 / 5_000
_SALTS = 1 << 16


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder. For loops: unlike a checkpoint, which keeps
    its plan's size estimate, the table starts anew with the size of its files."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keys_of(key) -> list[str]:
    if key is None:
        return []
    if isinstance(key, str):
        return [key]
    return list(key)


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner",
               bound: int | None = None) -> DataFrame:
    """Equi-join ``big`` with a derived small table on ``keys`` (NULL-safe).

    ``bound`` is a proven upper bound on ``small``'s rows: within the limit the side is
    broadcast explicitly; otherwise the join is left to AQE, which converts it to a
    broadcast join only when the runtime size of ``small`` is under its threshold.
    """
    keys = list(keys)
    s = small
    for k in keys:
        s = s.withColumnRenamed(k, f"__r_{k}")
    if bound is not None and bound <= BROADCAST_MAX_ROWS:
        s = F.broadcast(s)
    elif bound is not None:
        s = s.hint("shuffle_hash")  # too big to broadcast: shuffle both sides
    if not keys:
        return attach_row(big, small)
    cond = None
    for k in keys:
        c = big[k].eqNullSafe(s[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = big.join(s, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])


def attach_row(big: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row as literals (one tiny collect;
    keeps filters on them pushable and avoids a cartesian product)."""
    row = one_row.first()
    cols = []
    for f in one_row.schema.fields:
        v = row[f.name] if row is not None else None
        cols.append(F.lit(v).cast(f.dataType).alias(f.name))
    return big.select("*", *cols)


def look_up(big: DataFrame, value: str, known: DataFrame, key: str, rows: str, total: int, out: Sequence[str],
            whole: int | None = None) -> DataFrame:
    """``big`` with the columns ``out`` of ``known`` (a stored table with one row per ``key`` and the
    number of ``big``'s rows that have it) where ``value`` = ``key``, else NULL. Of a table too
    large to broadcast, the values of more than ``HOT_SHARE`` of the ``total`` rows are (at most
    1 / HOT_SHARE); their rows, and those of NULL, are dealt at random, so that no value fills a task."""
    picked, columns, value = F.struct(*[F.col(c) for c in out]), [F.col(f"`{c}`") for c in big.columns], F.col(f"`{value}`")
    if known.count() <= (LOOKUP_MAX_ROWS if whole is None else whole):
        small = F.broadcast(known.select(F.col(key).alias("__l_v"), picked.alias("__l_o")))
        return big.join(small, value == F.col("__l_v"), "left").select(*columns, *[F.col(f"__l_o.{c}").alias(c) for c in out])
    hot = F.col(rows) > total * HOT_SHARE
    x = big.join(F.broadcast(known.filter(hot).select(F.col(key).alias("__l_v"), picked.alias("__l_h"))), value == F.col("__l_v"), "left")
    here = F.col("__l_h").isNull() & value.isNotNull()
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(_SALTS))
    x = x.select(*columns, "__l_h", F.when(here, value).alias("__l_k"),
                 F.when(here, spread(value)).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS))).alias("__l_s"))
    rest = known.filter(~hot).select(F.col(key).alias("__l_r"), spread(key).alias("__l_t"), picked.alias("__l_o"))
    return x.join(rest, (F.col("__l_k") == F.col("__l_r")) & (F.col("__l_s") == F.col("__l_t")), "left").select(
        *columns, *[F.coalesce(F.col(f"__l_h.{c}"), F.col(f"__l_o.{c}")).alias(c) for c in out])


def _partition_count(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return max(1, int(conf))


def assign_row_id(df: DataFrame, order_cols: Sequence[str | Column], key=None,
                  row_id: str = "row_id", partitions: int | None = None,
                  with_count: str | None = None, layout: str = "auto") -> DataFrame:
    """Add ``row_id`` = 0-based rank in ``order_cols`` order within each key.

    ``order_cols`` must be unique within a key (add a tie-breaker). With ``with_count``
    the series length is added as well. ``layout``: ``"blocked"`` always range-partitions
    (any key size); ``"keyed"`` uses ``row_number()`` over ``partitionBy(key)``;
    ``"auto"`` measures the series (one small aggregate) and uses the keyed window only
    when every series is short (``KEYED_SMALL_ROWS``), or at most ``KEYED_MAX_ROWS`` with
    at least as many keys as shuffle partitions; a hot key always gets the range layout.
    """
    keys = keys_of(key)
    spark = df.sparkSession
    if keys and layout in ("auto", "keyed"):
        use_keyed = layout == "keyed"
        if layout == "auto":
            st = df.groupBy(*keys).count().agg(F.max("count").alias("m"), F.count(F.lit(1)).alias("k")).first()
            longest, n_keys = st["m"] or 0, st["k"] or 0
            use_keyed = longest <= KEYED_SMALL_ROWS or (
                longest <= KEYED_MAX_ROWS and n_keys >= _partition_count(df, partitions))
        if use_keyed:
            order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
            w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*order)
            out = df.withColumn(row_id, (F.row_number().over(w) - 1).cast("bigint"))
            if with_count:
                out = out.withColumn(with_count, F.count(F.lit(1)).over(Window.partitionBy(*[F.col(k) for k in keys])))
            return out
    sort_cols = [F.col(k) for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    # Without an explicit count AQE may merge adjacent range partitions, which keeps
    # partition ids in key/order sequence.
    ranged = df.repartitionByRange(partitions, *sort_cols) if partitions else df.repartitionByRange(*sort_cols)
    tagged = (ranged.sortWithinPartitions(*sort_cols)
                    .withColumn("__o_pid", F.spark_partition_id())
                    .withColumn("__o_mid", F.monotonically_increasing_id()))
    ensure_checkpoint_dir(spark)
    tagged = tagged.checkpoint(eager=True)
    stats = tagged.groupBy("__o_pid", *keys).agg(F.count(F.lit(1)).alias("__o_cnt"),
                                                 F.min("__o_mid").alias("__o_mid0"))
    part = [F.col(k) for k in keys] or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy("__o_pid").rowsBetween(Window.unboundedPreceding, -1)
    cols = [*keys, "__o_pid", "__o_mid0", F.coalesce(F.sum("__o_cnt").over(w), F.lit(0)).alias("__o_off")]
    if with_count:
        cols.append(F.sum("__o_cnt").over(Window.partitionBy(*part)).alias(with_count))
    offsets = stats.select(*cols)
    if keys:
        # one row per (partition, key present in it): size-checked before broadcasting
        offsets = offsets.checkpoint(eager=True)
        bound = offsets.count()
    else:
        bound = _partition_count(df, partitions)  # at most one row per range partition
    joined = join_small(tagged, offsets, [*keys, "__o_pid"], bound=bound)
    out = joined.withColumn(row_id, (F.col("__o_off") + F.col("__o_mid") - F.col("__o_mid0")).cast("bigint"))
    return out.drop("__o_pid", "__o_mid", "__o_mid0", "__o_off")


def _block_size(before: int, after: int, block: int | None) -> int:
    b = block or DEFAULT_BLOCK
    need = max(before, after) + 1
    if b < need:
        b = max(b, 4 * need) if block is None else b
    if b <= max(before, after):
        raise ValueError(f"block size {b} must exceed the frame reach {max(before, after)}")
    return b


def with_halo(df: DataFrame, key, row_id: str, before: int, after: int,
              compute: Callable[[DataFrame, Window], DataFrame], block: int | None = None) -> DataFrame:
    """Run window expressions that reach ``before`` rows back and ``after`` rows ahead.

    ``compute(halo_df, w)`` receives the block-expanded rows and a window ordered by
    ``row_id`` inside (key, block); it returns the frame with its new columns. Copies are
    removed afterwards, so each original row appears once with exact window values.
    """
    keys = keys_of(key)
    b = _block_size(before, after, block)
    rid = F.col(row_id)
    blk = F.floor(rid / F.lit(b)).cast("bigint")
    pos = rid - blk * F.lit(b)
    items = [F.struct(blk.alias("b"), F.lit(False).alias("h"))]
    if before > 0:
        items.append(F.when(pos >= F.lit(b - before), F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))))
    if after > 0:
        items.append(F.when(pos < F.lit(after), F.struct((blk - 1).alias("b"), F.lit(True).alias("h"))))
    if len(items) == 1:
        expanded = df.withColumn("__o_blk", blk).withColumn("__o_halo", F.lit(False))
    else:
        arr = F.filter(F.array(*items), lambda x: x.isNotNull())
        expanded = (df.withColumn("__o_hb", F.explode(arr))
                      .withColumn("__o_blk", F.col("__o_hb.b")).withColumn("__o_halo", F.col("__o_hb.h"))
                      .drop("__o_hb"))
    w = Window.partitionBy(*[F.col(k) for k in keys], F.col("__o_blk")).orderBy(rid)
    out = compute(expanded, w)
    return out.filter(~F.col("__o_halo")).drop("__o_blk", "__o_halo")


def add_lag_columns(df: DataFrame, key, row_id: str, specs: Sequence[tuple[str, str, int]],
                    block: int | None = None) -> DataFrame:
    """``specs`` = [(out_name, source_col, offset)]; offset > 0 is a lag, < 0 a lead."""
    before = max([o for _, _, o in specs if o > 0], default=0)
    after = max([-o for _, _, o in specs if o < 0], default=0)

    def compute(x, w):
        exprs = []
        for out, src, off in specs:
            e = F.lag(src, off).over(w) if off > 0 else F.lead(src, -off).over(w)
            exprs.append(e.alias(out))
        return x.select("*", *exprs)

    return with_halo(df, key, row_id, before, after, compute, block)


def running_sum(df: DataFrame, key, row_id: str, value: str | Column, out: str,
                block: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` (NULL counts as 0) in ``row_id`` order per key."""
    return running_sums(df, key, row_id, {out: value}, block)


def running_sums(df: DataFrame, key, row_id: str, values: dict[str, str | Column], block: int | None = None) -> DataFrame:
    """``running_sum`` of several values in one pass; ``values`` by the names of their sums."""
    keys = keys_of(key)
    b = block or DEFAULT_BLOCK
    n = range(len(values))
    x = df.withColumn("__o_blk", F.floor(F.col(row_id) / F.lit(b)).cast("bigint")).select(
        "*", *[F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(0)).alias(f"__o_v{i}") for i, v in enumerate(values.values())])
    w = (Window.partitionBy(*[F.col(k) for k in keys], F.col("__o_blk")).orderBy(row_id)
         .rowsBetween(Window.unboundedPreceding, 0))
    x = x.select("*", *[F.sum(f"__o_v{i}").over(w).alias(f"__o_loc{i}") for i in n])
    totals = x.groupBy(*keys, "__o_blk").agg(*[F.sum(f"__o_v{i}").alias(f"__o_tot{i}") for i in n])
    part = [F.col(k) for k in keys] or [F.lit(0)]
    wt = Window.partitionBy(*part).orderBy("__o_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "__o_blk", *[F.coalesce(F.sum(f"__o_tot{i}").over(wt), F.lit(0)).alias(f"__o_carry{i}") for i in n])
    y = join_small(x, carry, [*keys, "__o_blk"])
    return y.select(*df.columns, *[(F.col(f"__o_loc{i}") + F.col(f"__o_carry{i}")).alias(out) for i, out in enumerate(values)])


def forward_fill(df: DataFrame, key, row_id: str, cols: Sequence[str], block: int | None = None) -> DataFrame:
    """Replace NULL by the last non-NULL value above it (same key); leading NULLs stay."""
    keys = keys_of(key)
    cols = [c for c in cols if c not in keys and c != row_id]
    if not cols:
        return df
    b = block or DEFAULT_BLOCK
    x = df.withColumn("__o_blk", F.floor(F.col(row_id) / F.lit(b)).cast("bigint"))
    w = (Window.partitionBy(*[F.col(k) for k in keys], F.col("__o_blk")).orderBy(row_id)
         .rowsBetween(Window.unboundedPreceding, 0))
    x = x.select(*[c for c in x.columns if c not in cols],
                 *[F.last(F.col(c), ignorenulls=True).over(w).alias(c) for c in cols])
    # Last non-NULL value of each block, then carried across blocks on the small table.
    lasts = x.groupBy(*keys, "__o_blk").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(row_id)))
                                           .alias(f"__o_e{i}") for i, c in enumerate(cols)])
    part = [F.col(k) for k in keys] or [F.lit(0)]
    wt = Window.partitionBy(*part).orderBy("__o_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(*keys, "__o_blk", *[F.last(f"__o_e{i}", ignorenulls=True).over(wt).alias(f"__o_c{i}")
                                          for i in range(len(cols))])
    y = join_small(x, carry, [*keys, "__o_blk"])
    order = df.columns
    y = y.select(*[F.coalesce(F.col(c), F.col(f"__o_c{cols.index(c)}")).alias(c) if c in cols else F.col(c)
                   for c in order])
    return y
