"""Date parsing, time-zone handling, date repair and series regularity.

Timestamps are handled as 64-bit microseconds; every gap / step computation is integer
arithmetic on ``unix_micros`` so results do not depend on floating point. All
order-dependent work goes through :mod:`kiln.operators.order` (no global window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.exprs import micros, q
from kiln.functions.quantiles import exact_quantiles
from kiln.operators.order import (add_lag_columns, assign_row_id, attach_row, forward_fill, join_small, keys_of,
                                  running_sum)

# Candidate formats tried when guessing one format from a sample
# (month first when ambiguous, as pandas does), in this order.
GUESS_FORMATS = [
    "yyyy-M-d H:m:s.SSSSSS", "yyyy-M-d'T'H:m:s.SSSSSS", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s",
    "yyyy-M-d H:m", "yyyy-M-d", "M/d/yyyy H:m:s", "M/d/yyyy", "d/M/yyyy H:m:s", "d/M/yyyy",
    "yyyy/M/d H:m:s", "yyyy/M/d", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M", "yyyyMMdd",
]

# The nine patterns of format detection, in the reference's order, written
# as Spark patterns (single letters accept one or two digits like strptime).
DETECT_PATTERNS = [
    ("%Y-%m-%d", "yyyy-M-d"),
    ("%Y-%m-%d %H:%M:%S", "yyyy-M-d H:m:s"),
    ("%Y-%m-%dT%H:%M:%S", "yyyy-M-d'T'H:m:s"),
    ("%Y-%m-%dT%H:%M:%SZ", "yyyy-M-d'T'H:m:s'Z'"),
    ("%Y-%m-%d %H:%M:%S%z", "yyyy-M-d H:m:s[XXX][XX]"),
    ("%d/%m/%Y", "d/M/yyyy"),
    ("%m/%d/%Y", "M/d/yyyy"),
    ("%d-%m-%Y", "d-M-yyyy"),
    ("%Y/%m/%d", "yyyy/M/d"),
]

# Common steps (seconds) the auto step snaps to, checked in this order,
# with a 10 % relative tolerance.
COMMON_STEPS = [3600, 86400, 604800, 2628000, 31536000]
STEP_TOLERANCE = 0.1

# Formats accepted by the UTC / keep-zone standardisation (optional offset suffix).
_ZONED = ["yyyy-M-d H:m:s.SSSSSS[XXX][XX][X]", "yyyy-M-d'T'H:m:s.SSSSSS[XXX][XX][X]",
          "yyyy-M-d H:m:s[XXX][XX][X]", "yyyy-M-d'T'H:m:s[XXX][XX][X]", "yyyy-M-d'T'H:m:s'Z'",
          "yyyy-M-d H:m[XXX][XX][X]", "yyyy-M-d"]

MICROS_PER_SECOND = 1_000_000
HOUR_US = 3600 * MICROS_PER_SECOND
DAY_US = 86400 * MICROS_PER_SECOND


def _is_text(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.StringType)


def _try_parse(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt))


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


# ----------------------------------------------------------------------------- D1
def guess_format(sample: str, formats: Sequence[str] = GUESS_FORMATS) -> str | None:
    """The first candidate format that parses ``sample`` (pure Python, one value)."""
    import datetime as _dt

    py = {
        "yyyy": "%Y", "M": "%m", "d": "%d", "H": "%H", "m": "%M", "s": "%S", "SSSSSS": "%f", "MM": "%m",
        "dd": "%d",
    }
    for fmt in formats:
        p = fmt.replace("'T'", "T")
        out, i = "", 0
        while i < len(p):
            for tok in ("yyyy", "SSSSSS", "MM", "dd", "M", "d", "H", "m", "s"):
                if p.startswith(tok, i):
                    out += py[tok]
                    i += len(tok)
                    break
            else:
                out += p[i]
                i += 1
        try:
            _dt.datetime.strptime(sample.strip(), out)
            return fmt
        except ValueError:
            continue
    return None


def parse_dates(df: DataFrame, col: str, formats: Sequence[str] | None = None, mode: str = "first",
                order_cols: Sequence[str] | None = None, out: str | None = None) -> DataFrame:
    """Text -> ``timestamp_ntz``; anything not in the chosen format becomes NULL.

    ``mode="first"``: one format is fixed from the first (by ``order_cols``) non-null value
    and applied to every row (pandas behaviour: a later value in another layout becomes
    NULL); if no candidate fits that value, every row is parsed on its own, as in
    ``mode="any"``: the first candidate that parses it.
    """
    out = out or col
    if not _is_text(df, col):
        return df.withColumn(out, _ntz(q(col)))
    cands = list(formats or GUESS_FORMATS)
    if mode == "any":
        parsed = F.coalesce(*[_try_parse(q(col), f) for f in cands])
    else:
        order = order_cols or []
        known = df.filter(q(col).isNotNull())
        if order:
            row = known.agg(F.min_by(q(col), F.struct(*[q(c) for c in order])).alias("s")).first()
        else:
            row = known.agg(F.first(q(col)).alias("s")).first()
        sample = row["s"] if row else None
        fmt = guess_format(sample, cands) if sample is not None else None
        if fmt is None:
            parsed = F.coalesce(*[_try_parse(q(col), f) for f in cands])
        else:
            parsed = _try_parse(q(col), fmt)
    return df.withColumn(out, _ntz(parsed))


def parse_failures(df: DataFrame, raw: str, parsed: str) -> int:
    """New NULLs introduced by parsing = NULL(parsed) - NULL(raw)."""
    row = df.agg(F.count_if(q(parsed).isNull()).alias("a"), F.count_if(q(raw).isNull()).alias("b")).first()
    return int(row["a"] - row["b"])


# ----------------------------------------------------------------------------- D2 / D3
def _zoned_parse(c: Column) -> Column:
    return F.coalesce(*[_try_parse(c, f) for f in _ZONED])


def to_utc(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Standardise to UTC instants (``timestamp``): naive values are labelled UTC, values
    with an offset (``+02:00``, ``+0200``, ``Z``) are converted. Needs session zone UTC."""
    out = out or col
    c = q(col)
    if _is_text(df, col):
        val = _zoned_parse(c)
    else:
        val = c.cast("timestamp_ntz").cast("timestamp") if isinstance(df.schema[col].dataType, T.TimestampNTZType) \
            else c.cast("timestamp")
    return df.withColumn(out, val)


def keep_tz(df: DataFrame, col: str, out: str | None = None, offset_col: str | None = None) -> DataFrame:
    """Standardise but keep the original offset: local wall time as ``timestamp_ntz`` plus
    ``offset_minutes`` (NULL for naive values)."""
    out = out or col
    offset_col = offset_col or f"{out}_offset_minutes"
    c = q(col)
    if not _is_text(df, col):
        return df.withColumn(out, c.cast("timestamp_ntz")).withColumn(offset_col, F.lit(None).cast("int"))
    zone = "(?<=:\\d{1,2}(?:\\.\\d{1,9})?)([+-])(\\d{2}):?(\\d{2})?$"  # an offset follows a time of day
    m = F.regexp_extract(c, zone, 0)
    sign = F.when(F.regexp_extract(c, zone, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    hh = F.regexp_extract(c, zone, 2)
    mm = F.coalesce(F.nullif(F.regexp_extract(c, zone, 3), F.lit("")), F.lit("0"))
    is_z = c.rlike("Z$")
    offset = (F.when(m != "", sign * (hh.cast("int") * 60 + mm.cast("int")))
                .when(is_z, F.lit(0)))
    local_txt = F.when(m != "", F.regexp_replace(c, zone, "")) \
                 .when(is_z, F.regexp_replace(c, "Z$", "")).otherwise(c)
    local = F.coalesce(*[_try_parse(local_txt, f.replace("[XXX][XX][X]", "")) for f in _ZONED if "'Z'" not in f])
    valid = _zoned_parse(c).isNotNull()
    return df.withColumns({offset_col: F.when(valid, offset).cast("int"), out: F.when(valid, local.cast("timestamp_ntz"))})


def zone_label(df: DataFrame, offset_col: str) -> str:
    """``timezone_naive`` when no value carries an offset, else ``UTC+hh:mm`` of the
    most frequent offset (one small aggregate)."""
    row = (df.filter(q(offset_col).isNotNull()).groupBy(offset_col).count()
             .orderBy(F.desc("count"), q(offset_col)).first())
    if row is None:
        return "timezone_naive"
    m = int(row[offset_col])
    sign = "+" if m >= 0 else "-"
    return f"UTC{sign}{abs(m) // 60:02d}:{abs(m) % 60:02d}"


# ----------------------------------------------------------------------------- D4
def preview_dates(df: DataFrame, col: str, mode: str = "utc", order_cols: Sequence[str] | None = None,
                  n: int = 5) -> DataFrame:
    """Up to ``n`` non-null originals (first by ``order_cols``) with the standardised ISO
    text and a warning for values that do not parse. A missing column gives one warning
    row instead of an error."""
    if col not in df.columns:
        spark = df.sparkSession
        return spark.createDataFrame([(None, None, f"column '{col}' not found")],
                                     "original string, transformed string, warning string")
    base = df.filter(q(col).isNotNull())
    if order_cols:
        base = base.orderBy(*[q(c) for c in order_cols])
    base = base.limit(n)
    txt = q(col).cast("string")
    if mode == "utc":
        parsed = _zoned_parse(txt)
        iso = F.concat(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    else:
        k = keep_tz(base.select(txt.alias("_o")), "_o", "_t", "_off")
        parsed = None
        iso = None
        base = k
        iso_col = F.concat(F.date_format(F.col("_t"), "yyyy-MM-dd'T'HH:mm:ss"),
                           F.when(F.col("_off").isNull(), F.lit(""))
                            .otherwise(F.format_string("%s%02d:%02d",
                                                       F.when(F.col("_off") < 0, F.lit("-")).otherwise(F.lit("+")),
                                                       (F.abs(F.col("_off")) / 60).cast("int"),
                                                       F.abs(F.col("_off")) % 60)))
        return base.select(F.col("_o").alias("original"),
                           F.when(F.col("_t").isNotNull(), iso_col).alias("transformed"),
                           F.when(F.col("_t").isNull(), F.concat(F.lit("could not parse: "), F.col("_o")))
                            .alias("warning"))
    return base.select(txt.alias("original"), iso.alias("transformed"),
                       F.when(parsed.isNull(), F.concat(F.lit("could not parse: "), txt)).alias("warning"))


# ----------------------------------------------------------------------------- D5
def detect_format(df: DataFrame, col: str, order_cols: Sequence[str] | None = None,
                  n_samples: int | None = 3, n_passed: int = 5) -> DataFrame:
    """Format detection over the first ``n_samples`` of the first ``n_passed`` non-null values
    (``None``: all values). Each sample counts for the first of the nine patterns that parses
    it; best = most hits (earlier pattern on ties); rate = best hits / values passed (so at
    most 0.6 by default); a zone flag when a sample
    holds ``+``, ``Z``, ``UTC`` or ``GMT``. One row: detected_format, success_rate,
    timezone_info."""
    base = df.filter(q(col).isNotNull()).select(q(col).cast("string").alias("_s"),
                                                *[q(c) for c in (order_cols or [])])
    if n_samples is not None:
        if order_cols:
            base = base.orderBy(*[q(c) for c in order_cols])
        base = base.limit(max(n_passed, n_samples))
        place = F.row_number().over(Window.orderBy(*[q(c) for c in (order_cols or ["_s"])]))  # of n_passed rows
        base = base.withColumn("_test", place <= n_samples)
    else:
        base = base.withColumn("_test", F.lit(True))
    s = F.col("_s")
    first_hit = F.lit(None).cast("int")
    for i in range(len(DETECT_PATTERNS) - 1, -1, -1):
        first_hit = F.when(_try_parse(s, DETECT_PATTERNS[i][1]).isNotNull(), F.lit(i)).otherwise(first_hit)
    zone = s.contains("+") | s.contains("Z") | s.contains("UTC") | s.contains("GMT")
    tagged = base.select(F.when(F.col("_test"), first_hit).alias("_p"), (F.col("_test") & zone).alias("_tz"))
    names = F.array(*[F.lit(p) for p, _ in DETECT_PATTERNS])
    agg = tagged.agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_or("_tz").alias("_tz"),
        *[F.count_if(F.col("_p") == i).alias(f"_h{i}") for i in range(len(DETECT_PATTERNS))],
    )
    hits = F.array(*[F.struct(F.col(f"_h{i}").alias("h"), F.lit(-i).alias("neg"), F.lit(i).alias("i"))
                     for i in range(len(DETECT_PATTERNS))])
    best = F.array_max(hits)
    return agg.select(
        F.when(best["h"] > 0, names[best["i"]]).otherwise(F.lit("Mixed formats")).alias("detected_format"),
        F.when(F.col("_n") > 0, best["h"] / F.col("_n")).otherwise(F.lit(0.0)).cast("double").alias("success_rate"),
        F.when(F.col("_tz"), F.lit("Timezone detected")).otherwise(F.lit("No timezone detected")).alias("timezone_info"),
    )


# ----------------------------------------------------------------------------- D9
def detect_step(df: DataFrame, ts: str, key=None, order_cols: Sequence[str] | None = None,
                block: int | None = None) -> DataFrame:
    """Auto step per series: mode of consecutive differences of the sorted non-null
    timestamps (smallest mode on ties); snapped to a common step when within 10 %,
    otherwise the mean difference ``(max - min) / (n - 1)``. One row per key with
    ``step_us`` (integer microseconds), ``step_seconds`` and ``mode_seconds``."""
    keys = keys_of(key)
    gaps = consecutive_gaps(df, ts, key, order_cols, block)
    per = gaps.filter(F.col("_gap").isNotNull()).groupBy(*keys, "_gap").agg(F.count(F.lit(1)).alias("_c"))
    mode = per.groupBy(*keys).agg(F.min_by("_gap", F.struct(-F.col("_c"), F.col("_gap"))).alias("_mode_us"))
    stats = gaps.groupBy(*keys).agg(F.min("_us").alias("_mn"), F.max("_us").alias("_mx"),
                                    F.count("_us").alias("_cnt"))
    j = join_small(stats, mode, keys, how="left") if keys else attach_row(stats, mode)
    mode_s = F.col("_mode_us") / F.lit(float(MICROS_PER_SECOND))
    snapped = F.lit(None).cast("bigint")
    for s in reversed(COMMON_STEPS):
        snapped = F.when(F.abs(mode_s - F.lit(float(s))) / F.lit(float(s)) < F.lit(STEP_TOLERANCE),
                         F.lit(s * MICROS_PER_SECOND).cast("bigint")).otherwise(snapped)
    mean_us = F.when(F.col("_cnt") >= 2, F.expr("(_mx - _mn) div (_cnt - 1)"))
    step_us = F.coalesce(snapped, mean_us)
    return j.select(*keys, step_us.alias("step_us"), (step_us / F.lit(float(MICROS_PER_SECOND))).alias("step_seconds"),
                    mode_s.alias("mode_seconds"))


def consecutive_gaps(df: DataFrame, ts: str, key=None, order_cols: Sequence[str] | None = None,
                     block: int | None = None) -> DataFrame:
    """Non-null timestamps sorted per key, with ``_gap`` = micros to the previous one."""
    keys = keys_of(key)
    base = df.filter(q(ts).isNotNull()).select(*[q(k) for k in keys], q(ts).alias("_ts"),
                                               *[q(c).alias(f"_o{i}") for i, c in enumerate(order_cols or [])])
    base = base.withColumn("_us", micros(F.col("_ts")))
    ordered = assign_row_id(base, ["_us", *[f"_o{i}" for i in range(len(order_cols or []))]], key=keys, row_id="_rid")
    lagged = add_lag_columns(ordered, keys, "_rid", [("_prev", "_us", 1)], block=block)
    return lagged.withColumn("_gap", F.col("_us") - F.col("_prev"))


# ----------------------------------------------------------------------------- D6-D8
def impute_dates(df: DataFrame, col: str, order_cols: Sequence[str] | None = None, strategy: str = "mean_timedelta",
                 key=None, block: int | None = None, step_seconds: float | None = None) -> DataFrame:
    """Fill NULL timestamps in row order (``order_cols``, unique per key).

    Between valid ``p`` and ``n`` the k-th NULL of the run gets ``n - ceil((n-p)/2^k)``
    (each fill halves the remaining gap); a leading run gets ``n - ceil(D/2^(k-1))`` and a
    trailing run ``p + k*D``, where D is the mean step ``(max-min)/(count-1)`` (or the auto
    step for ``auto_detected``). ``leave_as_is`` returns the input. Fewer than two valid
    values: unchanged. Microsecond resolution, integer arithmetic."""
    if strategy == "leave_as_is":
        return df
    keys = keys_of(key)
    if not order_cols:
        raise ValueError("impute_dates needs order_cols: row order is not implicit in Spark")
    was_ntz = isinstance(df.schema[col].dataType, T.TimestampNTZType)
    x = df.withColumn("_us", micros(q(col)))
    x = assign_row_id(x, list(order_cols), key=keys, row_id="_rid")
    stats = x.groupBy(*keys).agg(F.max("_us").alias("_mx"), F.min("_us").alias("_mn"), F.count("_us").alias("_cnt"))
    # previous valid (value, position) and next valid (value, position)
    x = x.withColumn("_pv", F.when(F.col("_us").isNotNull(), F.struct(F.col("_us").alias("v"), F.col("_rid").alias("p"))))
    x = x.withColumn("_nv", F.col("_pv")).withColumn("_nrid", -F.col("_rid"))
    x = forward_fill(x, keys, "_rid", ["_pv"], block=block)
    x = forward_fill(x, keys, "_nrid", ["_nv"], block=block)
    if strategy == "auto_detected":
        steps = detect_step(df, col, key=keys, order_cols=None, block=block)
        stats = join_small(stats, steps.select(*keys, "step_us"), keys, how="left") if keys \
            else attach_row(stats, steps.select("step_us"))
        delta = F.col("step_us")
    elif step_seconds is not None:
        delta = F.lit(int(step_seconds * MICROS_PER_SECOND)).cast("bigint")
    else:  # mean_timedelta and unknown names
        delta = F.expr("(_mx - _mn) div (_cnt - 1)")
    stats = stats.select(*keys, "_cnt", F.when(F.col("_cnt") >= 2, delta).alias("_delta"))
    x = join_small(x, stats, keys) if keys else attach_row(x, stats)

    p, pp = F.col("_pv.v"), F.col("_pv.p")
    n, npos = F.col("_nv.v"), F.col("_nv.p")
    d = F.col("_delta")

    def ceil_shift(a: Column, k: Column) -> Column:
        # ceil(a / 2^k) for a >= 0, without overflow
        kk = F.least(k, F.lit(63)).cast("int")
        return F.when(a <= 0, F.lit(0).cast("bigint")).otherwise(_shr(a - 1, kk) + 1)

    gap = n - p
    k_mid = F.col("_rid") - pp
    mid = n - F.signum(gap).cast("bigint") * ceil_shift(F.abs(gap), k_mid)
    trailing = p + (F.col("_rid") - pp) * d
    lead_k = F.col("_rid") + 1
    leading = n - ceil_shift(d, lead_k - 1)
    filled = (F.when(F.col("_us").isNotNull(), F.col("_us"))
               .when(F.col("_cnt") < 2, F.lit(None))
               .when(p.isNotNull() & n.isNotNull(), mid)
               .when(p.isNotNull(), trailing)
               .when(n.isNotNull(), leading))
    ts_val = F.timestamp_micros(filled)
    if was_ntz:
        ts_val = ts_val.cast("timestamp_ntz")
    out_cols = [ts_val.alias(c) if c == col else q(c) for c in df.columns]
    return x.select(*out_cols)


def _shr(a: Column, k: Column) -> Column:
    return F.call_function("shiftright", a, k)


def count_invalid_dates(df: DataFrame, col: str) -> int:
    return int(df.agg(F.count_if(q(col).isNull()).alias("n")).first()["n"])


# ----------------------------------------------------------------------------- D10
def spread_duplicates(df: DataFrame, ts: str, tie_cols: Sequence[str], key=None,
                      block: int | None = None) -> DataFrame:
    """Sort by (ts, tie); every 2nd+ occurrence of a timestamp gets +i ms where i counts
    duplicates over the whole series in that order (1, 2, 3 ...)."""
    keys = keys_of(key)
    was_ntz = isinstance(df.schema[ts].dataType, T.TimestampNTZType)
    x = df.withColumn("_us", micros(q(ts)))
    x = assign_row_id(x, ["_us", *tie_cols], key=keys, row_id="_rid")
    x = add_lag_columns(x, keys, "_rid", [("_prev", "_us", 1)], block=block)
    x = x.withColumn("_dup", F.when(F.col("_us").isNotNull() & (F.col("_us") == F.col("_prev")), 1).otherwise(0))
    x = running_sum(x, keys, "_rid", "_dup", "_i", block=block)
    shifted = F.when(F.col("_dup") == 1, F.col("_us") + F.col("_i") * F.lit(1000)).otherwise(F.col("_us"))
    v = F.timestamp_micros(shifted)
    if was_ntz:
        v = v.cast("timestamp_ntz")
    return x.select(*[v.alias(c) if c == ts else q(c) for c in df.columns])


def duplicate_timestamp_count(df: DataFrame, ts: str, key=None) -> int:
    keys = keys_of(key)
    row = df.filter(q(ts).isNotNull()).groupBy(*keys, ts).count().agg(
        F.sum(F.col("count") - 1).alias("d")).first()
    return int(row["d"] or 0)


# ----------------------------------------------------------------------------- D11 / D12
def is_regular(df: DataFrame, ts: str | None = None, key=None, block: int | None = None,
               method: str = "exact") -> DataFrame:
    """Regularity per series (True / False / NULL). Sorted non-null timestamps; fewer than
    two -> NULL. The median gap picks the rule: <= 2 h: every gap within 1 h +- 5 min;
    <= 2 d: every gap exactly 1 d; <= 61 d: one day-of-month and consecutive months;
    <= 730.5 d: every gap in [365 d, 366 d]; else False. ``ts=None`` uses the first column."""
    keys = keys_of(key)
    ts = ts or df.columns[0]
    base = df
    if _is_text(df, ts):
        base = parse_dates(df, ts, mode="any", out="__ts")
        unparsable = base.filter(q(ts).isNotNull() & F.col("__ts").isNull()).groupBy(*keys).agg(
            F.lit(True).alias("_bad"))
        ts_col = "__ts"
    else:
        unparsable = None
        ts_col = ts
    gaps = consecutive_gaps(base, ts_col, keys, None, block)
    g = F.col("_gap")
    day = F.dayofmonth(F.col("_ts"))
    mon_idx = F.year(F.col("_ts")) * 12 + F.month(F.col("_ts"))
    gaps = add_lag_columns(gaps.withColumn("_mi", mon_idx), keys, "_rid", [("_pmi", "_mi", 1)], block=block)
    rules = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(F.when(g.isNotNull(), F.abs(g - F.lit(HOUR_US)) <= F.lit(300 * MICROS_PER_SECOND))).alias("_hourly"),
        F.bool_and(F.when(g.isNotNull(), g == F.lit(DAY_US))).alias("_daily"),
        F.count_distinct(day).alias("_dom"),
        F.bool_and(F.when(F.col("_pmi").isNotNull(), F.col("_mi") - F.col("_pmi") == 1)).alias("_months"),
        F.bool_and(F.when(g.isNotNull(), (g >= F.lit(365 * DAY_US)) & (g <= F.lit(366 * DAY_US)))).alias("_yearly"),
    )
    med = exact_quantiles(gaps.filter(g.isNotNull()).withColumn("_gs", g / F.lit(float(MICROS_PER_SECOND))),
                          "_gs", [0.5], by=keys, method=method, prefix="_med")
    j = join_small(rules, med.select(*keys, "_med0"), keys, how="left") if keys else attach_row(rules, med.select("_med0"))
    m = F.col("_med0")
    verdict = (F.when(F.col("_n") < 2, F.lit(None).cast("boolean"))
                .when(m <= 2 * 3600, F.col("_hourly"))
                .when(m <= 2 * 86400, F.col("_daily"))
                .when(m <= 2 * 30.5 * 86400, (F.col("_dom") == 1) & F.col("_months"))
                .when(m <= 2 * 365.25 * 86400, F.col("_yearly"))
                .otherwise(F.lit(False)))
    res = j.select(*keys, verdict.alias("is_regular"))
    if unparsable is not None:
        # any unparsable value makes the verdict NULL for its series
        if keys:
            res = join_small(res, unparsable, keys, how="left")
            res = res.select(*keys, F.when(F.col("_bad"), F.lit(None).cast("boolean"))
                             .otherwise(F.col("is_regular")).alias("is_regular"))
        elif unparsable.limit(1).count() > 0:
            res = res.select(F.lit(None).cast("boolean").alias("is_regular"))
    return res


# ----------------------------------------------------------------------------- D13
def infer_step(df: DataFrame, ts: str, key=None, block: int | None = None) -> DataFrame:
    """pandas-style frequency per series: needs >= 3 timestamps; all gaps equal ->
    fixed step (``step_us``); otherwise all month-steps equal with a constant day ->
    ``step_months``; else no frequency (both NULL)."""
    keys = keys_of(key)
    gaps = consecutive_gaps(df, ts, keys, None, block)
    mon_idx = F.year(F.col("_ts")) * 12 + F.month(F.col("_ts"))
    gaps = add_lag_columns(gaps.withColumn("_mi", mon_idx), keys, "_rid", [("_pmi", "_mi", 1)], block=block)
    dm = F.col("_mi") - F.col("_pmi")
    tod = F.col("_us") - F.unix_micros(F.date_trunc("day", F.col("_ts").cast("timestamp")))
    agg = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_gap").alias("_gmin"), F.max("_gap").alias("_gmax"),
        F.min(dm).alias("_mmin"), F.max(dm).alias("_mmax"),
        F.count_distinct(F.dayofmonth(F.col("_ts"))).alias("_dom"),
        F.count_distinct(tod).alias("_tod"),
        F.max(F.dayofmonth(F.col("_ts"))).alias("_maxdom"),
        F.bool_and(F.dayofmonth(F.col("_ts")) == F.dayofmonth(F.last_day(F.col("_ts")))).alias("_eom"),
    )
    fixed = (F.col("_n") >= 3) & (F.col("_gmin") == F.col("_gmax")) & (F.col("_gmin") > 0)
    monthly = ((F.col("_n") >= 3) & (F.col("_mmin") == F.col("_mmax")) & (F.col("_mmin") > 0)
               & (F.col("_tod") == 1) & ((F.col("_dom") == 1) | F.col("_eom")))
    return agg.select(*keys,
                      F.when(fixed, F.col("_gmin")).alias("step_us"),
                      F.when(~fixed & monthly, F.col("_mmin")).cast("int").alias("step_months"),
                      (~fixed & monthly & F.col("_eom")).alias("month_end"))


REINDEX_CHUNK = 100_000


def reindex(df: DataFrame, ts: str, key=None, step_us: int | None = None, step_months: int | None = None,
            steps: DataFrame | None = None) -> DataFrame:
    """Re-index each series to a regular grid between its first and last timestamp,
    inserting NULL rows for missing steps (left join of a generated grid).

    The grid is produced in two levels (chunk starts, then steps inside a chunk) and the
    chunk rows are spread round-robin before the second explode, so one long series does
    not expand inside a single task. ``steps`` may hold per-key ``step_us`` /
    ``step_months`` / ``month_end`` (from :func:`infer_step`); a series that stands on month
    ends has its grid on the last day of each month."""
    keys = keys_of(key)
    was_ntz = isinstance(df.schema[ts].dataType, T.TimestampNTZType)
    bounds = df.filter(q(ts).isNotNull()).groupBy(*keys).agg(F.min(q(ts)).alias("_t0"), F.max(q(ts)).alias("_t1"))
    if steps is not None:
        bounds = join_small(bounds, steps, keys) if keys else attach_row(bounds, steps)
    else:
        bounds = bounds.withColumn("step_us", F.lit(step_us).cast("bigint")) \
                       .withColumn("step_months", F.lit(step_months).cast("int"))
    if "month_end" not in bounds.columns:
        bounds = bounds.withColumn("month_end", F.lit(False))
    t0us = micros(F.col("_t0"))
    t1us = micros(F.col("_t1"))
    months_span = ((F.year("_t1") * 12 + F.month("_t1")) - (F.year("_t0") * 12 + F.month("_t0")))
    n_steps = F.when(F.col("step_us").isNotNull(), F.floor((t1us - t0us) / F.col("step_us")))\
               .otherwise(F.floor(months_span / F.col("step_months"))).cast("bigint")
    b = bounds.filter(F.col("step_us").isNotNull() | F.col("step_months").isNotNull()).withColumn("_ns", n_steps)
    chunks = b.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_ns") / REINDEX_CHUNK)
                                                     .cast("bigint"))))
    # round-robin: spread the chunks of a long series over tasks before expanding them
    chunks = chunks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lo = F.col("_c") * REINDEX_CHUNK
    hi = F.least(F.col("_ns"), lo + (REINDEX_CHUNK - 1))
    grid = chunks.withColumn("_i", F.explode(F.sequence(lo, hi)))
    fixed_ts = F.timestamp_micros(t0us + F.col("_i") * F.col("step_us"))
    month_ts = F.add_months(F.col("_t0").cast("timestamp"), (F.col("_i") * F.col("step_months")).cast("int"))
    month_ts = F.when(F.col("month_end"), F.last_day(month_ts)).otherwise(month_ts.cast("date"))
    month_ts = F.timestamp_micros(F.unix_micros(F.date_trunc("day", month_ts.cast("timestamp")))
                                  + (t0us - F.unix_micros(F.date_trunc("day", F.col("_t0").cast("timestamp")))))
    g_ts = F.when(F.col("step_us").isNotNull(), fixed_ts).otherwise(month_ts)
    if was_ntz:
        g_ts = g_ts.cast("timestamp_ntz")
    elif isinstance(df.schema[ts].dataType, T.DateType):
        g_ts = g_ts.cast("date")
    grid = grid.select(*[q(k).alias(f"__g{i}") for i, k in enumerate(keys)], g_ts.alias("__gts"))
    data = df.select(*[q(c).alias(f"__d{i}") for i, c in enumerate(df.columns)])
    pos = {c: i for i, c in enumerate(df.columns)}
    cond = [F.col("__gts") == F.col(f"__d{pos[ts]}")] + \
           [F.col(f"__g{i}").eqNullSafe(F.col(f"__d{pos[k]}")) for i, k in enumerate(keys)]
    joined = grid.join(data, cond, "left")
    out = []
    for c in df.columns:
        if c == ts:
            out.append(F.col("__gts").alias(c))
        elif c in keys:
            out.append(F.col(f"__g{keys.index(c)}").alias(c))
        else:
            out.append(F.col(f"__d{pos[c]}").alias(c))
    return joined.select(*out)


def load_series(df: DataFrame, ts: str, target: str, key=None, step_us: int | None = None,
                step_months: int | None = None, formats: Sequence[str] | None = None) -> DataFrame:
    """Both columns must exist; parse text dates (any unparsable -> error), infer
    the frequency per series unless given (none -> error), re-index to it."""
    for c in [ts, target, *keys_of(key)]:
        if c not in df.columns:
            raise ValueError(f"column {c!r} not found")
    x = df
    if _is_text(df, ts):
        x = parse_dates(df, ts, formats, mode="any")
        bad = x.filter(q(ts).isNull()).limit(1).count()
        if bad:
            raise ValueError(f"column {ts!r} holds values that are not dates")
    if step_us is None and step_months is None:
        steps = infer_step(x, ts, key)
        missing = steps.filter(F.col("step_us").isNull() & F.col("step_months").isNull()).limit(1).count()
        if missing:
            raise ValueError("could not infer a frequency for at least one series")
        return reindex(x, ts, key, steps=steps)
    return reindex(x, ts, key, step_us=step_us, step_months=step_months)
