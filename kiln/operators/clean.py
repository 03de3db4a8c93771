"""Cell- and column-level cleaning (C1-C14) and the declarative cleaning list.

Each operator is one projection or one filter over the whole table; per-column
statistics of an operator are fused into a single aggregate whose one-row result is
injected back as literals, so filters stay pushable and no row passes through the driver.
Functions that report return ``(DataFrame, dict)``; ``report_table`` turns a report into a
long, queryable table.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.exprs import (INTEGER_TEXT, MISSING_CATEGORY, NUMERIC_TEXT, PANDAS_NA_TOKENS,
                                  is_blank, nan_to_null, numeric_columns, q, string_columns, strip_ws)
from kiln.functions.quantiles import exact_quantiles

# Numeric fill strategy names accepted by the cleaning list (both spellings).
FILL_MEAN = ("mean", "media")
FILL_VALUE = ("value", "valor")
FILL_DROP = ("drop", "eliminar")
FILL_KEEP = ("keep", "dejar")


def _float_like(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


# ----------------------------------------------------------------------------- C1
def trim_columns(df: DataFrame) -> DataFrame:
    """Strip whitespace from column names; fail if two names collide afterwards."""
    new = [c.strip() for c in df.columns]
    if len(set(new)) != len(new):
        raise ValueError(f"trimmed column names collide: {new}")
    return df.toDF(*new)


# ----------------------------------------------------------------------------- C2
def trim_cells(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Python ``str.strip`` on string cells; other types untouched (one projection)."""
    targets = set(string_columns(df, cols))
    return df.select(*[strip_ws(q(c)).alias(c) if c in targets else q(c) for c in df.columns])


# ----------------------------------------------------------------------------- C3
def blank_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Cells matching ``^\\s*$`` become NULL."""
    targets = set(string_columns(df, cols))
    return df.select(*[F.when(is_blank(q(c)), F.lit(None)).otherwise(q(c)).alias(c) if c in targets else q(c)
                       for c in df.columns])


def na_tokens_to_null(df: DataFrame, tokens: Sequence[str] = PANDAS_NA_TOKENS,
                      cols: Sequence[str] | None = None) -> DataFrame:
    """The pandas ``read_csv`` missing tokens become NULL (applied to raw text cells)."""
    targets = set(string_columns(df, cols))
    toks = list(tokens)
    return df.select(*[F.when(q(c).isin(toks), F.lit(None)).otherwise(q(c)).alias(c) if c in targets else q(c)
                       for c in df.columns])


# ----------------------------------------------------------------------------- C4
def numeric_text_flags(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, tuple[bool, bool]]:
    """{col: (all non-null values numeric text, all integer text)} in one aggregate."""
    targets = string_columns(df, cols)
    if not targets:
        return {}
    aggs = []
    for i, c in enumerate(targets):
        aggs.append(F.bool_and(q(c).isNull() | q(c).rlike(NUMERIC_TEXT)).alias(f"n{i}"))
        aggs.append((F.bool_and(q(c).isNull() | q(c).rlike(INTEGER_TEXT)) & (F.count(q(c)) > 0)).alias(f"i{i}"))
    row = df.agg(*aggs).first()
    # A column without values is vacuously numeric, but double, as pandas has it.
    return {c: (row[f"n{i}"] is not False, bool(row[f"i{i}"])) for i, c in enumerate(targets)}


def cast_numeric_columns(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """String columns whose every non-null value is digits (after dropping the first '.')
    become numeric: ``bigint`` when all are integers, otherwise ``double``. Negative, signed
    or exponent text is left alone. An all-NULL string column converts to double."""
    flags = numeric_text_flags(df, cols)
    converted = [c for c, (num, _) in flags.items() if num]
    exprs = []
    for c in df.columns:
        if c in converted:
            exprs.append(q(c).try_cast("bigint" if flags[c][1] else "double").alias(c))
        else:
            exprs.append(q(c))
    out = df.select(*exprs)
    return out, converted


# ----------------------------------------------------------------------------- C5 / C6
def drop_duplicates(df: DataFrame, sort: bool = False, include: bool = True) -> DataFrame:
    """Exact duplicate rows removed (NULLs equal). ``sort`` orders the output by all
    columns (NULLS LAST) like the time-series variant."""
    if not include:
        return df
    out = df.dropDuplicates()
    if sort:
        out = out.orderBy(*[q(c).asc_nulls_last() for c in df.columns])
    return out


def duplicates_report(df: DataFrame) -> int:
    row = df.agg(F.count(F.lit(1)).alias("n")).first()
    n_distinct = df.dropDuplicates().count()
    return int(row["n"]) - int(n_distinct)


# ----------------------------------------------------------------------------- C7-C10
def missing_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    if not cols:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count_if(q(c).isNull() | (F.isnan(q(c)) if _float_like(types[c]) else F.lit(False))).alias(f"m{i}")
            for i, c in enumerate(cols)]
    row = df.agg(*aggs).first()
    return {c: int(row[f"m{i}"]) for i, c in enumerate(cols)}


def missing_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, missing) for the given columns from one aggregate (NaN counts as missing)."""
    cols = list(cols or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    agg = df.agg(*[F.count_if(q(c).isNull() | (F.isnan(q(c)) if _float_like(types[c]) else F.lit(False)))
                   .alias(f"m{i}") for i, c in enumerate(cols)])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").cast("bigint").alias("missing"))
                    for i, c in enumerate(cols)])
    return agg.select(F.explode(arr).alias("r")).select("r.*")


def fill_numeric(df: DataFrame, strategy: str = "mean", value: float | None = None,
                 cols: Sequence[str] | None = None) -> tuple[DataFrame, dict]:
    """Numeric missing values: ``mean`` fill (columns with a gap become double),
    ``value`` fill (only when a value is given), ``drop`` rows with any numeric NULL,
    ``keep``; an unknown strategy leaves the columns alone. NaN counts as missing."""
    out, report, _ = _fill_numeric(df, strategy, value, cols)
    return out, report


def _fill_numeric(df: DataFrame, strategy: str, value, cols: Sequence[str] | None,
                  also: Sequence[Column] = ()) -> tuple[DataFrame, dict, tuple]:
    """``fill_numeric``, and the values of further aggregates of ``df`` taken in the same job."""
    num = numeric_columns(df, cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    base = df.select(*[nan_to_null(q(c)).alias(c) if c in num and _float_like(types[c]) else q(c)
                       for c in df.columns])
    report: dict = {}
    if not num and not also:
        return base, {"numeric_missing_before": {}}, ()
    aggs = [a.alias(f"x{i}") for i, a in enumerate(also)]
    for i, c in enumerate(num):
        aggs.append(F.count_if(q(c).isNull()).alias(f"m{i}"))
        if strategy in FILL_MEAN:
            aggs.append(F.avg(q(c)).alias(f"a{i}"))
    row = base.agg(*aggs).first()
    extra = tuple(row[f"x{i}"] for i in range(len(also)))
    if not num:
        return base, {"numeric_missing_before": {}}, extra
    missing = {c: int(row[f"m{i}"]) for i, c in enumerate(num)}
    report["numeric_missing_before"] = missing
    if strategy in FILL_DROP:
        return base.dropna(how="any", subset=num), report, extra
    if strategy not in FILL_MEAN and strategy not in FILL_VALUE:  # FILL_KEEP and unknown names
        report["numeric_missing_after"] = dict(missing)
        return base, report, extra
    imputations = {}
    fills = {}
    for i, c in enumerate(num):
        if missing[c] == 0:
            continue
        if strategy in FILL_VALUE:
            if value is None:
                continue
            fills[c] = F.coalesce(q(c).cast("double") if not isinstance(value, int) or _float_like(types[c])
                                  else q(c), F.lit(value))
            imputations[c] = {"filled_with": value, "missing_count": missing[c]}
        else:
            mean = row[f"a{i}"]
            if mean is None:
                continue  # all-NULL column stays NULL
            fills[c] = F.coalesce(q(c).cast("double"), F.lit(float(mean)))
            imputations[c] = {"filled_with": "mean", "missing_count": missing[c], "fill_value": float(mean)}
    report["numeric_imputations"] = imputations
    out = base.select(*[fills[c].alias(c) if c in fills else q(c) for c in base.columns])
    return out, report, extra


# ----------------------------------------------------------------------------- C11
def fill_categorical(df: DataFrame, token: str = MISSING_CATEGORY,
                     cols: Sequence[str] | None = None) -> tuple[DataFrame, dict]:
    """String NULL -> ``token``; report counts of the touched columns only."""
    targets = string_columns(df, cols)
    counts = missing_counts(df, targets) if targets else {}
    touched = {c: n for c, n in counts.items() if n > 0}
    out = df.select(*[F.coalesce(q(c), F.lit(token)).alias(c) if c in targets else q(c) for c in df.columns])
    return out, {"categorical_missing_filled": touched}


def fill_categorical_df(df: DataFrame, token: str = MISSING_CATEGORY, cols=None) -> DataFrame:
    """C11 as a pure projection (no report job): usable on streams too."""
    targets = set(string_columns(df, cols))
    return df.select(*[F.coalesce(q(c), F.lit(token)).alias(c) if c in targets else q(c) for c in df.columns])


# ----------------------------------------------------------------------------- C12
def _bound_literals(lo: float, hi: float, dt: T.DataType):
    """Typed literals of a column's own type, so the comparison reaches the scan; bounds beyond
    an integer type's range are cut to it, which keeps the same rows."""
    if isinstance(dt, T.IntegralType):
        bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}.get(type(dt), 64)
        least, most = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
        low, high = math.ceil(lo), math.floor(hi)
        if low > most or high < least:
            return None
        return F.lit(max(low, least)).cast(dt), F.lit(min(high, most)).cast(dt)
    return F.lit(lo).cast(dt), F.lit(hi).cast(dt)


def filter_outliers(df: DataFrame, k: float = 2.5, cols: Sequence[str] | None = None,
                    method: str = "exact", report: bool = False, persist: bool = False) -> tuple[DataFrame, dict]:
    """Sequential IQR filter. For each numeric column in schema order, on the rows that
    survived the earlier columns: if more than one non-null value, keep
    ``Q1 - k*IQR <= x <= Q3 + k*IQR`` (NULL is dropped). Quartiles are linear (pandas).

    The bounds of all columns are computed together on the rows at hand (one pair of jobs), and
    hold up to and including the first column that removes a row, which one more aggregate
    tells; the columns behind it are redone on the survivors, in batches that halve at every
    removal. The result is one filter with literal bounds on the original plan (pushable)."""
    from pyspark import StorageLevel

    num = numeric_columns(df, cols)
    base = df.persist(StorageLevel.MEMORY_AND_DISK) if persist else df
    cond, removed, width = None, {}, max(len(num), 1)
    todo = list(num)
    try:
        while todo:
            cur = base if cond is None else base.filter(cond)
            batch = todo[:width]
            items = F.array(*[F.struct(F.lit(i).alias("c"), q(c).cast("double").alias("v")) for i, c in enumerate(batch)])
            stats = {r["c"]: r for r in exact_quantiles(cur.select(F.explode(items).alias("x")).select("x.*"), "v", [0.25, 0.75],
                                                        by="c", method=method).collect()}
            keeps = []
            for i, c in enumerate(batch):
                r = stats.get(i)
                if r is None or r["n"] <= 1:
                    keeps.append(F.lit(True))
                    continue
                keeps.append(F.coalesce(_within_fences(df, c, r, k), F.lit(False)))
            upto, gone = F.lit(True), []
            for i, keep in enumerate(keeps):
                gone.append(F.count_if(upto & ~keep).alias(f"g{i}"))
                upto = upto & keep
            lost = cur.agg(*gone).first()
            done = next((i for i in range(len(batch)) if lost[i]), len(batch) - 1) + 1
            for i, c in enumerate(batch[:done]):
                if i in stats and stats[i]["n"] > 1:
                    removed[c] = int(lost[i])
                    fence = _within_fences(df, c, stats[i], k)
                    cond = fence if cond is None else cond & fence
            todo = todo[done:]
            width = max(1, width // 2) if done < len(batch) else max(width, 1) * 2
    finally:
        if persist:
            base.unpersist()
    out = df if cond is None else df.filter(cond)
    return out, {"outliers_removed": removed if report else {}}


def _within_fences(df: DataFrame, c: str, r, k: float):
    """The filter of one column from its quartiles."""
    reach = k * (float(r["q1"]) - float(r["q0"]))
    bounds = _bound_literals(float(r["q0"]) - reach, float(r["q1"]) + reach, df.schema[c].dataType)
    return F.lit(False) if bounds is None else (q(c) >= bounds[0]) & (q(c) <= bounds[1])


# ----------------------------------------------------------------------------- C13
def drop_empty_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Drop columns that hold no non-NULL value (one aggregate)."""
    out, empty, _ = _drop_empty_columns(df)
    return out, empty


def _drop_empty_columns(df: DataFrame) -> tuple[DataFrame, list[str], int | None]:
    """``drop_empty_columns``, and the number of rows from the same aggregate (None without columns)."""
    if not df.columns:
        return df, [], None
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    empty = [c for i, c in enumerate(df.columns) if int(row[f"c{i}"]) == 0]
    return df.select(*[q(c) for c in df.columns if c not in empty]), empty, int(row["n"])


# ----------------------------------------------------------------------------- C14 (CL flow)
def clean_table(df: DataFrame, remove_duplicates: bool = True, remove_outliers: bool = True,
                numeric_fill: str = "mean", fill_value=None, outlier_method: str = "exact",
                with_report: bool = True) -> tuple[DataFrame, dict]:
    """The classification cleaning flow in its fixed order: names, trim, blanks, numeric
    text, duplicates, numeric fill, categorical fill, outliers, empty columns. The report's counts
    come from the aggregates that the steps run anyway; only the initial rows are a job of their own."""
    rep: dict = {}
    if with_report:
        rep["initial_columns"] = list(df.columns)
        rep["initial_rows"] = df.count()
    x = trim_columns(df)
    x = trim_cells(x)
    x = blank_to_null(x)
    x, rep["converted_to_numeric"] = cast_numeric_columns(x)
    if remove_duplicates:
        # lineage cut after the dedupe shuffle: the fill and IQR aggregates below read the
        # checkpoint instead of re-running the shuffle once per pass
        x = drop_duplicates(x).checkpoint(eager=True)
    texts = string_columns(x)
    also = [F.count(F.lit(1)), *[F.count_if(q(c).isNull()) for c in texts]] if with_report else []
    x, r, counted = _fill_numeric(x, numeric_fill, fill_value, None, also)
    rep["duplicates_removed"] = 0 if not remove_duplicates else int(rep["initial_rows"] - counted[0]) if with_report else None
    rep.update(r)
    if with_report and numeric_fill in FILL_DROP:  # rows went after the count
        x, r = fill_categorical(x)
        rep.update(r)
    else:
        x = fill_categorical_df(x)
        if with_report:
            rep["categorical_missing_filled"] = {c: int(n) for c, n in zip(texts, counted[1:]) if n}
    if remove_outliers:
        x, r = filter_outliers(x, method=outlier_method, report=with_report)
        rep.update(r)
    else:
        rep["outliers_removed"] = {}
    x, rep["columns_removed_all_na"], rows = _drop_empty_columns(x)
    if with_report:
        rep["final_rows"] = rows if rows is not None else rep["initial_rows"]
        rep["final_columns"] = list(x.columns)
    return x, rep


def report_table(spark: SparkSession, report: dict) -> DataFrame:
    """Flatten a cleaning report into (metric, column, value) rows (values as text)."""
    rows = []
    for metric, val in report.items():
        if isinstance(val, dict):
            for col, v in val.items():
                rows.append((metric, str(col), json.dumps(v, default=str) if isinstance(v, dict) else str(v)))
        elif isinstance(val, list):
            for v in val:
                rows.append((metric, str(v), None))
            if not val:
                rows.append((metric, None, None))
        else:
            rows.append((metric, None, None if val is None else str(val)))
    schema = "metric string, column string, value string"
    return spark.createDataFrame(rows, schema)


def report_numbers(spark: SparkSession, report: dict) -> DataFrame:
    """The numeric facts of a cleaning report as (metric, column, value double)."""
    rows = []

    def add(metric, col, val):
        rows.append((metric, col, None if val is None else float(val)))

    for key in ("initial_rows", "duplicates_removed", "final_rows"):
        if report.get(key) is not None:
            add(key, None, report[key])
    for key in ("numeric_missing_before", "categorical_missing_filled", "outliers_removed"):
        for col, v in (report.get(key) or {}).items():
            add(key, col, v)
    for col, imp in (report.get("numeric_imputations") or {}).items():
        add("numeric_imputations.missing_count", col, imp.get("missing_count"))
        if "fill_value" in imp:
            add("numeric_imputations.fill_value", col, round(float(imp["fill_value"]), 6))
    for col in report.get("columns_removed_all_na") or []:
        add("columns_removed_all_na", col, None)
    if "converted_to_numeric" in report:
        add("converted_to_numeric", None, len(report["converted_to_numeric"]))
    return spark.createDataFrame(rows, "metric string, column string, value double")


# ----------------------------------------------------------------------------- C15
def apply_cleaning(df: DataFrame, spec, strict: bool = False, mandatory: bool = True,
                   with_regularity: bool = False) -> tuple[DataFrame, dict]:
    """Time-series cleaning: mandatory steps (names, trim, blanks, numeric text,
    categorical fill, empty columns), then the optional list ``{"cleaning_methods":
    [{"method", "params"}]}`` in the given order. Malformed JSON or a missing key is a
    no-op; unknown names are ignored unless ``strict``. Date methods need ``date_column``
    (and ``order_cols`` for imputation). ``with_regularity`` adds the regularity verdict of
    the first column to the report, as the reference records it."""
    rep: dict = {}
    x = df
    if mandatory:
        x = trim_columns(x)
        x = trim_cells(x)
        x = blank_to_null(x)
        x, rep["converted_to_numeric"] = cast_numeric_columns(x)
        x, r = fill_categorical(x)
        rep.update(r)
        x, rep["columns_removed_all_na"] = drop_empty_columns(x)
    for name, params in parse_cleaning_spec(spec, strict=strict):
        if name == "drop_duplicates":
            x = drop_duplicates(x, include=params.get("include", True))
            if params.get("include", True):
                x = x.checkpoint(eager=True)  # later aggregate passes read this, not the shuffle
        elif name == "fill_missing_numeric_values":
            x, r = fill_numeric(x, params.get("method", "media"), params.get("value"))
            rep.update(r)
        elif name == "filter_outliers":
            x, r = filter_outliers(x)
            rep.update(r)
        elif name in ("standardize_date_to_utc", "standardize_date_retain_timezone"):
            col = params.get("date_column")
            if not col:
                continue
            x, rep["date_standardization"] = _date_step(x, name, col, params)
    if with_regularity and x.columns:
        from kiln.operators import dates  # local import: dates depends on clean

        row = dates.is_regular(x).first()
        rep["is_time_series_regular"] = None if row is None else row["is_regular"]
    return x, rep


def _date_step(x: DataFrame, name: str, col: str, params: dict) -> tuple[DataFrame, dict]:
    """One recorded date method: standardise (to UTC, or keeping the offset), fill dates that are
    missing or did not parse, spread repeated timestamps; with what was found on the way. Filling
    and spreading need a row order, which Spark does not have by itself: without ``order_cols``
    they are left out, and the report says so."""
    from kiln.operators import dates  # local import: dates depends on clean

    strategy = params.get("imputation_strategy", "mean_timedelta")
    order, key = params.get("order_cols"), params.get("key")
    before = x.agg(F.count(q(col))).first()[0]
    samples = dates.preview_dates(x, col, mode="utc" if name == "standardize_date_to_utc" else "keep", order_cols=order)
    out = {"column": col, "samples": [r.asDict() for r in samples.collect()]}  # five rows
    if name == "standardize_date_to_utc":
        x = dates.to_utc(x, col)
        out["timezone"] = "UTC"
    else:
        x = dates.keep_tz(x, col)
        out["timezone"] = dates.zone_label(x, f"{col}_offset_minutes")
    row = x.agg(F.count(q(col)).alias("n"), F.count_if(q(col).isNull()).alias("m")).first()
    out |= {"parse_failures": int(before - row["n"]), "invalid_dates_found": int(row["m"])}
    if not order:
        return x, out | {"strategy": "skipped: no order_cols"}
    out["strategy"] = strategy
    if strategy != "leave_as_is":
        x = dates.impute_dates(x, col, order_cols=order, strategy=strategy, key=key)
    out["duplicate_timestamps"] = dates.duplicate_timestamp_count(x, col, key)
    if out["duplicate_timestamps"]:
        x = dates.spread_duplicates(x, col, order, key=key)
    return x, out


# Method names as recorded lists of steps spell them.
KNOWN_METHODS = ("drop_duplicates", "fill_missing_numeric_values", "filter_outliers",
                 "standardize_date_to_utc", "standardize_date_retain_timezone")


def parse_cleaning_spec(spec, strict: bool = False) -> list[tuple[str, dict]]:
    if not spec:
        return []
    if isinstance(spec, str):
        try:
            spec = json.loads(spec)
        except json.JSONDecodeError:
            if strict:
                raise
            return []
    if not isinstance(spec, dict) or "cleaning_methods" not in spec:
        return []
    out = []
    for m in spec["cleaning_methods"]:
        name = m.get("method")
        if name not in KNOWN_METHODS:
            if strict:
                raise ValueError(f"unknown cleaning method {name!r}")
            continue
        out.append((name, m.get("params", {}) or {}))
    return out
