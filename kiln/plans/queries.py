"""Per-operator queries registered into :mod:`kiln.plans.catalog`, each with the DuckDB
SQL that computes the same result (omitted only where SQL cannot express the operator:
model fitting, Q-Q points, PACF, file round trips of formats DuckDB does not read here).

Naming: ``<survey id>_<what>``; every query reads whole driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.functions.exprs import r6
from kiln.operators import clean
from kiln.plans.catalog import SQL_DIRTY_EVENTS, register, sql_iqr_chain, sql_strip
from kiln.plans.tables import dirty_events, table
from kiln.sources import files


def _r6_cols(df: DataFrame, cols) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


# =============================================================================== sources
@register("s2_scan_csv", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer
""")
def q_s2(spark: SparkSession, sf: str) -> DataFrame:
    """Write customer as CSV in the scratch folder, scan it back with type inference."""
    path = files.scratch_path(spark, "s2-csv")
    files.write_table(table(spark, sf, "customer"), path, fmt="csv")
    return files.scan_csv(spark, path)


@register("s3_scan_arff", """
SELECT CAST(doc_id AS DOUBLE) AS doc_id, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic
FROM labels
""")
def q_s3(spark: SparkSession, sf: str) -> DataFrame:
    path = files.scratch_path(spark, "s3-arff")
    files.write_arff(table(spark, sf, "labels"), path, relation="labels")
    return files.scan_arff(spark, path)


@register("s2_csv_text_round_trip", "SELECT doc_id, text FROM documents")
def q_s2t(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts with quotes and line feeds through a CSV file."""
    path = files.scratch_path(spark, "s2-text")
    files.write_table(table(spark, sf, "documents").select("doc_id", "text"), path, fmt="csv")
    return files.scan_csv(spark, path, multiline=True)


@register("s3_arff_text_round_trip", """
SELECT CAST(doc_id AS DOUBLE) AS doc_id, text, url, html FROM (
  SELECT doc_id, text, NULL AS url, NULL AS html FROM documents UNION ALL SELECT page_id, NULL, url, html FROM pages)""")
def q_s3t(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts and pages through ARFF files of different layouts."""
    path = files.scratch_path(spark, "s3-text")
    files.write_arff(table(spark, sf, "documents").select("doc_id", "text"), f"{path}/a")
    files.write_arff(table(spark, sf, "pages").select("url", F.col("page_id").alias("doc_id"), "html"), f"{path}/b")
    return files.scan_arff(spark, f"{path}/*").select("doc_id", "text", "url", "html")


@register("s4_write_table", "SELECT * FROM orders")
def q_s4(spark: SparkSession, sf: str) -> DataFrame:
    path = files.scratch_path(spark, "s4-parquet")
    files.write_table(table(spark, sf, "orders"), path)
    return spark.read.parquet(path)


@register("s5_write_by_series", "SELECT * FROM events")
def q_s5(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    path = files.scratch_path(spark, "s5-series")
    files.write_by_series(ev, path, "event_type")
    return spark.read.parquet(path).select(*ev.columns)


@register("s6_take_bytes", """
WITH b AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
         strlen(concat_ws(',', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus,
                          o_orderpriority)) + 1 AS nb
  FROM orders)
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM (
  SELECT *, sum(nb) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM b)
WHERE cum <= 200000
""")
def q_s6(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return files.take_bytes(o, ["o_orderkey"], 200_000)


@register("s7_first_n_plus_last", "SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate FROM lineitem")
def q_s7(spark: SparkSession, sf: str) -> DataFrame:
    return files.first_n_plus_last(table(spark, sf, "lineitem"), 3)


@register("s8_preview", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100")
def q_s8(spark: SparkSession, sf: str) -> DataFrame:
    return files.preview(table(spark, sf, "lineitem"), 100, ["l_orderkey", "l_linenumber"])


# =============================================================================== cleaning
_TRIMMED = f"(SELECT event_id, ts, user_id, {sql_strip('event_type')} AS event_type, value FROM ({SQL_DIRTY_EVENTS}))"
_BLANKED = ("(SELECT event_id, ts, user_id, CASE WHEN regexp_matches(event_type, '^\\s*$') THEN NULL "
            f"ELSE event_type END AS event_type, value FROM {_TRIMMED})")


@register("c1_trim_column_names", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_c1(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    padded = ev.select(*[F.col(c).alias(f"  {c} ") for c in ev.columns])
    return clean.trim_columns(padded)


@register("c2_trim_cells", f"SELECT event_id, {sql_strip('event_type')} AS event_type FROM ({SQL_DIRTY_EVENTS})")
def q_c2(spark: SparkSession, sf: str) -> DataFrame:
    return clean.trim_cells(dirty_events(spark, sf)).select("event_id", "event_type")


@register("c3_blank_to_null", f"""
SELECT event_id, CASE WHEN regexp_matches(event_type, '^\\s*$') THEN NULL ELSE event_type END AS event_type
FROM ({SQL_DIRTY_EVENTS})""")
def q_c3(spark: SparkSession, sf: str) -> DataFrame:
    return clean.blank_to_null(dirty_events(spark, sf)).select("event_id", "event_type")


@register("c4_cast_numeric_text", """
SELECT event_id, CAST(user_id AS BIGINT) AS user_txt, event_type,
       concat('-', CAST(user_id AS VARCHAR)) AS neg_txt, value AS value_txt
FROM events""")
def q_c4(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    x = ev.select("event_id", F.col("user_id").cast("string").alias("user_txt"), "event_type",
                  F.concat(F.lit("-"), F.col("user_id").cast("string")).alias("neg_txt"),
                  F.col("value").cast("string").alias("value_txt"))
    out, _ = clean.cast_numeric_columns(x)
    return out


@register("c5_drop_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def q_c5(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return clean.drop_duplicates(li)


@register("c6_drop_duplicates_sorted", """
SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem
ORDER BY l_returnflag, l_linestatus, l_quantity""")
def q_c6(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return clean.drop_duplicates(li, sort=True)


@register("c7_fill_numeric_mean", f"""
WITH de AS ({SQL_DIRTY_EVENTS})
SELECT event_id, user_id, round(coalesce(value, (SELECT avg(value) FROM de)), 6) AS value FROM de""")
def q_c7(spark: SparkSession, sf: str) -> DataFrame:
    x, _ = clean.fill_numeric(dirty_events(spark, sf).select("event_id", "user_id", "value"), "mean")
    return _r6_cols(x, ["value"])


@register("c8_fill_numeric_value", f"""
SELECT event_id, user_id, coalesce(value, -1.0::DOUBLE) AS value FROM ({SQL_DIRTY_EVENTS})""")
def q_c8(spark: SparkSession, sf: str) -> DataFrame:
    x, _ = clean.fill_numeric(dirty_events(spark, sf).select("event_id", "user_id", "value"), "value", -1.0)
    return x


@register("c9_drop_numeric_nulls", f"""
SELECT event_id, ts, user_id, event_type, value FROM ({SQL_DIRTY_EVENTS}) WHERE value IS NOT NULL""")
def q_c9(spark: SparkSession, sf: str) -> DataFrame:
    x, _ = clean.fill_numeric(dirty_events(spark, sf), "drop")
    return x


@register("c10_missing_counts", f"""
WITH de AS ({SQL_DIRTY_EVENTS})
SELECT 'event_id' AS "column", CAST(count(*) - count(event_id) AS BIGINT) AS missing FROM de
UNION ALL SELECT 'user_id', CAST(count(*) - count(user_id) AS BIGINT) FROM de
UNION ALL SELECT 'value', CAST(count(*) - count(value) AS BIGINT) FROM de""")
def q_c10(spark: SparkSession, sf: str) -> DataFrame:
    x, _ = clean.fill_numeric(dirty_events(spark, sf), "keep")
    return clean.missing_table(x, ["event_id", "user_id", "value"])


@register("c11_fill_categorical", f"SELECT event_id, coalesce(event_type, 'vacio') AS event_type FROM {_BLANKED}")
def q_c11(spark: SparkSession, sf: str) -> DataFrame:
    x = clean.blank_to_null(clean.trim_cells(dirty_events(spark, sf)))
    return clean.fill_categorical_df(x).select("event_id", "event_type")


def _iqr_sql(src_sql: str, cols: list[str], select: str = "*") -> str:
    ctes, last = sql_iqr_chain("src", cols, "q")
    return f"WITH src AS ({src_sql}),\n{ctes}\nSELECT {select} FROM {last}"


@register("c12_outliers_events", _iqr_sql("SELECT * FROM events", ["event_id", "user_id", "value"]))
def q_c12e(spark: SparkSession, sf: str) -> DataFrame:
    x, _ = clean.filter_outliers(table(spark, sf, "events"))
    return x


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax"]


@register("c12_outliers_lineitem", _iqr_sql("SELECT * FROM lineitem", _LI_NUM))
def q_c12l(spark: SparkSession, sf: str) -> DataFrame:
    x, _ = clean.filter_outliers(table(spark, sf, "lineitem"))
    return x


@register("c13_drop_empty_columns", f"SELECT event_id, ts, user_id, event_type, value FROM ({SQL_DIRTY_EVENTS})")
def q_c13(spark: SparkSession, sf: str) -> DataFrame:
    x, _ = clean.drop_empty_columns(dirty_events(spark, sf, with_empty=True))
    return x


def _cl_flow_sql(final_select: str) -> str:
    iqr, last = sql_iqr_chain("cf", ["event_id", "user_id", "value"], "ci")
    return f"""
WITH cb AS ({_BLANKED}),
cf AS (SELECT event_id, ts, user_id, coalesce(event_type, 'vacio') AS event_type,
              coalesce(value, (SELECT avg(value) FROM cb)) AS value FROM cb),
{iqr}
{final_select.format(last=last)}"""


@register("c14_clean_table", _cl_flow_sql(
    "SELECT event_id, ts, user_id, event_type, round(value, 6) AS value FROM {last}"))
def q_c14(spark: SparkSession, sf: str) -> DataFrame:
    x, _ = clean.clean_table(dirty_events(spark, sf, with_empty=True), with_report=False)
    return _r6_cols(x, ["value"])


_C14_REPORT_SQL = """
WITH de AS (""" + SQL_DIRTY_EVENTS + """),
cb AS (""" + _BLANKED + """),
cf AS (SELECT event_id, ts, user_id, coalesce(event_type, 'vacio') AS event_type,
              coalesce(value, (SELECT avg(value) FROM cb)) AS value FROM cb),
""" + sql_iqr_chain("cf", ["event_id", "user_id", "value"], "ci")[0] + """
SELECT 'initial_rows' AS metric, CAST(NULL AS VARCHAR) AS "column", CAST(count(*) AS DOUBLE) AS value FROM de
UNION ALL SELECT 'duplicates_removed', NULL, 0.0::DOUBLE
UNION ALL SELECT 'numeric_missing_before', 'event_id', 0.0::DOUBLE
UNION ALL SELECT 'numeric_missing_before', 'user_id', 0.0::DOUBLE
UNION ALL SELECT 'numeric_missing_before', 'value', CAST(count(*) - count(value) AS DOUBLE) FROM cb
UNION ALL SELECT 'numeric_missing_before', 'empty_col', CAST(count(*) AS DOUBLE) FROM cb
UNION ALL SELECT 'numeric_imputations.missing_count', 'value', CAST(count(*) - count(value) AS DOUBLE) FROM cb
UNION ALL SELECT 'numeric_imputations.fill_value', 'value', round(avg(value), 6) FROM cb
UNION ALL SELECT 'categorical_missing_filled', 'event_type', CAST(count(*) - count(event_type) AS DOUBLE) FROM cb
UNION ALL SELECT 'outliers_removed', 'event_id', CAST((SELECT count(*) FROM cf) - (SELECT count(*) FROM ci_f0) AS DOUBLE)
UNION ALL SELECT 'outliers_removed', 'user_id', CAST((SELECT count(*) FROM ci_f0) - (SELECT count(*) FROM ci_f1) AS DOUBLE)
UNION ALL SELECT 'outliers_removed', 'value', CAST((SELECT count(*) FROM ci_f1) - (SELECT count(*) FROM ci_f2) AS DOUBLE)
UNION ALL SELECT 'columns_removed_all_na', 'empty_col', NULL
UNION ALL SELECT 'converted_to_numeric', NULL, 0.0::DOUBLE
UNION ALL SELECT 'final_rows', NULL, CAST(count(*) AS DOUBLE) FROM ci_f2
"""


@register("c14_clean_report", _C14_REPORT_SQL)
def q_c14r(spark: SparkSession, sf: str) -> DataFrame:
    _, rep = clean.clean_table(dirty_events(spark, sf, with_empty=True), with_report=True)
    return clean.report_numbers(spark, rep)


_C15_SPEC = {"cleaning_methods": [
    {"method": "drop_duplicates", "params": {"include": True}},
    {"method": "fill_missing_numeric_values", "params": {"method": "valor", "value": 0}},
    {"method": "filter_outliers"},
    {"method": "not_a_method"},
]}


@register("c15_apply_cleaning_spec", f"""
WITH cb AS ({_BLANKED}),
cv AS (SELECT DISTINCT event_id, ts, user_id, coalesce(event_type, 'vacio') AS event_type, value FROM cb),
cf AS (SELECT event_id, ts, user_id, event_type, coalesce(value, 0.0::DOUBLE) AS value FROM cv),
{sql_iqr_chain("cf", ["event_id", "user_id", "value"], "ci")[0]}
SELECT * FROM ci_f2""")
def q_c15(spark: SparkSession, sf: str) -> DataFrame:
    x, _ = clean.apply_cleaning(dirty_events(spark, sf, with_empty=True), _C15_SPEC)
    return x


_C15_DATES = {"cleaning_methods": [{"method": "standardize_date_to_utc", "params": {"date_column": "ts_text", "order_cols": ["event_id"]}}]}


@register("c15_date_step", """
WITH t AS (SELECT event_id, CASE WHEN event_id % 10 = 4 THEN NULL ELSE epoch_us(date_trunc('hour', ts)) END AS us FROM events),
n AS (SELECT event_id, us, lag(us) OVER w AS p, lead(us) OVER w AS nx FROM t WINDOW w AS (ORDER BY event_id)),
f AS (SELECT event_id, coalesce(us, nx - (abs(nx - p) + 1) // 2 * sign(nx - p)) AS us FROM n),
d AS (SELECT event_id, us, CASE WHEN lag(us) OVER w = us THEN 1 ELSE 0 END AS dup FROM f WINDOW w AS (ORDER BY us, event_id)),
i AS (SELECT event_id, us, dup, sum(dup) OVER (ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM d)
SELECT event_id, CAST(us + CASE WHEN dup = 1 THEN i * 1000 ELSE 0 END AS BIGINT) AS us FROM i""")
def q_c15d(spark: SparkSession, sf: str) -> DataFrame:
    """Hours as text, every tenth one bad: parsed, the bad ones filled, repeated ones spread."""
    hour = F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss")
    ev = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 == 4, "bad").otherwise(hour).alias("ts_text"))
    x, _ = clean.apply_cleaning(ev, _C15_DATES, mandatory=False)
    return x.select("event_id", F.unix_micros(F.col("ts_text")).alias("us"))


# =============================================================================== dates
from kiln.operators import dates  # noqa: E402
from kiln.plans.tables import dirty_orders_dates, holey_events_ts  # noqa: E402

_SQL_ORDERS_TEXT = ("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'bad' "
                    "ELSE strftime(o_orderdate, '%d/%m/%Y') END AS o_date_text FROM orders")
_SQL_ZONED = ("SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'bad' ELSE concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), "
              "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '+02:00' ELSE '-0530' END) END AS ts_text FROM events")
_SQL_HOLEY = ("SELECT event_id, CASE WHEN event_id % 10 IN (3, 4) OR event_id < 2 THEN NULL ELSE ts END AS ts, "
              "event_type, value FROM events")
_ZONE_RE = "([+-])(\\d{2}):?(\\d{2})$"


def zoned_events(spark: SparkSession, sf: str) -> DataFrame:
    """Timestamp text with '+02:00', '-0530' or no offset; every 13th id is 'bad'."""
    ev = table(spark, sf, "events")
    suffix = (F.when(F.col("event_id") % 3 == 0, F.lit("")).when(F.col("event_id") % 3 == 1, F.lit("+02:00"))
               .otherwise(F.lit("-0530")))
    txt = F.when(F.col("event_id") % 13 == 0, F.lit("bad")).otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), suffix))
    return ev.select("event_id", txt.alias("ts_text"))


@register("d1_parse_dates", f"""
WITH t AS ({_SQL_ORDERS_TEXT}),
f AS (SELECT first(o_date_text ORDER BY o_orderkey) AS v FROM t WHERE o_date_text IS NOT NULL),
m AS (SELECT CASE WHEN try_strptime(v, '%m/%d/%Y') IS NOT NULL THEN 'month' WHEN try_strptime(v, '%d/%m/%Y') IS NOT NULL THEN 'day'
                  ELSE 'each' END AS mode FROM f)
SELECT o_orderkey, CASE mode WHEN 'month' THEN try_strptime(o_date_text, '%m/%d/%Y') WHEN 'day' THEN try_strptime(o_date_text, '%d/%m/%Y')
                             ELSE coalesce(try_strptime(o_date_text, '%m/%d/%Y'), try_strptime(o_date_text, '%d/%m/%Y')) END AS parsed
FROM t, m""")
def q_d1(spark: SparkSession, sf: str) -> DataFrame:
    x = dates.parse_dates(dirty_orders_dates(spark, sf), "o_date_text", mode="first", order_cols=["o_orderkey"],
                          out="parsed")
    return x.select("o_orderkey", "parsed")


@register("d2_to_utc", f"""
SELECT event_id, CAST(coalesce(epoch_us(try_strptime(ts_text, '%Y-%m-%d %H:%M:%S%z')),
                          epoch_us(try_strptime(ts_text, '%Y-%m-%d %H:%M:%S'))) AS DOUBLE) AS utc_us
FROM ({_SQL_ZONED})""")
def q_d2(spark: SparkSession, sf: str) -> DataFrame:
    x = dates.to_utc(zoned_events(spark, sf), "ts_text", out="utc")
    # nullable integers are returned as double (exact below 2^53) so both engines agree
    return x.select("event_id", F.unix_micros("utc").cast("double").alias("utc_us"))


@register("d3_keep_timezone", f"""
WITH z AS ({_SQL_ZONED}),
p AS (SELECT event_id, ts_text,
             coalesce(try_strptime(ts_text, '%Y-%m-%d %H:%M:%S%z'), try_strptime(ts_text, '%Y-%m-%d %H:%M:%S')) AS ok
      FROM z)
SELECT event_id,
       CASE WHEN ok IS NOT NULL THEN try_strptime(regexp_replace(ts_text, '{_ZONE_RE}', ''), '%Y-%m-%d %H:%M:%S') END
         AS local_ts,
       CASE WHEN ok IS NOT NULL AND regexp_matches(ts_text, '{_ZONE_RE}') THEN
         CAST((CASE WHEN regexp_extract(ts_text, '{_ZONE_RE}', 1) = '-' THEN -1 ELSE 1 END) *
              (CAST(regexp_extract(ts_text, '{_ZONE_RE}', 2) AS INTEGER) * 60 +
               CAST(regexp_extract(ts_text, '{_ZONE_RE}', 3) AS INTEGER)) AS DOUBLE) END AS offset_minutes
FROM p""")
def q_d3(spark: SparkSession, sf: str) -> DataFrame:
    x = dates.keep_tz(zoned_events(spark, sf), "ts_text", out="local_ts", offset_col="offset_minutes")
    return x.select("event_id", "local_ts", F.col("offset_minutes").cast("double").alias("offset_minutes"))


@register("d4_preview_dates", f"""
WITH z AS ({_SQL_ZONED} ORDER BY event_id LIMIT 5),
p AS (SELECT ts_text, coalesce(epoch_us(try_strptime(ts_text, '%Y-%m-%d %H:%M:%S%z')),
                               epoch_us(try_strptime(ts_text, '%Y-%m-%d %H:%M:%S'))) AS us FROM z)
SELECT ts_text AS original,
       CASE WHEN us IS NOT NULL THEN strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS transformed,
       CASE WHEN us IS NULL THEN 'could not parse: ' || ts_text END AS warning
FROM p""")
def q_d4(spark: SparkSession, sf: str) -> DataFrame:
    return dates.preview_dates(zoned_events(spark, sf), "ts_text", mode="utc", order_cols=["event_id"], n=5)


def _detect_sql(src: str, tested: str, passed: str) -> str:
    """The nine patterns in the order of the survey; every value counts for the first that fits."""
    return f"""
WITH a AS (SELECT o_date_text AS v, row_number() OVER (ORDER BY o_orderkey) AS k FROM ({src}) WHERE o_date_text IS NOT NULL),
t AS (SELECT CASE WHEN try_strptime(v, '%Y-%m-%d') IS NOT NULL THEN 1 WHEN try_strptime(v, '%Y-%m-%d %H:%M:%S') IS NOT NULL THEN 2
                  WHEN try_strptime(v, '%Y-%m-%dT%H:%M:%S') IS NOT NULL THEN 3 WHEN try_strptime(v, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL THEN 4
                  WHEN try_strptime(v, '%Y-%m-%d %H:%M:%S%z') IS NOT NULL THEN 5 WHEN try_strptime(v, '%d/%m/%Y') IS NOT NULL THEN 6
                  WHEN try_strptime(v, '%m/%d/%Y') IS NOT NULL THEN 7 WHEN try_strptime(v, '%d-%m-%Y') IS NOT NULL THEN 8
                  WHEN try_strptime(v, '%Y/%m/%d') IS NOT NULL THEN 9 END AS p,
             regexp_matches(v, '[+Z]|UTC|GMT') AS tz FROM a WHERE {tested}),
b AS (SELECT p, count(*) AS c FROM t WHERE p IS NOT NULL GROUP BY p ORDER BY c DESC, p LIMIT 1)
SELECT coalesce((SELECT ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%d %H:%M:%S%z', '%d/%m/%Y',
                         '%m/%d/%Y', '%d-%m-%Y', '%Y/%m/%d'][p] FROM b), 'Mixed formats') AS detected_format,
       coalesce((SELECT c FROM b), 0)::DOUBLE / (SELECT count(*) FROM a WHERE {passed}) AS success_rate,
       CASE WHEN (SELECT bool_or(tz) FROM t) THEN 'Timezone detected' ELSE 'No timezone detected' END AS timezone_info"""


@register("d5_detect_format", _detect_sql(_SQL_ORDERS_TEXT, "k <= 3", "k <= 5"))
def q_d5(spark: SparkSession, sf: str) -> DataFrame:
    return dates.detect_format(dirty_orders_dates(spark, sf), "o_date_text", order_cols=["o_orderkey"])


@register("d5_detect_format_all", _detect_sql(_SQL_ORDERS_TEXT, "true", "true"))
def q_d5a(spark: SparkSession, sf: str) -> DataFrame:
    return dates.detect_format(dirty_orders_dates(spark, sf), "o_date_text", order_cols=["o_orderkey"],
                               n_samples=None)


def _impute_sql(src: str, order: str, delta_sql: str) -> str:
    return f"""
WITH h AS ({src}),
r AS (SELECT {order} AS o, epoch_us(ts) AS us, row_number() OVER (ORDER BY {order}) - 1 AS rid FROM h),
st AS (SELECT {delta_sql} AS delta, count(us) AS cnt FROM r),
w AS (SELECT *,
        last_value(us IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
        last_value(CASE WHEN us IS NOT NULL THEN rid END IGNORE NULLS)
          OVER (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pp,
        first_value(us IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n
      FROM r),
f AS (SELECT w.o, CASE
        WHEN us IS NOT NULL THEN us
        WHEN st.cnt < 2 THEN NULL
        WHEN p IS NOT NULL AND n IS NOT NULL THEN
          n - sign(n - p) * (CASE WHEN abs(n - p) <= 0 THEN 0 ELSE ((abs(n - p) - 1) >> least(rid - pp, 63)) + 1 END)
        WHEN p IS NOT NULL THEN p + (rid - pp) * st.delta
        WHEN n IS NOT NULL THEN
          n - (CASE WHEN st.delta <= 0 THEN 0 ELSE ((st.delta - 1) >> least(rid, 63)) + 1 END)
      END AS v FROM w, st)
SELECT o AS {order}, make_timestamp(v) AS ts FROM f"""


@register("d6_impute_dates_mean", _impute_sql(
    _SQL_HOLEY, "event_id", "(max(us) - min(us)) // (count(us) - 1)"))
def q_d6(spark: SparkSession, sf: str) -> DataFrame:
    x = dates.impute_dates(holey_events_ts(spark, sf), "ts", order_cols=["event_id"], strategy="mean_timedelta")
    return x.select("event_id", "ts")


def holey_ship_days(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct ship days (ordered by the day itself) with every day-of-month divisible
    by 5 blanked out: a daily series with NULL runs."""
    d = table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("ship_day")).distinct()
    return d.select("ship_day", F.when(F.dayofmonth("ship_day") % 5 == 0, F.lit(None)).otherwise(F.col("ship_day"))
                    .cast("timestamp_ntz").alias("ts"))


_SQL_SHIP = ("SELECT ship_day, CASE WHEN dayofmonth(ship_day) % 5 = 0 THEN NULL ELSE ship_day END AS ts "
             "FROM (SELECT DISTINCT l_shipdate AS ship_day FROM lineitem)")
_SQL_AUTO_DELTA = """(SELECT CASE
  WHEN abs(m / 1e6 - 3600) / 3600 < 0.1 THEN 3600000000
  WHEN abs(m / 1e6 - 86400) / 86400 < 0.1 THEN 86400000000
  WHEN abs(m / 1e6 - 604800) / 604800 < 0.1 THEN 604800000000
  WHEN abs(m / 1e6 - 2628000) / 2628000 < 0.1 THEN 2628000000000
  WHEN abs(m / 1e6 - 31536000) / 31536000 < 0.1 THEN 31536000000000
  ELSE (SELECT (max(us) - min(us)) // (count(us) - 1) FROM r) END
  FROM (SELECT first(g ORDER BY c DESC, g ASC) AS m FROM (
    SELECT g, count(*) AS c FROM (SELECT us - lag(us) OVER (ORDER BY us) AS g FROM r WHERE us IS NOT NULL)
    WHERE g IS NOT NULL GROUP BY g)))"""


@register("d7_impute_dates_auto", _impute_sql(_SQL_SHIP, "ship_day", _SQL_AUTO_DELTA))
def q_d7(spark: SparkSession, sf: str) -> DataFrame:
    x = dates.impute_dates(holey_ship_days(spark, sf), "ts", order_cols=["ship_day"], strategy="auto_detected")
    return x.select("ship_day", "ts")


@register("d8_count_invalid_dates", f"""
SELECT CAST(count(*) - count(ts) AS BIGINT) AS invalid_dates_found FROM ({_SQL_HOLEY})""")
def q_d8(spark: SparkSession, sf: str) -> DataFrame:
    x = dates.impute_dates(holey_events_ts(spark, sf), "ts", order_cols=["event_id"], strategy="leave_as_is")
    return x.agg(F.count_if(F.col("ts").isNull()).cast("bigint").alias("invalid_dates_found"))


def _step_sql(src: str, key: str, ts: str) -> str:
    return f"""
WITH g AS (SELECT {key}, epoch_us({ts}) AS us FROM ({src}) WHERE {ts} IS NOT NULL),
d AS (SELECT {key}, us, us - lag(us) OVER (PARTITION BY {key} ORDER BY us) AS gap FROM g),
m AS (SELECT {key}, first(gap ORDER BY c DESC, gap ASC) AS mode_us FROM (
        SELECT {key}, gap, count(*) AS c FROM d WHERE gap IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT {key}, CASE WHEN count(us) >= 2 THEN (max(us) - min(us)) // (count(us) - 1) END AS mean_us
      FROM g GROUP BY 1),
j AS (SELECT s.{key}, mode_us, coalesce(CASE
        WHEN abs(mode_us / 1e6 - 3600) / 3600 < 0.1 THEN 3600000000
        WHEN abs(mode_us / 1e6 - 86400) / 86400 < 0.1 THEN 86400000000
        WHEN abs(mode_us / 1e6 - 604800) / 604800 < 0.1 THEN 604800000000
        WHEN abs(mode_us / 1e6 - 2628000) / 2628000 < 0.1 THEN 2628000000000
        WHEN abs(mode_us / 1e6 - 31536000) / 31536000 < 0.1 THEN 31536000000000 END, mean_us) AS step_us
      FROM s LEFT JOIN m ON s.{key} = m.{key})
SELECT {key}, CAST(step_us AS BIGINT) AS step_us, step_us / 1e6 AS step_seconds, mode_us / 1e6 AS mode_seconds FROM j"""


@register("d9_detect_step_events", _step_sql("SELECT * FROM events", "event_type", "ts"))
def q_d9e(spark: SparkSession, sf: str) -> DataFrame:
    return dates.detect_step(table(spark, sf, "events"), "ts", key="event_type")


_SQL_DAILY = "SELECT event_type, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, sum(value) AS total, count(*) AS n_events FROM events GROUP BY 1, 2"


def daily_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.groupBy("event_type", F.to_date("ts").cast("timestamp_ntz").alias("day")).agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_events"))


@register("d9_detect_step_daily", _step_sql(_SQL_DAILY, "event_type", "day"))
def q_d9d(spark: SparkSession, sf: str) -> DataFrame:
    return dates.detect_step(daily_events(spark, sf), "day", key="event_type")


@register("d10_spread_duplicates", """
WITH h AS (SELECT event_id, epoch_us(date_trunc('hour', ts)) AS us FROM events),
r AS (SELECT event_id, us, CASE WHEN us = lag(us) OVER (ORDER BY us, event_id) THEN 1 ELSE 0 END AS dup FROM h),
c AS (SELECT *, sum(dup) OVER (ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM r)
SELECT event_id, make_timestamp(CAST(CASE WHEN dup = 1 THEN us + i * 1000 ELSE us END AS BIGINT)) AS ts FROM c""")
def q_d10(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
    return dates.spread_duplicates(ev, "ts", ["event_id"])


def _regular_sql(src: str, key: str, ts: str) -> str:
    return f"""
WITH g AS (SELECT {key}, {ts} AS t, epoch_us({ts}) AS us FROM ({src}) WHERE {ts} IS NOT NULL),
d AS (SELECT {key}, t, us - lag(us) OVER (PARTITION BY {key} ORDER BY us) AS gap,
             (year(t) * 12 + month(t)) - lag(year(t) * 12 + month(t)) OVER (PARTITION BY {key} ORDER BY us) AS dm
      FROM g),
a AS (SELECT {key}, count(*) AS n, quantile_cont(gap / 1e6, 0.5) AS med,
             bool_and(abs(gap - 3600000000) <= 300000000) AS hourly,
             bool_and(gap = 86400000000) AS daily,
             count(DISTINCT dayofmonth(t)) AS dom,
             bool_and(dm = 1) AS months,
             bool_and(gap >= 365 * 86400000000 AND gap <= 366 * 86400000000) AS yearly
      FROM d GROUP BY 1)
SELECT {key}, CASE WHEN n < 2 THEN NULL
  WHEN med <= 2 * 3600 THEN hourly
  WHEN med <= 2 * 86400 THEN daily
  WHEN med <= 2 * 30.5 * 86400 THEN dom = 1 AND months
  WHEN med <= 2 * 365.25 * 86400 THEN yearly
  ELSE false END AS is_regular
FROM a"""


@register("d11_regular_daily", _regular_sql(_SQL_DAILY, "event_type", "day"))
def q_d11d(spark: SparkSession, sf: str) -> DataFrame:
    return dates.is_regular(daily_events(spark, sf), "day", key="event_type")


_SQL_HOURLY = "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2"


@register("d11_regular_hourly", _regular_sql(_SQL_HOURLY, "event_type", "hour"))
def q_d11h(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    h = ev.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).count()
    return dates.is_regular(h, "hour", key="event_type")


_SQL_MONTHLY = ("SELECT l_returnflag, date_trunc('month', l_shipdate) AS month, sum(l_quantity) AS total "
                "FROM lineitem GROUP BY 1, 2")


def monthly_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")).agg(
        F.sum("l_quantity").alias("total"))


@register("d11_regular_monthly", _regular_sql(_SQL_MONTHLY, "l_returnflag", "month"))
def q_d11m(spark: SparkSession, sf: str) -> DataFrame:
    return dates.is_regular(monthly_lineitem(spark, sf), "month", key="l_returnflag")


_SQL_IRREG = ("SELECT l_returnflag, l_shipdate AS day, sum(l_quantity) AS total FROM lineitem "
              "WHERE dayofmonth(l_shipdate) % 9 <> 0 GROUP BY 1, 2")


def irregular_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily quantity per return flag; the date is NULL on every day-of-month divisible by 9, so
    these days are missing from the series. The SQL leaves them out, which is the same series."""
    li = table(spark, sf, "lineitem")
    d = li.groupBy("l_returnflag", F.col("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("total"))
    return d.withColumn("day", F.when(F.dayofmonth("day") % 9 != 0, F.col("day")))


@register("d11_regular_irregular", _regular_sql(_SQL_IRREG, "l_returnflag", "day"))
def q_d11i(spark: SparkSession, sf: str) -> DataFrame:
    return dates.is_regular(irregular_daily(spark, sf), "day", key="l_returnflag")


@register("d13_reindex_daily", f"""
WITH d AS ({_SQL_IRREG}),
k AS (SELECT l_returnflag, min(day) AS d0, max(day) AS d1 FROM d GROUP BY 1),
g AS (SELECT l_returnflag, unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS day FROM k)
SELECT g.l_returnflag, g.day, round(d.total, 6) AS total
FROM g LEFT JOIN d ON g.l_returnflag = d.l_returnflag AND g.day = d.day""")
def q_d13(spark: SparkSession, sf: str) -> DataFrame:
    x = dates.load_series(irregular_daily(spark, sf), "day", "total", key="l_returnflag",
                          step_us=86_400_000_000)
    return _r6_cols(x, ["total"])


@register("d13_load_series_month_end", """
WITH d AS (SELECT l_returnflag, last_day(l_shipdate)::TIMESTAMP AS month, sum(l_quantity) AS total FROM lineitem
           WHERE l_shipdate IS NOT NULL GROUP BY 1, 2),
k AS (SELECT l_returnflag, min(month) AS m0, max(month) AS m1 FROM d GROUP BY 1),
g AS (SELECT l_returnflag, last_day(unnest(generate_series(date_trunc('month', m0), m1, INTERVAL 1 MONTH)))::TIMESTAMP AS month FROM k)
SELECT g.l_returnflag, g.month, round(d.total, 6) AS total
FROM g LEFT JOIN d ON g.l_returnflag = d.l_returnflag AND g.month = d.month""")
def q_d13e(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly totals dated on the last day of each month."""
    li = table(spark, sf, "lineitem").groupBy("l_returnflag", F.last_day("l_shipdate").cast("timestamp_ntz").alias("month")).agg(
        F.sum("l_quantity").alias("total"))
    return _r6_cols(dates.load_series(li, "month", "total", key="l_returnflag"), ["total"])


@register("d13_load_series_monthly", f"""
WITH d AS ({_SQL_MONTHLY}),
k AS (SELECT l_returnflag, min(month) AS m0, max(month) AS m1 FROM d GROUP BY 1),
g AS (SELECT l_returnflag, unnest(generate_series(m0, m1, INTERVAL 1 MONTH)) AS month FROM k)
SELECT g.l_returnflag, g.month, round(d.total, 6) AS total
FROM g LEFT JOIN d ON g.l_returnflag = d.l_returnflag AND g.month = d.month""")
def q_d13m(spark: SparkSession, sf: str) -> DataFrame:
    x = dates.load_series(monthly_lineitem(spark, sf), "month", "total", key="l_returnflag")
    return _r6_cols(x, ["total"])


# =============================================================================== encoding
from kiln.operators import encode  # noqa: E402


@register("e1_one_hot", """
SELECT l_orderkey, l_linenumber, l_quantity,
       CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS l_returnflag_N,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS l_returnflag_R,
       CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS l_linestatus_O
FROM lineitem""")
def q_e1(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    return encode.one_hot(li, ["l_returnflag", "l_linestatus", "l_quantity"])


@register("e2_one_hot_sorted_float", """
SELECT o_orderkey, o_totalprice,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderpriority_2-HIGH",
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderpriority_3-MEDIUM",
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderpriority_4-NOT SPECIFIED",
       CASE WHEN o_orderpriority = '5-LOW' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderpriority_5-LOW"
FROM orders""")
def q_e2(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return encode.one_hot(o, ["o_orderpriority"], dtype="double", sort_columns=True)


@register("e3_one_hot_target", """
SELECT doc_id, toxic,
       CASE WHEN quality = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS quality_0,
       CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS quality_1
FROM labels""")
def q_e3(spark: SparkSession, sf: str) -> DataFrame:
    return encode.one_hot_target(table(spark, sf, "labels"), ["quality"])


@register("e3_one_hot_target_text", """
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o_orderstatus_F,
       CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o_orderstatus_O,
       CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o_orderstatus_P
FROM orders""")
def q_e3t(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return encode.one_hot_target(o, ["o_orderstatus"])


@register("e4_label_encode", """
SELECT o_orderkey,
       CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority,
       CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus
FROM orders""")
def q_e4(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return encode.label_encode(o, ["o_orderpriority", "o_orderstatus"])


@register("e4_label_encode_many", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS INTEGER) AS o_custkey,
       CAST(dense_rank() OVER (ORDER BY o_orderdate) - 1 AS INTEGER) AS o_orderdate FROM orders""")
def q_e4m(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of thousands of values."""
    return encode.label_encode(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey", "o_orderdate"])


@register("e4_label_encode_numeric", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_nationkey) - 1 AS INTEGER) AS c_nationkey FROM customer""")
def q_e4n(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return encode.label_encode(c, ["c_nationkey"])


@register("e5_bool_to_int", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity > 25 AS INTEGER) AS big, CAST(l_discount > 0.05 AS INTEGER) AS disc
FROM lineitem""")
def q_e5(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    x = li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).alias("big"),
                  (F.col("l_discount") > 0.05).alias("disc"))
    return encode.bool_to_int(x)


def daily_rounded(spark: SparkSession, sf: str) -> DataFrame:
    """Daily total (rounded to 6 places, so both engines agree) and count (as double, so
    lagged NULLs look the same in both engines) per event type."""
    d = daily_events(spark, sf)
    return d.select("event_type", "day", r6(F.col("total")).alias("total"), F.col("n_events").cast("double"))


_SQL_DAILY_R = ("SELECT event_type, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, round(sum(value), 6) AS total, "
                "CAST(count(*) AS DOUBLE) AS n_events FROM events GROUP BY 1, 2")


def _lag_sql(src: str, key: str | None, order: str, cols: list[str], n: int, extra_where: str = "") -> str:
    part = f"PARTITION BY {key} " if key else ""
    lags = ", ".join(f"lag({c}, {i}) OVER (w) AS {c}_lag_{i}" for c in cols for i in range(1, n + 1))
    return f"SELECT *, {lags} FROM ({src}) WINDOW w AS ({part}ORDER BY {order}) {extra_where}"


@register("e7_lags_daily", _lag_sql(_SQL_DAILY_R, "event_type", "day", ["total", "n_events"], 3))
def q_e7d(spark: SparkSession, sf: str) -> DataFrame:
    return encode.add_lags(daily_rounded(spark, sf), ["total", "n_events"], 3, order_cols=["day"], key="event_type")


@register("e7_lags_single_series", _lag_sql("SELECT event_id, ts, value FROM events", None, "ts, event_id",
                                            ["value"], 2))
def q_e7s(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "ts", "value")
    return encode.add_lags(ev, ["value"], 2, order_cols=["ts", "event_id"])


@register("e8_lag_nulls_drop", "SELECT * FROM (" + _lag_sql(_SQL_DAILY_R, "event_type", "day", ["total"], 2) + """)
WHERE total_lag_1 IS NOT NULL AND total_lag_2 IS NOT NULL""")
def q_e8(spark: SparkSession, sf: str) -> DataFrame:
    x = encode.add_lags(daily_rounded(spark, sf), ["total"], 2, order_cols=["day"], key="event_type")
    return encode.handle_lag_nulls(x, "drop")


@register("e9_forward_fill", f"""
SELECT event_id,
       last_value(ts IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ts,
       event_type, value
FROM ({_SQL_HOLEY})""")
def q_e9(spark: SparkSession, sf: str) -> DataFrame:
    return encode.handle_lag_nulls(holey_events_ts(spark, sf), "forward_fill", order_cols=["event_id"])


# =============================================================================== splits and windows
from kiln.operators import split, window_fit, windows  # noqa: E402


@register("p1_validate_columns", """
SELECT 'l_quantity' AS "column", CAST(count(*) - count(l_quantity) AS BIGINT) AS null_count, CAST(NULL AS VARCHAR) AS warning FROM lineitem
UNION ALL SELECT 'l_extendedprice', CAST(count(*) - count(l_extendedprice) AS BIGINT), NULL FROM lineitem
UNION ALL SELECT 'l_discount', CAST(count(*) - count(l_discount) AS BIGINT), NULL FROM lineitem
UNION ALL SELECT 'l_returnflag', CAST(count(*) - count(l_returnflag) AS BIGINT), NULL FROM lineitem""")
def q_p1(spark: SparkSession, sf: str) -> DataFrame:
    return split.validate_data(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"],
                               "l_returnflag")


def _strat_sql(src: str, label: str, ids: list[str], ratios=(0.7, 0.15, 0.15), seed: int = 42) -> str:
    temp = ratios[1] + ratios[2]
    frac = ratios[2] / temp
    idl = ", ".join(ids)
    return f"""
WITH h AS (SELECT {idl}, {label}, md5(concat_ws(chr(31), '{seed}', {idl})) AS h FROM ({src})),
r AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY h, {idl}) - 1 AS pos,
             count(*) OVER (PARTITION BY {label}) AS n FROM h),
c AS (SELECT *, ceil(n * {temp!r}::DOUBLE - 1e-9) AS n_temp FROM r),
d AS (SELECT *, ceil(n_temp * {frac!r}::DOUBLE - 1e-9) AS n_test FROM c)
SELECT {idl}, {label}, CASE WHEN pos < n - n_temp THEN 'train'
                            WHEN pos < n - n_temp + (n_temp - n_test) THEN 'val' ELSE 'test' END AS split
FROM d"""


@register("p2_stratified_lineitem", _strat_sql("SELECT * FROM lineitem", "l_returnflag", ["l_orderkey", "l_linenumber"]))
def q_p2(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return split.stratified_split(li, "l_returnflag", (0.7, 0.15, 0.15), id_cols=["l_orderkey", "l_linenumber"])


@register("p2_stratified_labels", _strat_sql("SELECT * FROM labels", "quality", ["doc_id"], (0.6, 0.2, 0.2), 7))
def q_p2l(spark: SparkSession, sf: str) -> DataFrame:
    lb = table(spark, sf, "labels").select("doc_id", "quality")
    return split.stratified_split(lb, "quality", (0.6, 0.2, 0.2), id_cols=["doc_id"], seed=7)


def _temporal_sql(src: str, key: str | None, order: str, cols: str, ratios=(0.7, 0.15, 0.15)) -> str:
    part = f"PARTITION BY {key}" if key else ""
    return f"""
WITH r AS (SELECT {cols}, row_number() OVER ({part} ORDER BY {order}) - 1 AS pos, count(*) OVER ({part}) AS n
           FROM ({src}))
SELECT {cols}, CASE WHEN pos < floor(n * {ratios[0]!r}::DOUBLE) THEN 'train'
                    WHEN pos < floor(n * {ratios[0]!r}::DOUBLE) + floor(n * {ratios[1]!r}::DOUBLE) THEN 'val'
                    ELSE 'test' END AS split
FROM r"""


@register("p3_temporal_keyed", _temporal_sql("SELECT * FROM events", "event_type", "ts, event_id",
                                             "event_id, event_type"))
def q_p3k(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return split.temporal_split(ev, order_cols=["ts", "event_id"], key="event_type").drop("ts")


@register("p3_temporal_single_series", _temporal_sql("SELECT * FROM events", None, "ts, event_id", "event_id",
                                                     (0.8, 0.1, 0.1)))
def q_p3s(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "ts")
    return split.temporal_split(ev, (0.8, 0.1, 0.1), order_cols=["ts", "event_id"]).drop("ts")


@register("p4_supervised_shift", f"""
WITH s AS (SELECT event_type, day, n_events, lead(total, 2) OVER (PARTITION BY event_type ORDER BY day) AS y,
                  row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS rid,
                  count(*) OVER (PARTITION BY event_type) AS n0
           FROM ({_SQL_DAILY_R})),
f AS (SELECT event_type, day, n_events, y FROM s WHERE rid < n0 - 2 AND n_events IS NOT NULL AND y IS NOT NULL)
{_temporal_sql("SELECT * FROM f", "event_type", "day", "event_type, day, n_events, y").replace("WITH r AS", ", r AS")}""")
def q_p4(spark: SparkSession, sf: str) -> DataFrame:
    return split.supervised(daily_rounded(spark, sf), "total", ["n_events"], h=2, order_cols=["day"],
                            key="event_type", ratios=(0.7, 0.15, 0.15))


@register("p5_sequence_windows", """
WITH r AS (SELECT event_type,
                  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS start,
                  count(*) OVER (PARTITION BY event_type) AS n,
                  list([value]) OVER (PARTITION BY event_type ORDER BY ts, event_id
                                      ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS x,
                  lead(value, 8) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS y
           FROM events)
SELECT event_type, start, x, y, 8 AS seq_len FROM r WHERE start <= n - 9""")
def q_p5(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return windows.sequences(ev, ["value"], "value", L=8, h=1, order_cols=["ts", "event_id"], key="event_type")


@register("p5_sequence_windows_mixed", """
WITH e AS (SELECT CASE WHEN event_id < 70 THEN 'short' WHEN event_id < 90 THEN 'none' ELSE 'long' END AS k, event_id, value FROM events),
n AS (SELECT k, count(*) AS n, least(30, count(*) - 1 - 50) AS len FROM e GROUP BY 1),
r AS (SELECT e.k, row_number() OVER w - 1 AS start, n.n, n.len, list([value]) OVER (w ROWS BETWEEN CURRENT ROW AND 30 FOLLOWING) AS win
      FROM e JOIN n USING (k) WINDOW w AS (PARTITION BY e.k ORDER BY event_id))
SELECT k, start, win[1:len] AS x, win[len + 1][1] AS y, CAST(len AS INTEGER) AS seq_len FROM r WHERE len >= 1 AND start <= n - len - 1""")
def q_p5m(spark: SparkSession, sf: str) -> DataFrame:
    """A long series keeps its length beside a short one and one too short for any window."""
    eid = F.col("event_id")
    ev = table(spark, sf, "events").select(F.when(eid < 70, "short").when(eid < 90, "none").otherwise("long").alias("k"), "event_id", "value")
    return windows.sequences(ev, ["value"], "value", L=30, h=1, order_cols=["event_id"], key="k")


@register("p6_context_windows", """
WITH r AS (SELECT event_type,
                  row_number() OVER w - 1 AS start, count(*) OVER (PARTITION BY event_type) AS n,
                  list([value, CAST(user_id AS DOUBLE)]) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS past,
                  list([value, CAST(user_id AS DOUBLE)]) OVER (w ROWS BETWEEN 6 FOLLOWING AND 7 FOLLOWING) AS future,
                  list([value IS NOT NULL, user_id IS NOT NULL]) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)
                    AS past_observed
           FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_type, start, past, future, past_observed FROM r WHERE start <= n - 8""")
def q_p6(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return windows.context_windows(ev, ["value", "user_id"], L=6, H=2, order_cols=["ts", "event_id"],
                                   key="event_type")


@register("p5_sequence_blocks", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rid,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events),
b AS (SELECT DISTINCT event_type, n, (rid // 64) * 64 AS first FROM r WHERE rid <= n - 9),
w AS (SELECT *, least(64, n - 8 - first) AS m FROM b)
SELECT w.event_type, w.first, CAST(w.m AS INTEGER) AS n_windows, CAST(w.m + 7 AS INTEGER) AS n_steps,
       max(CASE WHEN r.rid = w.first THEN r.value END) AS first_step, max(CASE WHEN r.rid = w.first + w.m + 6 THEN r.value END) AS last_step,
       max(CASE WHEN r.rid = w.first + w.m + 7 THEN r.value END) AS last_target
FROM w JOIN r ON r.event_type = w.event_type AND r.rid BETWEEN w.first AND w.first + w.m + 7
GROUP BY 1, 2, 3, 4""")
def q_p5b(spark: SparkSession, sf: str) -> DataFrame:
    """The stored form of the windows: 64 starts a block, each block's rows once."""
    ev = table(spark, sf, "events")
    b = windows.sequence_blocks(ev, ["value"], "value", L=8, h=1, order_cols=["ts", "event_id"], key="event_type", block=64)
    return b.select("event_type", "first", "n_windows", F.size("x").alias("n_steps"), F.get(F.get("x", F.lit(0)), F.lit(0)).alias("first_step"),
                    F.element_at(F.element_at("x", -1), 1).alias("last_step"), F.element_at("y", -1).alias("last_target"))


@register("p5_window_regression", """
WITH r AS (SELECT event_type, value AS x, lead(value, 3) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS y FROM events)
SELECT event_type, CAST(regr_count(y, x) AS BIGINT) AS n, round(regr_intercept(y, x), 6) AS const, round(regr_slope(y, x), 6) AS slope
FROM r GROUP BY event_type""")
def q_p5r(spark: SparkSession, sf: str) -> DataFrame:
    """A direct forecaster three steps ahead, trained on the blocks."""
    ev = table(spark, sf, "events")
    b = windows.sequence_blocks(ev, ["value"], "value", L=1, h=3, order_cols=["ts", "event_id"], key="event_type")
    fit = window_fit.fit_windows(b, "event_type")
    return fit.select("event_type", "n", F.round(F.get("coef", F.lit(0)), 6).alias("const"), F.round(F.get("coef", F.lit(1)), 6).alias("slope"))


@register("p5_window_forecasts")
def q_p5f(spark: SparkSession, sf: str) -> DataFrame:
    """In-sample forecasts of every window of eight steps."""
    ev = table(spark, sf, "events")
    b = windows.sequence_blocks(ev, ["value"], "value", L=8, h=1, order_cols=["ts", "event_id"], key="event_type")
    scored = window_fit.window_forecasts(windows.cut_sequences(b, "event_type"), window_fit.fit_windows(b, "event_type"), "event_type")
    return scored.select("event_type", "start", "y", F.round("forecast", 6).alias("forecast"))


@register("p7_window_split", """
WITH r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS start,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events),
w AS (SELECT event_type, start FROM r WHERE start <= n - 9),
s AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS m FROM w)
SELECT event_type, start, CASE WHEN start < floor(m * 0.7::DOUBLE) THEN 'train'
                               WHEN start < floor(m * 0.7::DOUBLE) + floor(m * 0.15::DOUBLE) THEN 'val'
                               ELSE 'test' END AS split
FROM s""")
def q_p7(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    w = windows.sequences(ev, ["value"], "value", L=8, h=1, order_cols=["ts", "event_id"], key="event_type")
    return split.temporal_split(w.select("event_type", "start"), order_cols=["start"], key="event_type",
                                strict=True)


@register("p8_rolling_folds", f"""
WITH r AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS rid,
                  count(*) OVER (PARTITION BY event_type) AS n FROM ({_SQL_DAILY_R})),
f AS (SELECT r.*, t.f AS fold FROM r, range(0, 5) t(f))
SELECT event_type, day, CAST(fold AS INTEGER) AS fold,
       CASE WHEN rid >= fold * 2 AND rid < fold * 2 + 21 THEN 'train' ELSE 'test' END AS role
FROM f
WHERE n >= 23 AND fold * 2 + 21 < n
  AND ((rid >= fold * 2 AND rid < fold * 2 + 21) OR (rid >= fold * 2 + 21 AND rid < fold * 2 + 23))""")
def q_p8(spark: SparkSession, sf: str) -> DataFrame:
    d = daily_rounded(spark, sf).select("event_type", "day")
    return split.rolling_folds(d, W=21, h=2, folds=5, order_cols=["day"], key="event_type")


# =============================================================================== metrics
from kiln.operators import diagnostics, metrics  # noqa: E402


def _scored_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-rule predictions on lineitem (so metrics have something to score)."""
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_quantity", "l_discount",
                     "l_tax", "l_extendedprice",
                     (F.col("l_returnflag") == "R").cast("int").alias("y"),
                     (F.col("l_discount") > 0.05).cast("int").alias("yhat"),
                     F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R")
                     .alias("flag_hat"))


_SQL_SCORED = """SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag, l_quantity, l_discount, l_tax,
  l_extendedprice, CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(l_discount > 0.05 AS INTEGER) AS yhat,
  CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS flag_hat FROM lineitem"""


def _rounded(df: DataFrame, keep=()) -> DataFrame:
    return df.select(*[F.col(c) if (c in keep or df.schema[c].dataType.typeName() != "double") else r6(F.col(c)).alias(c)
                       for c in df.columns])


@register("x1_binary_metrics", f"""
WITH a AS (SELECT l_linestatus, count(*) AS n, count_if(y = yhat) AS ok, count_if(y = 1 AND yhat = 1) AS tp,
                  count_if(y <> 1 AND yhat = 1) AS fp, count_if(y = 1 AND yhat <> 1) AS fn
           FROM ({_SQL_SCORED}) GROUP BY 1)
SELECT l_linestatus, CAST(n AS BIGINT) AS n, round(ok / n, 6) AS accuracy,
       round(CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1
FROM a""")
def q_x1(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.binary_metrics(_scored_lineitem(spark, sf), "y", "yhat", by="l_linestatus"))


_SQL_CELLS = f"SELECT l_returnflag AS actual, flag_hat AS predicted, count(*) AS cnt FROM ({_SQL_SCORED}) GROUP BY 1, 2"


@register("x2_macro_metrics", f"""
WITH c AS ({_SQL_CELLS}),
p AS (SELECT actual AS cls, cnt AS act, 0 AS pred, CASE WHEN actual = predicted THEN cnt ELSE 0 END AS tp FROM c
      UNION ALL SELECT predicted, 0, cnt, 0 FROM c),
k AS (SELECT cls, sum(act) AS act, sum(pred) AS pred, sum(tp) AS tp FROM p GROUP BY 1),
m AS (SELECT *, CASE WHEN pred <> 0 THEN tp / pred ELSE 0 END AS pr, CASE WHEN act <> 0 THEN tp / act ELSE 0 END AS rc
      FROM k)
SELECT CAST(sum(act) AS BIGINT) AS n, round(sum(tp) / sum(act), 6) AS accuracy, round(avg(pr), 6) AS precision_macro,
       round(avg(rc), 6) AS recall_macro,
       round(avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END), 6) AS f1_macro,
       CAST(count(*) AS BIGINT) AS n_classes
FROM m""")
def q_x2(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.macro_metrics(_scored_lineitem(spark, sf), "l_returnflag", "flag_hat")
    return _rounded(m.select(F.col("n").cast("bigint").alias("n"), "accuracy", "precision_macro", "recall_macro",
                             "f1_macro", F.col("n_classes").cast("bigint").alias("n_classes")))


def _auc_sql(src: str, key: str | None) -> str:
    kc = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    return f"""
WITH s AS (SELECT {kc}l_discount AS s, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM ({src}) GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS below FROM s)
SELECT {kc}round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg)) END, 6)
  AS auc FROM c {"GROUP BY " + key if key else ""}"""


@register("x3_roc_auc", _auc_sql(_SQL_SCORED, None))
def q_x3(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.roc_auc(_scored_lineitem(spark, sf), "y", "l_discount"))


@register("x3_roc_auc_by_status", _auc_sql(_SQL_SCORED, "l_linestatus"))
def q_x3b(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.roc_auc(_scored_lineitem(spark, sf), "y", "l_discount", by="l_linestatus"))


_OVO_CLASSES = ["A", "N", "R"]
_OVO_PROBS = ["l_quantity / 50.0", "l_discount * 10.0", "l_tax * 12.5"]


def _ovo_sql() -> str:
    parts = []
    for i, a in enumerate(_OVO_CLASSES):
        for j, b in enumerate(_OVO_CLASSES):
            if i == j:
                continue
            pair = f"{min(i, j)}_{max(i, j)}"
            parts.append(f"SELECT '{pair}' AS pair, '{i}>{j}' AS dir, CAST({_OVO_PROBS[i]} AS DOUBLE) AS s, "
                         f"l_returnflag = '{a}' AS ispos FROM lineitem WHERE l_returnflag IN ('{a}', '{b}')")
    body = " UNION ALL ".join(parts)
    return f"""
WITH e AS ({body}),
s AS (SELECT pair, dir, s, count_if(ispos) AS pos, count_if(NOT ispos) AS neg FROM e GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (PARTITION BY pair, dir ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                - neg AS below FROM s),
a AS (SELECT pair, dir, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg)) END
             AS auc FROM c GROUP BY ALL),
p AS (SELECT pair, avg(auc) AS auc, count(auc) AS c FROM a GROUP BY 1)
SELECT round(CASE WHEN count_if(c < 2) = 0 THEN avg(auc) END, 6) AS auc_ovo FROM p"""


@register("x4_roc_auc_ovo", _ovo_sql())
def q_x4(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    x = li.select("l_returnflag", F.array((F.col("l_quantity") / 50.0), F.col("l_discount") * 10.0,
                                          F.col("l_tax") * 12.5).alias("probs"))
    return _rounded(metrics.roc_auc_ovo(x, "l_returnflag", "probs", _OVO_CLASSES))


@register("x5_confusion", f"""
WITH c AS ({_SQL_CELLS}),
k AS (SELECT DISTINCT cls FROM (SELECT actual AS cls FROM c UNION SELECT predicted FROM c)),
g AS (SELECT a.cls AS actual, b.cls AS predicted FROM k a, k b)
SELECT g.actual, g.predicted, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM g LEFT JOIN c ON g.actual = c.actual AND g.predicted = c.predicted""")
def q_x5(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(_scored_lineitem(spark, sf), "l_returnflag", "flag_hat")


@register("x6_roc_curve", f"""
WITH s AS (SELECT l_discount AS s, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM ({_SQL_SCORED}) GROUP BY 1),
c AS (SELECT s, sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM s)
SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL SELECT s, round(CASE WHEN N > 0 THEN fp / N END, 6), round(CASE WHEN P > 0 THEN tp / P END, 6) FROM c""")
def q_x6(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.roc_curve(_scored_lineitem(spark, sf), "y", "l_discount", drop_intermediate=False), keep=("threshold",))


@register("x6_roc_curve_bends", f"""
WITH r AS (SELECT round(l_discount * 100) + l_linenumber * 100 AS s, y FROM (
             SELECT l_discount, l_linenumber, CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END AS y FROM lineitem)),
s AS (SELECT s, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM r GROUP BY 1),
c AS (SELECT s, sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM s),
k AS (SELECT *, lag(tp) OVER w AS tb, lead(tp) OVER w AS ta, lag(fp) OVER w AS fb, lead(fp) OVER w AS fa FROM c WINDOW w AS (ORDER BY s DESC))
SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL SELECT s, round(fp / N, 6), round(tp / P, 6) FROM k WHERE tb IS NULL OR ta IS NULL OR ta - tp <> tp - tb OR fa - fp <> fp - fb""")
def q_x6b(spark: SparkSession, sf: str) -> DataFrame:
    """Default curve: only points at which it bends."""
    li = table(spark, sf, "lineitem")
    x = li.select((F.round(F.col("l_discount") * 100) + F.col("l_linenumber") * 100).alias("s"), (F.col("l_linenumber") > 3).cast("int").alias("y"))
    return _rounded(metrics.roc_curve(x, "y", "s"), keep=("threshold",))


def _reg_sql(src: str, key: str, y: str, p: str, eps: str) -> str:
    keep = f"abs({y}) > {eps}" if eps != "0" else f"{y} <> 0"
    return f"""
SELECT {key}, CAST(count(*) AS BIGINT) AS n, round(avg(({y} - {p}) * ({y} - {p})), 6) AS mse,
       round(sqrt(avg(({y} - {p}) * ({y} - {p}))), 6) AS rmse, round(avg(abs({y} - {p})), 6) AS mae,
       round(avg(CASE WHEN {keep} THEN abs(({y} - {p}) / {y}) END) * 100, 6) AS mape
FROM ({src}) WHERE {y} IS NOT NULL AND {p} IS NOT NULL GROUP BY 1"""


@register("x7_regression_metrics", _reg_sql("SELECT l_returnflag, l_extendedprice, l_quantity * 1500.0 AS p FROM lineitem",
                                            "l_returnflag", "l_extendedprice", "p", "1e-10"))
def q_x7(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice",
                                              (F.col("l_quantity") * 1500.0).alias("p"))
    return _rounded(metrics.regression_metrics(li, "l_extendedprice", "p", by="l_returnflag"))


@register("x9_mape_nonzero", _reg_sql("SELECT event_type, value, CAST(user_id AS DOUBLE) AS p FROM events",
                                      "event_type", "value", "p", "0"))
def q_x9(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_type", "value", F.col("user_id").cast("double").alias("p"))
    return _rounded(metrics.regression_metrics(ev, "value", "p", by="event_type", mape_eps=0))


@register("x10_horizon_metrics", """
WITH r AS (SELECT event_type, row_number() OVER w - 1 AS start, count(*) OVER (PARTITION BY event_type) AS n,
                  lead(value, 5) OVER w AS last, lead(value, 6) OVER w AS f0, lead(value, 7) OVER w AS f1,
                  lead(value, 8) OVER w AS f2, lead(value, 9) OVER w AS f3
           FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
v AS (SELECT * FROM r WHERE start <= n - 10),
z AS (SELECT event_type, 0 AS step, f0 AS t, last AS p FROM v UNION ALL SELECT event_type, 1, f1, last FROM v
      UNION ALL SELECT event_type, 2, f2, last FROM v UNION ALL SELECT event_type, 3, f3, last FROM v),
h AS (SELECT event_type, 'all' AS horizon, t, p FROM z
      UNION ALL SELECT event_type, 'h1', t, p FROM z WHERE step = 0
      UNION ALL SELECT event_type, 'h2', t, p FROM z WHERE step = 1
      UNION ALL SELECT event_type, 'h4', t, p FROM z WHERE step = 3)
SELECT event_type, horizon, CAST(count(*) AS BIGINT) AS n, round(avg((t - p) * (t - p)), 6) AS mse,
       round(sqrt(avg((t - p) * (t - p))), 6) AS rmse, round(avg(abs(t - p)), 6) AS mae,
       round(avg(CASE WHEN t <> 0 THEN abs((t - p) / t) END) * 100, 6) AS mape
FROM h GROUP BY 1, 2""")
def q_x10(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    w = windows.context_windows(ev, ["value"], L=6, H=4, order_cols=["ts", "event_id"], key="event_type")
    last = F.element_at(F.col("past"), -1)
    w = w.select("event_type", "future", F.array_repeat(last, 4).alias("naive"))
    return _rounded(metrics.horizon_metrics(w, "future", "naive", H=4, by="event_type"))


@register("x11_residuals", """
SELECT l_orderkey, l_linenumber, l_extendedprice AS actual, l_quantity * 1500.0 AS predicted,
       round(l_extendedprice - l_quantity * 1500.0, 6) AS residual FROM lineitem""")
def q_x11(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1500.0)
    r = metrics.residuals(li, "l_extendedprice", "p", keep=["l_orderkey", "l_linenumber"])
    return r.withColumn("residual", r6(F.col("residual")))


def _hist_sql(src: str, col: str, bins: int, key: str | None, density: bool = False) -> str:
    kc = f"{key}, " if key else ""
    kj = f"ON g.{key} = c.{key} AND g.bin = c.bin" if key else "ON g.bin = c.bin"
    dens = ", round(coalesce(c.cnt, 0) / (g.n * g.w), 6) AS density" if density else ""
    return f"""
WITH x AS (SELECT {kc}CAST({col} AS DOUBLE) AS x FROM ({src}) WHERE {col} IS NOT NULL),
st AS (SELECT {kc}min(x) AS mn, max(x) AS mx, count(*) AS n, (max(x) - min(x)) / {bins} AS w FROM x {"GROUP BY 1" if key else ""}),
b AS (SELECT {"x." + key + ", " if key else ""}CASE WHEN st.mx = st.mn THEN 0 ELSE least(floor((x.x - st.mn) / st.w), {bins - 1}) END AS bin
      FROM x {"JOIN st ON x." + key + " = st." + key if key else ", st"}),
c AS (SELECT {kc}bin, count(*) AS cnt FROM b GROUP BY ALL),
g AS (SELECT {kc}mn, mx, n, w, unnest(generate_series(0, {bins - 1})) AS bin FROM st)
SELECT {"g." + key + ", " if key else ""}CAST(g.bin AS INTEGER) AS bin, round(g.mn + g.bin * g.w, 6) AS lo,
       round(CASE WHEN g.bin = {bins - 1} THEN g.mx ELSE g.mn + (g.bin + 1) * g.w END, 6) AS hi,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count{dens}
FROM g LEFT JOIN c {kj}"""


@register("x12_histogram", _hist_sql("SELECT * FROM lineitem", "l_extendedprice", 30, None))
def q_x12(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30))


@register("x12_histogram_by", _hist_sql("SELECT * FROM lineitem", "l_extendedprice", 50, "l_returnflag"))
def q_x12b(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 50, by="l_returnflag"))


def _inv_norm_sql(p: str) -> str:
    """The same rational approximation as kiln.functions.exprs.inv_norm, in SQL."""
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00]

    def poly(coef, x):
        out = f"{coef[0]!r}::DOUBLE"
        for k in coef[1:]:
            out = f"({out} * {x} + {k!r}::DOUBLE)"
        return out

    ql = f"sqrt(-2 * ln({p}))"
    qh = f"sqrt(-2 * ln(1 - {p}))"
    qc = f"({p} - 0.5::DOUBLE)"
    r = f"({qc} * {qc})"
    return (f"CASE WHEN {p} < 0.02425::DOUBLE THEN {poly(c, ql)} / ({poly(d, ql)} * {ql} + 1) "
            f"WHEN {p} <= 1 - 0.02425::DOUBLE THEN {poly(a, r)} * {qc} / ({poly(b, r)} * {r} + 1) "
            f"ELSE -{poly(c, qh)} / ({poly(d, qh)} * {qh} + 1) END")


_QQ_SQL = f"""
WITH r AS (SELECT l_extendedprice - l_quantity * 1500.0 AS r FROM lineitem),
u AS (SELECT r, row_number() OVER (ORDER BY r) AS k, count(*) OVER () AS n FROM r),
p AS (SELECT k - 1 AS i, r, CASE WHEN k = 1 THEN 1 - pow(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN k = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n)
                                 ELSE (k - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM u)
SELECT CAST(i AS BIGINT) AS i, round({_inv_norm_sql("p")}, 6) AS theoretical, round(r, 6) AS sample FROM p"""


@register("x13_qq_points", _QQ_SQL)
def q_x13(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of lineitem is a point."""
    li = table(spark, sf, "lineitem").withColumn("r", F.col("l_extendedprice") - F.col("l_quantity") * 1500.0)
    return _rounded(diagnostics.qq_points(li, "r"))


def _acf_sql(max_lag: int = 20) -> str:
    lags = ", ".join(f"lag(d, {k}) OVER w AS l{k}" for k in range(1, max_lag + 1))
    sums = ", ".join(f"sum(d * l{k}) AS s{k}" for k in range(1, max_lag + 1))
    rows = " UNION ALL ".join(f"SELECT event_type, n, {k} AS lag, s{k} / s0 AS acf FROM a" for k in range(1, max_lag + 1))
    return f"""
WITH m AS (SELECT event_type, avg(value) AS mu, count(*) AS n FROM events GROUP BY 1),
d AS (SELECT e.event_type, e.ts, e.event_id, e.value - m.mu AS d, m.n FROM events e JOIN m ON e.event_type = m.event_type),
l AS (SELECT *, {lags} FROM d WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
a AS (SELECT event_type, first(n) AS n, sum(d * d) AS s0, {sums} FROM l GROUP BY 1),
r AS (SELECT event_type, n, 0 AS lag, s0 / s0 AS acf FROM a UNION ALL {rows})
SELECT event_type, CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf FROM r WHERE lag <= least({max_lag}, n // 4)"""


@register("x14_acf", _acf_sql())
def q_x14(spark: SparkSession, sf: str) -> DataFrame:
    a = diagnostics.acf(table(spark, sf, "events"), "value", ["ts", "event_id"], key="event_type")
    return a.select("event_type", F.col("lag").cast("int"), r6(F.col("acf")).alias("acf"))


@register("x15_pacf")
def q_x15(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.pacf(table(spark, sf, "events"), "value", ["ts", "event_id"], key="event_type")


@register("x15_pacf_two_lags", f"""
WITH a AS ({_acf_sql(2)}),
r AS (SELECT event_type, max(CASE WHEN lag = 1 THEN acf END) AS r1, max(CASE WHEN lag = 2 THEN acf END) AS r2 FROM a GROUP BY 1)
SELECT event_type, CAST(k AS INTEGER) AS lag, round(CASE k WHEN 0 THEN 1.0 WHEN 1 THEN r1 ELSE (r2 - r1 * r1) / (1 - r1 * r1) END, 4) AS pacf
FROM r, (SELECT unnest([0, 1, 2]) AS k)""")
def q_x15t(spark: SparkSession, sf: str) -> DataFrame:
    p = diagnostics.pacf(table(spark, sf, "events"), "value", ["ts", "event_id"], key="event_type", max_lag=2)
    return p.select("event_type", "lag", F.round("pacf", 4).alias("pacf"))


@register("x16_forecast_frame", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS pos,
                  count(*) OVER (PARTITION BY event_type) AS n,
                  lag(total, 1) OVER (PARTITION BY event_type ORDER BY day) AS fc FROM ({_SQL_DAILY_R})),
s AS (SELECT *, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train'
                     WHEN pos < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val'
                     ELSE 'test' END AS split FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM s WHERE split = 'train')
SELECT event_type, day, 'train' AS part, total AS actual, CAST(NULL AS DOUBLE) AS forecast FROM t WHERE k <= 50
UNION ALL SELECT event_type, day, 'val', total, NULL FROM s WHERE split = 'val'
UNION ALL SELECT event_type, day, 'test', total, fc FROM s WHERE split = 'test'""")
def q_x16(spark: SparkSession, sf: str) -> DataFrame:
    d = daily_rounded(spark, sf)
    d = encode.add_lags(d, ["total"], 1, order_cols=["day"], key="event_type")
    s = split.temporal_split(d, order_cols=["day"], key="event_type", layout="keyed")
    return metrics.forecast_frame(s.filter("split = 'train'"), s.filter("split = 'val'"), s.filter("split = 'test'"),
                                  "day", "total", "total_lag_1", key="event_type")


# =============================================================================== profiling
from kiln.operators import assoc, profile  # noqa: E402

_LI_PROFILE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@register("g1_overview", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(11 AS BIGINT) AS n_columns,
       CAST(0 AS BIGINT) AS missing_cells,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS duplicate_rows
FROM lineitem""")
def q_g1(spark: SparkSession, sf: str) -> DataFrame:
    return profile.overview(table(spark, sf, "lineitem"))


@register("g1_overview_dirty", f"""
WITH d AS (SELECT l_returnflag, l_linestatus,
                  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem)
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(3 AS BIGINT) AS n_columns,
       CAST(count(*) - count(q) AS BIGINT) AS missing_cells,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS BIGINT) AS duplicate_rows
FROM d""")
def q_g1d(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    d = li.select("l_returnflag", "l_linestatus",
                  F.when(F.col("l_linenumber") % 3 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("q"))
    return profile.overview(d)


def _profile_sql(cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count,
  CAST(count(*) - count({c}) AS BIGINT) AS missing, CAST(count(DISTINCT {c}) AS BIGINT) AS "distinct",
  round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 9) AS mean,
  round(stddev_samp({c}), 9) AS std, round(quantile_cont({c}, 0.25), 6) AS q25,
  round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75,
  CAST(count_if({c} = 0) AS BIGINT) AS zeros FROM lineitem""")
    return " UNION ALL ".join(parts)


@register("g2_profile", _profile_sql(_LI_PROFILE))
def q_g2(spark: SparkSession, sf: str) -> DataFrame:
    # means of 2-decimal data can sit on a 7th-decimal tie: mean / std use 9 places
    p = profile.profile(table(spark, sf, "lineitem"), _LI_PROFILE)
    p = p.withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))
    return _rounded(p, keep=("mean", "std"))


def _profile_all_sql(src: str, cols: dict[str, str]) -> str:
    one = []
    for c, kind in cols.items():
        one.append(f"""SELECT '{c}' AS "column", '{kind}' AS type, count({c}) AS count, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "distinct",
CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max,
(SELECT CAST({c} AS VARCHAR) FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1) AS top,
CAST((SELECT max(k) FROM (SELECT count(*) AS k FROM {src} WHERE {c} IS NOT NULL GROUP BY {c})) AS DOUBLE) AS top_count FROM {src}""")
    return " UNION ALL ".join(one)


@register("g2_profile_all", _profile_all_sql("conversations", {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}))
def q_g2a(spark: SparkSession, sf: str) -> DataFrame:
    """Every column of a mixed table."""
    return profile.profile_all(table(spark, sf, "conversations"))


@register("g2_top_values", """
WITH u AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders
           UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
c AS (SELECT "column", value, count(*) AS count FROM u WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM c)
SELECT "column", value, CAST(count AS BIGINT) AS count, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def q_g2t(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top_values(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], k=3)


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(src: str, cols: list[str]) -> str:
    parts = [f"SELECT '{c}' AS a, '{c}' AS b, 1.0::DOUBLE AS corr" for c in cols]
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}', '{b}', round(corr({a}, {b}), 6) FROM ({src})")
            parts.append(f"SELECT '{b}', '{a}', round(corr({a}, {b}), 6) FROM ({src})")
    return " UNION ALL ".join(parts)


@register("g3_pearson", _corr_sql("SELECT * FROM lineitem", _CORR_COLS))
def q_g3(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(assoc.corr_matrix(table(spark, sf, "lineitem"), _CORR_COLS))


def _ranked_sql(cols: list[str]) -> str:
    rk = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in cols)
    return f"SELECT {rk} FROM lineitem"


@register("g4_spearman", _corr_sql(_ranked_sql(_CORR_COLS), _CORR_COLS))
def q_g4(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(assoc.corr_matrix(table(spark, sf, "lineitem"), _CORR_COLS, "spearman"))


@register("g5_kendall", """
WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS c FROM lineitem GROUP BY 1, 2),
p AS (SELECT sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN a.c * b.c ELSE 0 END) / 2 AS C,
             sum(CASE WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN a.c * b.c ELSE 0 END) / 2 AS D FROM c a, c b),
t AS (SELECT sum(c) AS n FROM c),
tx AS (SELECT sum(t * (t - 1) / 2) AS n1 FROM (SELECT sum(c) AS t FROM c GROUP BY x)),
ty AS (SELECT sum(t * (t - 1) / 2) AS n2 FROM (SELECT sum(c) AS t FROM c GROUP BY y))
SELECT CAST(C AS BIGINT) AS concordant, CAST(D AS BIGINT) AS discordant,
       round((C - D) / sqrt((n * (n - 1) / 2 - n1) * (n * (n - 1) / 2 - n2)), 6) AS tau_b
FROM p, t, tx, ty""")
def q_g5(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(assoc.kendall_tau(table(spark, sf, "lineitem"), "l_quantity", "l_discount"))


@register("g5_kendall_continuous", """
WITH r AS (SELECT l_extendedprice AS x, l_partkey + l_discount AS y FROM lineitem),
ix AS (SELECT x, y, row_number() OVER (ORDER BY x, y) AS i FROM r),
n AS (SELECT count(*)::DOUBLE AS n FROM r),
tx AS (SELECT sum(t * (t - 1) / 2)::DOUBLE AS v FROM (SELECT count(*) AS t FROM r GROUP BY x)),
ty AS (SELECT sum(t * (t - 1) / 2)::DOUBLE AS v FROM (SELECT count(*) AS t FROM r GROUP BY y)),
txy AS (SELECT sum(t * (t - 1) / 2)::DOUBLE AS v FROM (SELECT count(*) AS t FROM r GROUP BY x, y)),
d AS (SELECT count(*)::DOUBLE AS d FROM r a JOIN r b ON a.x < b.x AND a.y > b.y)
SELECT CAST(n * (n - 1) / 2 - tx.v - ty.v + txy.v - d AS BIGINT) AS concordant, CAST(d AS BIGINT) AS discordant,
       round((n * (n - 1) / 2 - tx.v - ty.v + txy.v - 2 * d) / sqrt((n * (n - 1) / 2 - tx.v) * (n * (n - 1) / 2 - ty.v)), 6) AS tau_b
FROM n, tx, ty, txy, d""")
def q_g5c(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns of thousands of distinct values."""
    li = table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_partkey") + F.col("l_discount")).alias("y"))
    return _rounded(assoc.kendall_tau(li, "l_extendedprice", "y"))


_DEGENERATE = """
SELECT CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS a,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS b, 1.0::DOUBLE AS c, l_discount AS d FROM lineitem"""


def degenerate_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns with NULLs on different rows, a constant one, and a plain one."""
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity")).alias("a"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")).alias("b"), F.lit(1.0).alias("c"), F.col("l_discount").alias("d"))


def _pairwise_sql(ranked: bool) -> str:
    parts = [f"SELECT '{c}' AS a, '{c}' AS b, {'NULL::DOUBLE' if c == 'c' else '1.0::DOUBLE'} AS corr" for c in "abcd"]
    for x, y in (("a", "b"), ("a", "d"), ("b", "d")):
        rk = lambda v: f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS {v}"
        cols = f"{rk(x)}, {rk(y)}" if ranked else f"{x}, {y}"
        one = f"(SELECT corr({x}, {y}) FROM (SELECT {cols} FROM dd WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"
        parts += [f"SELECT '{x}', '{y}', {one}", f"SELECT '{y}', '{x}', {one}"]
    for x in "abd":
        parts += [f"SELECT '{x}', 'c', NULL", f"SELECT 'c', '{x}', NULL"]
    return f"WITH dd AS ({_DEGENERATE}), r AS ({' UNION ALL '.join(parts)}) SELECT a, b, round(corr, 6) AS corr FROM r"


@register("g3_pearson_degenerate", _pairwise_sql(False))
def q_g3d(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(assoc.corr_matrix(degenerate_columns(spark, sf), ["a", "b", "c", "d"]))


@register("g4_spearman_degenerate", _pairwise_sql(True))
def q_g4d(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(assoc.corr_matrix(degenerate_columns(spark, sf), ["a", "b", "c", "d"], "spearman"))


def _cramers_sql(src: str, a: str, b: str) -> str:
    return f"""
WITH c AS (SELECT CAST({a} AS VARCHAR) AS x, CAST({b} AS VARCHAR) AS y, count(*) AS o FROM ({src})
           WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
m AS (SELECT *, sum(o) OVER (PARTITION BY x) AS rx, sum(o) OVER (PARTITION BY y) AS cy, sum(o) OVER () AS n FROM c),
s AS (SELECT sum(o * o / (rx * cy / n)) - first(n) AS chi2, first(n) AS n, count(DISTINCT x) AS r,
             count(DISTINCT y) AS k FROM m),
v AS (SELECT *, greatest(0.0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) AS phi2c,
             least(k - (k - 1) * (k - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1) AS den FROM s)
SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN den > 0 THEN sqrt(phi2c / den) END, 6) AS cramers_v FROM v"""


@register("g6_cramers_v", _cramers_sql("SELECT * FROM lineitem", "l_returnflag", "l_linestatus"))
def q_g6(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(assoc.cramers_v(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


@register("g6_cramers_v_orders", _cramers_sql("SELECT * FROM orders", "o_orderstatus", "o_orderpriority"))
def q_g6o(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(assoc.cramers_v(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


def _decile_sql(col: str, src: str) -> str:
    cuts = " + ".join(f"CASE WHEN {col} > (SELECT quantile_cont({col}, {i / 10!r}) FROM ({src})) THEN 1 ELSE 0 END"
                      for i in range(1, 10))
    return f"({cuts})"


@register("g7_contingency_binned", f"""
WITH b AS (SELECT {_decile_sql('l_extendedprice', 'SELECT * FROM lineitem')} AS x, l_returnflag AS y FROM lineitem),
c AS (SELECT CAST(x AS VARCHAR) AS x, y, count(*) AS o FROM b GROUP BY 1, 2),
m AS (SELECT *, sum(o) OVER (PARTITION BY x) AS rx, sum(o) OVER (PARTITION BY y) AS cy, sum(o) OVER () AS n FROM c),
s AS (SELECT sum(o * o / (rx * cy / n)) - first(n) AS chi2, first(n) AS n FROM m)
SELECT 'l_extendedprice' AS a, 'l_returnflag' AS b, round(sqrt(chi2 / (chi2 + n)), 6) AS contingency FROM s""")
def q_g7(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(assoc.contingency_coefficient(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag",
                                                  numeric=["l_extendedprice"]))


@register("g7_phi_k")
def q_g7p(spark: SparkSession, sf: str) -> DataFrame:
    from kiln.operators.phik import phi_k

    li = table(spark, sf, "lineitem")
    return phi_k(li, "l_extendedprice", "l_quantity", numeric=["l_extendedprice", "l_quantity"]).unionByName(phi_k(li, "l_returnflag", "l_linestatus"))


@register("g9_uncertainty", """
WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, sum(o) OVER (PARTITION BY y) AS ny, sum(o) OVER (PARTITION BY x) AS nx, sum(o) OVER () AS n FROM c),
h AS (SELECT sum(-(o / n) * ln(o / ny)) AS hxy, sum(-(o / n) * ln(nx / n)) AS hx FROM m)
SELECT 'l_returnflag' AS x, 'l_linestatus' AS y,
       round(CASE WHEN hx = 0 THEN 1.0 ELSE (hx - hxy) / hx END, 6) AS uncertainty FROM h""")
def q_g9(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(assoc.uncertainty_coefficient(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


@register("g9_correlation_ratio", """
WITH g AS (SELECT l_returnflag, count(*) AS n, sum(l_extendedprice) AS s, sum(l_extendedprice * l_extendedprice) AS ss
           FROM lineitem GROUP BY 1),
r AS (SELECT sum(s * s / n) AS a, sum(s) AS S, sum(n) AS N, sum(ss) AS Q FROM g)
SELECT 'l_returnflag' AS category, 'l_extendedprice' AS "numeric",
       round(CASE WHEN Q - S * S / N > 0 THEN sqrt(greatest(a - S * S / N, 0.0) / (Q - S * S / N)) ELSE 0.0 END, 6) AS eta
FROM r""")
def q_g9r(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(assoc.correlation_ratio(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"))


def _classify_sql() -> str:
    kinds = {"l_orderkey": "numerical", "l_partkey": "numerical", "l_suppkey": "numerical", "l_linenumber": "unclassified",
             "l_quantity": "numerical", "l_extendedprice": "numerical", "l_discount": "numerical",
             "l_tax": "numerical", "l_returnflag": "categorical", "l_linestatus": "categorical",
             "l_shipdate": "unclassified"}
    parts = [f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary' ELSE '{k}' END AS kind, "
             f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM lineitem" for c, k in kinds.items()]
    return " UNION ALL ".join(parts)


@register("g10_classify", _classify_sql())
def q_g10(spark: SparkSession, sf: str) -> DataFrame:
    return profile.classify(table(spark, sf, "lineitem"))


@register("g11_crosstab", """
SELECT l_returnflag, CAST(count_if(l_linestatus = 'F') AS BIGINT) AS "F", CAST(count_if(l_linestatus = 'O') AS BIGINT) AS "O"
FROM lineitem GROUP BY 1""")
def q_g11(spark: SparkSession, sf: str) -> DataFrame:
    return profile.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@register("g12_box_stats", """
WITH q AS (SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1,
                  quantile_cont(l_extendedprice, 0.5) AS med, quantile_cont(l_extendedprice, 0.75) AS q3
           FROM lineitem GROUP BY 1),
j AS (SELECT l.l_extendedprice AS x, q.*, q.q1 - 1.5 * (q.q3 - q.q1) AS lo, q.q3 + 1.5 * (q.q3 - q.q1) AS hi
      FROM lineitem l JOIN q ON l.l_returnflag = q.l_returnflag)
SELECT l_returnflag, CAST(first(n) AS BIGINT) AS n, round(first(q1), 6) AS q1, round(first(med), 6) AS median,
       round(first(q3), 6) AS q3, round(min(CASE WHEN x >= lo AND x <= hi THEN x END), 6) AS whisker_low,
       round(max(CASE WHEN x >= lo AND x <= hi THEN x END), 6) AS whisker_high,
       CAST(count_if(NOT (x >= lo AND x <= hi)) AS BIGINT) AS outliers
FROM j GROUP BY 1""")
def q_g12(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(profile.box_stats(table(spark, sf, "lineitem"), "l_extendedprice", by="l_returnflag"))


@register("g13_density_hist", _hist_sql("SELECT * FROM lineitem", "l_quantity", 10, "l_returnflag", density=True))
def q_g13(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(profile.density_hist(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", 10))


@register("g14_standardize", """
WITH s AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_discount) AS m2,
                  stddev_pop(l_discount) AS s2, avg(l_tax) AS m3, stddev_pop(l_tax) AS s3 FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - m1) / s1, 6) AS l_quantity,
       round((l_discount - m2) / s2, 6) AS l_discount, round((l_tax - m3) / s3, 6) AS l_tax
FROM lineitem, s""")
def q_g14(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return _rounded(profile.standardize(li, ["l_quantity", "l_discount", "l_tax"]))


@register("g18_test_statistics", """
WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, sum(o) OVER (PARTITION BY x) AS rx, sum(o) OVER (PARTITION BY y) AS cy, sum(o) OVER () AS n FROM c),
chi AS (SELECT sum(o * o / (rx * cy / n)) - first(n) AS stat, (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS dof FROM m),
w AS (SELECT avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS m0,
             avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS m1,
             var_samp(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS v0,
             var_samp(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS v1,
             count_if(l_linestatus = 'F') AS n0, count_if(l_linestatus = 'O') AS n1 FROM lineitem),
g AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1),
an AS (SELECT sum(n * (m - (SELECT avg(l_extendedprice) FROM lineitem)) * (m - (SELECT avg(l_extendedprice) FROM lineitem))) AS b,
              sum(n * v) AS w, sum(n) AS N, count(*) AS k FROM g),
rk AS (SELECT l_returnflag, l_linestatus,
              rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem),
mw AS (SELECT sum(r) - count(*) * (count(*) + 1) / 2.0 AS u FROM rk WHERE l_linestatus = 'F'),
kw AS (SELECT l_returnflag, avg(r) AS mr, count(*) AS n FROM rk GROUP BY 1),
kn AS (SELECT count(*)::DOUBLE AS n, avg(r) AS m, sum((r - (SELECT avg(r) FROM rk)) * (r - (SELECT avg(r) FROM rk))) AS ss FROM rk),
wd AS (SELECT l_quantity - l_linenumber * 6.0 AS d FROM lineitem WHERE l_quantity <> l_linenumber * 6.0),
wr AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM wd),
ws AS (SELECT sum(CASE WHEN d > 0 THEN r END) AS p, sum(CASE WHEN d < 0 THEN r END) AS m FROM wr),
pc AS (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem)
SELECT 'chi2_independence' AS test, round(stat, 6) AS statistic, CAST(dof AS DOUBLE) AS dof FROM chi
UNION ALL SELECT 'welch_t', round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 6),
  round(power(v0 / n0 + v1 / n1, 2) / (power(v0 / n0, 2) / (n0 - 1) + power(v1 / n1, 2) / (n1 - 1)), 6) FROM w
UNION ALL SELECT 'anova_f', round((b / (k - 1)) / (w / (N - k)), 6), CAST(k - 1 AS DOUBLE) FROM an
UNION ALL SELECT 'mann_whitney_u', round(u, 6), NULL FROM mw
UNION ALL SELECT 'kruskal_h', round((n - 1) * (SELECT sum(g.n * (g.mr - kn.m) * (g.mr - kn.m)) FROM kw g) / ss, 5),
  CAST((SELECT count(*) - 1 FROM kw) AS DOUBLE) FROM kn
UNION ALL SELECT 'wilcoxon', round(least(p, m), 6), CAST((SELECT count(*) FROM wd) AS DOUBLE) FROM ws
UNION ALL SELECT 'pearson_t', round(r * sqrt((n - 2) / (1 - r * r)), 6), CAST(n - 2 AS DOUBLE) FROM pc""")
def q_g18(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    parts = [
        assoc.chi2_test(li, "l_returnflag", "l_linestatus").select(F.lit("chi2_independence").alias("test"),
                                                                  "statistic", F.col("dof").cast("double")),
        assoc.welch_t(li, "l_extendedprice", "l_linestatus", "F", "O").select(F.lit("welch_t").alias("test"),
                                                                             "statistic", "dof"),
        assoc.anova_f(li, "l_extendedprice", "l_returnflag").select(F.lit("anova_f").alias("test"), "statistic",
                                                                    F.col("df_between").cast("double").alias("dof")),
        assoc.mann_whitney_u(li, "l_quantity", "l_linestatus", "F").select(
            F.lit("mann_whitney_u").alias("test"), "statistic", F.lit(None).cast("double").alias("dof")),
        assoc.wilcoxon(li.withColumn("six", F.col("l_linenumber") * 6.0), "l_quantity", "six").select(
            F.lit("wilcoxon").alias("test"), "statistic", F.col("n").cast("double").alias("dof")),
        assoc.kruskal_h(li, "l_quantity", "l_returnflag").select(F.lit("kruskal_h").alias("test"), F.round("statistic", 5).alias("statistic"),
                                                                  F.col("dof").cast("double")),
        assoc.pearson_test(li, "l_quantity", "l_extendedprice").select(F.lit("pearson_t").alias("test"),
                                                                        "statistic", F.col("dof").cast("double")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _rounded(out)


# =============================================================================== models and tuning
@register("g18_p_values", """
WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, sum(o) OVER (PARTITION BY x) AS rx, sum(o) OVER (PARTITION BY y) AS cy, sum(o) OVER () AS n FROM c),
chi AS (SELECT sum(o * o / (rx * cy / n)) - first(n) AS stat FROM m),
g AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1),
an AS (SELECT sum(n * (m - (SELECT avg(l_extendedprice) FROM lineitem)) * (m - (SELECT avg(l_extendedprice) FROM lineitem))) AS b,
              sum(n * v) AS w, sum(n) AS n FROM g),
rk AS (SELECT l_returnflag, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem),
kw AS (SELECT l_returnflag, avg(r) AS mr, count(*) AS n FROM rk GROUP BY 1),
kn AS (SELECT count(*)::DOUBLE AS n, avg(r) AS m, sum((r - (SELECT avg(r) FROM rk)) * (r - (SELECT avg(r) FROM rk))) AS ss FROM rk),
t AS (SELECT (l_quantity - 25.5) / l_linenumber AS t FROM lineitem)
SELECT 'chi2_independence' AS test, round(exp(-stat / 2), 9) AS p_value FROM chi
UNION ALL SELECT 'anova_f', round(power(1 + 2 * (b / 2) / (w / (n - 3)) / (n - 3), -(n - 3) / 2), 9) FROM an
UNION ALL SELECT 'kruskal_h', round(exp(-(n - 1) * (SELECT sum(g.n * (g.mr - kn.m) * (g.mr - kn.m)) FROM kw g) / ss / 2), 9) FROM kn
UNION ALL SELECT 'student_1', round(avg(1 - 2 / pi() * atan(abs(t))), 9) FROM t
UNION ALL SELECT 'student_2', round(avg(1 - abs(t) / sqrt(t * t + 2)), 9) FROM t
UNION ALL SELECT 'chi2_2', round(avg(exp(-abs(t) / 2)), 9) FROM t
UNION ALL SELECT 'f_2_5', round(avg(power(1 + 2 * abs(t) / 5, -2.5)), 9) FROM t""")
def q_g18p(spark: SparkSession, sf: str) -> DataFrame:
    """Tails that have closed forms: two degrees of freedom, Student's with one and two."""
    from kiln.functions.special import chi2_upper, f_upper, t_two_sided

    li = table(spark, sf, "lineitem")
    t = F.col("t")
    rows = li.groupBy(((F.col("l_quantity") - 25.5) / F.col("l_linenumber")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    tails = {"student_1": t_two_sided(t, F.lit(1)), "student_2": t_two_sided(t, F.lit(2)), "chi2_2": chi2_upper(F.abs(t), F.lit(2)),
             "f_2_5": f_upper(F.abs(t), F.lit(2), F.lit(5))}
    means = rows.agg(*[(F.sum(p * F.col("n")) / F.sum("n")).alias(name) for name, p in tails.items()])
    out = means.select(F.explode(F.array(*[F.struct(F.lit(n).alias("test"), F.col(n).alias("p_value")) for n in tails])).alias("r")).select("r.*")
    for name, test in (("chi2_independence", assoc.chi2_test(li, "l_returnflag", "l_linestatus")), ("anova_f", assoc.anova_f(li, "l_extendedprice", "l_returnflag")),
                       ("kruskal_h", assoc.kruskal_h(li, "l_quantity", "l_returnflag"))):
        out = out.unionByName(test.select(F.lit(name).alias("test"), "p_value"))
    return out.select("test", F.round("p_value", 9).alias("p_value"))


@register("g18_ks_normal")
def q_g18k(spark: SparkSession, sf: str) -> DataFrame:
    return assoc.ks_normal_test(table(spark, sf, "lineitem"), "l_extendedprice")


from kiln.operators import boosting, model, tune, wide_factors  # noqa: E402

_CL_FEATURES = ["l_extendedprice", "l_discount", "l_tax"]


def _classification_table(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with a binary label (quantity above 25) and a deterministic 70/15/15 split."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *_CL_FEATURES,
                                              (F.col("l_quantity") > 25).cast("int").alias("label"))
    return split.stratified_split(li, "label", (0.7, 0.15, 0.15), id_cols=["l_orderkey", "l_linenumber"])


def _prob1(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", "label", "split", "prediction",
                     F.element_at("probability", 2).alias("prob_1"))


@register("m1_logistic_scores")
def q_m1(spark: SparkSession, sf: str) -> DataFrame:
    t = _classification_table(spark, sf)
    m = model.fit_logistic(t.filter("split = 'train'"), _CL_FEATURES, "label", C=1.0, max_iter=100)
    return _prob1(model.score(m, t))


@register("m2_mlp_scores")
def q_m2(spark: SparkSession, sf: str) -> DataFrame:
    t = _classification_table(spark, sf)
    z = profile.standardize(t, _CL_FEATURES)
    m = model.fit_mlp(z.filter("split = 'train'"), _CL_FEATURES, "label", hidden="8,4", max_iter=50)
    return _prob1(model.score(m, z))


@register("m3_gbt_scores")
def q_m3(spark: SparkSession, sf: str) -> DataFrame:
    t = _classification_table(spark, sf).withColumn("is_val", F.col("split") == "val")
    fit_on = t.filter("split != 'test'")
    m = model.fit_gbt_classifier(fit_on, _CL_FEATURES, "label", n_trees=20, max_depth=3, subsample=0.8,
                                 colsample=0.67, validation_col="is_val")
    return _prob1(model.score(m, t))


@register("m3_gbt_multiclass")
def q_m3m(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", *_CL_FEATURES)
    li = encode.label_encode(li, ["l_returnflag"])
    m = model.fit_gbt_classifier(li, ["l_quantity", *_CL_FEATURES], "l_returnflag", n_trees=5, max_depth=3)
    return model.score(m, li, keep=["l_orderkey", "l_linenumber", "l_returnflag"])


@register("m1_logistic_optimality", """
SELECT unnest(['intercept', 'l_extendedprice', 'l_discount', 'l_tax']) AS term, 0.0::DOUBLE AS gradient
""")
def q_m1_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """The penalised loss is flat where the fit ends: its gradient by term, over all training rows."""
    z = profile.standardize(_classification_table(spark, sf), _CL_FEATURES).filter("split = 'train'")
    m = model.fit_logistic(z, _CL_FEATURES, "label", C=0.5, tol=1e-12)
    s = model.score(m, z, keep=["label", *_CL_FEATURES])
    miss, weights = F.element_at("probability", 2) - F.col("label"), m.stages[-1].coefficients.toArray().tolist()
    slopes = [("intercept", F.avg(miss))] + [(c, F.avg(miss * F.col(c)) + F.lit(w / 0.5) / F.count("*")) for c, w in zip(_CL_FEATURES, weights)]
    one = s.agg(F.array(*[F.struct(F.lit(n).alias("term"), (F.round(g, 5) + 0.0).alias("gradient")) for n, g in slopes]).alias("g"))
    return one.select(F.inline("g"))


@register("m2_mlp_relu_adam")
def q_m2_adam(spark: SparkSession, sf: str) -> DataFrame:
    t = _classification_table(spark, sf)
    z = profile.standardize(t, _CL_FEATURES)
    m = model.fit_mlp(z.filter("split = 'train'"), _CL_FEATURES, "label", hidden="8,4", activation="relu", solver="adam", max_iter=4,
                      step_size=0.02, batches=4)
    return _prob1(model.score(m, z))


def _sum_classes(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with three classes by quantity and discount."""
    total = F.col("l_quantity").cast("double") + 100 * F.col("l_discount").cast("double")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", *_CL_FEATURES,
                                               F.when(total <= 20.5, 0).when(total <= 35.5, 1).otherwise(2).alias("label"))


@register("m3_softmax_round", """
WITH li AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x0, CAST(l_discount AS DOUBLE) AS x1, CAST(l_tax AS DOUBLE) AS x2,
         CASE WHEN CAST(l_quantity AS DOUBLE) + 100 * CAST(l_discount AS DOUBLE) <= 20.5 THEN 0
              WHEN CAST(l_quantity AS DOUBLE) + 100 * CAST(l_discount AS DOUBLE) <= 35.5 THEN 1 ELSE 2 END AS y
  FROM lineitem),
counts AS (
  SELECT f, x, y, count(*) AS n FROM (SELECT 0 AS f, x0 AS x, y FROM li UNION ALL SELECT 1, x1, y FROM li UNION ALL SELECT 2, x2, y FROM li)
  GROUP BY ALL),
sums AS (
  SELECT cls, f, x, sum(n * round(((1.0::DOUBLE / 3) - CASE WHEN y = cls THEN 1 ELSE 0 END) * 16777216)) / 16777216 AS g,
         sum(n) * round(4.0::DOUBLE / 9 * 16777216) / 16777216 AS h
  FROM counts, (SELECT unnest([0, 1, 2]) AS cls) GROUP BY ALL),
upto AS (
  SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY cls, f) AS tg, sum(h) OVER (PARTITION BY cls, f) AS th
  FROM sums WINDOW w AS (PARTITION BY cls, f ORDER BY x)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY cls ORDER BY
           gl * gl / (hl + 1) + (tg - gl) * (tg - gl) / (th - hl + 1) - tg * tg / (th + 1) DESC, f, x) AS place
  FROM upto WHERE hl >= 1 AND th - hl >= 1),
leaves AS (  -- a row of lineitem has no key of its own, so the three splits are laid beside each row
  SELECT list(f ORDER BY cls) AS f, list(x ORDER BY cls) AS x, list(-gl / (hl + 1) ORDER BY cls) AS below,
         list(-(tg - gl) / (th - hl + 1) ORDER BY cls) AS above
  FROM best WHERE place = 1),
scored AS (
  SELECT l_orderkey, l_linenumber,
         [exp(CASE WHEN [x0, x1, x2][f[i] + 1] <= x[i] THEN below[i] ELSE above[i] END) FOR i IN [1, 2, 3]] AS e
  FROM li, leaves)
SELECT l_orderkey, l_linenumber, round(e[1] / (e[1] + e[2] + e[3]), 6) AS prob_0,
       round(e[2] / (e[1] + e[2] + e[3]), 6) AS prob_1, round(e[3] / (e[1] + e[2] + e[3]), 6) AS prob_2
FROM scored
""")
def q_m3_round(spark: SparkSession, sf: str) -> DataFrame:
    """One round of softmax boosting with a single split per class, which SQL can follow."""
    t = _sum_classes(spark, sf)
    m = boosting.fit_boosted(t, ["l_quantity", "l_discount", "l_tax"], "label", learning_rate=1.0, n_trees=1, max_depth=1)
    s = model.score(m, t, keep=["l_orderkey", "l_linenumber"])
    return s.select("l_orderkey", "l_linenumber", *[r6(F.element_at("probability", i + 1)).alias(f"prob_{i}") for i in range(3)])


@register("m3_softmax_boosting")
def q_m3_softmax(spark: SparkSession, sf: str) -> DataFrame:
    t = split.stratified_split(_sum_classes(spark, sf), "label", (0.7, 0.15, 0.15), id_cols=["l_orderkey", "l_linenumber"])
    m = boosting.fit_boosted(t.filter("split != 'test'").withColumn("is_val", F.col("split") == "val"), ["l_quantity", *_CL_FEATURES], "label",
                             n_trees=4, max_depth=3, subsample=0.8, colsample=0.8, validation_col="is_val")
    return model.score(m, t, keep=["l_orderkey", "l_linenumber", "label", "split"])


@register("m3_boosting_watched_loss", "SELECT 0.0::DOUBLE AS loss_error, 1.0::DOUBLE AS importance_total, true AS falls")
def q_m3_loss(spark: SparkSession, sf: str) -> DataFrame:
    """The loss that training watched is that of the scores on the validation rows."""
    t = _classification_table(spark, sf).withColumn("is_val", F.col("split") == "val")
    m = boosting.fit_boosted(t.filter("split != 'test'"), _CL_FEATURES, "label", n_trees=3, max_depth=2, validation_col="is_val")
    val = model.score(m, t.filter("is_val"), keep=["label"])
    loss = F.avg(-F.log(F.element_at("probability", F.col("label") + 1)))
    return val.agg((F.round(loss - F.lit(m.losses[m.n_rounds]), 5) + 0.0).alias("loss_error"),
                   F.round(F.lit(sum(m.importances())), 9).alias("importance_total"), F.lit(m.losses[m.n_rounds] < m.losses[0]).alias("falls"))


@register("m14_reloaded_scores", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS differing FROM lineitem")
def q_m14(spark: SparkSession, sf: str) -> DataFrame:
    """A stored and reloaded model scores every row as the fitted one."""
    t, keys = _classification_table(spark, sf), ["l_orderkey", "l_linenumber"]
    m = model.fit_logistic(t.filter("split = 'train'"), _CL_FEATURES, "label", max_iter=20)
    path = files.scratch_path(spark, "m14-model")
    model.save_model(m, path)
    first = model.score(m, t, keep=[*keys, *_CL_FEATURES]).withColumnsRenamed({"prediction": "p1", "probability": "q1"})
    both = model.score(model.load_model(path), first)
    same = F.col("prediction").eqNullSafe(F.col("p1")) & F.col("probability").eqNullSafe(F.col("q1"))
    return both.agg(F.count("*").alias("n"), F.count_if(~same).alias("differing"))


def _lagged_daily(spark: SparkSession, sf: str, n_lags: int = 3) -> DataFrame:
    d = daily_rounded(spark, sf)
    d = encode.add_lags(d, ["total"], n_lags, order_cols=["day"], key="event_type")
    return encode.handle_lag_nulls(d, "drop")


@register("m4_gbt_forecaster")
def q_m4(spark: SparkSession, sf: str) -> DataFrame:
    d = _lagged_daily(spark, sf)
    feats = ["total_lag_1", "total_lag_2", "total_lag_3", "n_events"]
    s = split.temporal_split(d, order_cols=["day"], key="event_type", layout="keyed")
    m = model.fit_gbt_forecaster(s.filter("split = 'train'"), feats, "total", n_trees=20, max_depth=3)
    out = model.score(m, s.filter("split != 'train'"), keep=["event_type", "day", "split", "total"])
    return out


@register("m5_feature_importance")
def q_m5(spark: SparkSession, sf: str) -> DataFrame:
    t = _classification_table(spark, sf)
    m = model.fit_gbt_classifier(t.filter("split = 'train'"), _CL_FEATURES, "label", n_trees=10, max_depth=3)
    return model.feature_importance(m, _CL_FEATURES)


@register("m6_recursive_forecast")
def q_m6(spark: SparkSession, sf: str) -> DataFrame:
    d = _lagged_daily(spark, sf).drop("n_events")
    feats = ["total_lag_1", "total_lag_2", "total_lag_3"]
    m = model.fit_gbt_forecaster(d, feats, "total", n_trees=10, max_depth=3)
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy(F.desc("day"))
    last = d.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    # the newest row's lags shift by one: the last actual becomes lag 1
    last = last.select("event_type", F.col("total").alias("total_lag_1"), F.col("total_lag_1").alias("total_lag_2"),
                       F.col("total_lag_2").alias("total_lag_3"))
    return model.forecast_recursive(m, last, "total", 3, h=5, key="event_type")


@register("m7_ar1_fit", f"""
WITH z AS (SELECT event_type, total AS z, lag(total, 1) OVER (PARTITION BY event_type ORDER BY day) AS z1
           FROM ({_SQL_DAILY_R}))
SELECT event_type, round(regr_intercept(z, z1), 6) AS "const", round(regr_slope(z, z1), 6) AS ar_1,
       CAST(count(z1) AS BIGINT) AS n
FROM z GROUP BY 1""")
def q_m7(spark: SparkSession, sf: str) -> DataFrame:
    f = model.fit_ar(daily_rounded(spark, sf), "total", p=1, d=0, trend="c", order_cols=["day"], key="event_type")
    return f.select("event_type", r6(F.col("coef")[0]).alias("const"), r6(F.col("coef")[1]).alias("ar_1"),
                    F.col("n").cast("bigint").alias("n"))


@register("m7_ar_forecast")
def q_m7f(spark: SparkSession, sf: str) -> DataFrame:
    d = daily_rounded(spark, sf)
    f = model.fit_ar(d, "total", p=2, d=1, trend="c", order_cols=["day"], key="event_type")
    return model.forecast_ar(f, d, "total", 7, order_cols=["day"], key="event_type")


_AR_PAIRS = f"""
d AS (SELECT event_type, day, total::DOUBLE AS y, row_number() OVER w - 1 AS rid, lag(total) OVER w AS y1
      FROM ({_SQL_DAILY_R}) WINDOW w AS (PARTITION BY event_type ORDER BY day))"""


@register("m7_ar1_forecast", f"""
WITH {_AR_PAIRS},
f AS (SELECT event_type, regr_slope(y, y1) AS b, regr_intercept(y, y1) AS a, max_by(y, rid) AS last FROM d GROUP BY 1)
SELECT event_type, CAST(k AS INTEGER) AS step, round(a * (1 - power(b, k)) / (1 - b) + power(b, k) * last, 4) AS forecast
FROM f, (SELECT unnest(range(1, 8)) AS k)""")
def q_m7a(spark: SparkSession, sf: str) -> DataFrame:
    d = daily_rounded(spark, sf)
    f = model.fit_ar(d, "total", p=1, trend="c", order_cols=["day"], key="event_type")
    return model.forecast_ar(f, d, "total", 7, order_cols=["day"], key="event_type").select("event_type", "step", F.round("forecast", 4).alias("forecast"))


@register("m7_trend_exog_forecast", f"""
WITH {_AR_PAIRS},
t AS (SELECT event_type, regr_slope(y, rid) AS b, regr_intercept(y, rid) AS a, count(*) AS n FROM d GROUP BY 1),
e AS (SELECT event_type, regr_slope(total, n_events) AS b, regr_intercept(total, n_events) AS a FROM ({_SQL_DAILY_R}) GROUP BY 1)
SELECT event_type, 'trend' AS model, CAST(k AS INTEGER) AS step, round(a + b * (n + k - 1), 4) AS forecast FROM t, (SELECT unnest(range(1, 4)) AS k)
UNION ALL SELECT event_type, 'exog', CAST(k AS INTEGER), round(a + b * 10 * k, 4) FROM e, (SELECT unnest(range(1, 4)) AS k)""")
def q_m7t(spark: SparkSession, sf: str) -> DataFrame:
    """A trend goes on, and a regressor's future values are used."""
    d = daily_rounded(spark, sf)
    trend = model.forecast_ar(model.fit_ar(d, "total", p=0, trend="ct", order_cols=["day"], key="event_type"), d, "total", 3, ["day"], key="event_type")
    future = d.select("event_type").distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("n_events", F.col("step") * 10)
    exog = model.forecast_ar(model.fit_ar(d, "total", p=0, trend="c", exog=["n_events"], order_cols=["day"], key="event_type"), d, "total", 3,
                             ["day"], key="event_type", future=future)
    both = trend.withColumn("model", F.lit("trend")).unionByName(exog.withColumn("model", F.lit("exog")))
    return both.select("event_type", "model", "step", F.round("forecast", 4).alias("forecast"))


_SQL_PRICES = """
d AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS day, round(sum(l_extendedprice), 2) AS y FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, y - avg(y) OVER (PARTITION BY l_returnflag) AS c FROM d),
l AS (SELECT l_returnflag, c, lag(c) OVER (PARTITION BY l_returnflag ORDER BY day) AS c1 FROM m)"""


def daily_prices(spark: SparkSession, sf: str, level: float) -> DataFrame:
    li = table(spark, sf, "lineitem")
    daily = li.groupBy("l_returnflag", F.col("l_shipdate").cast("date").alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("y"))
    return daily.withColumn("y", F.col("y") + F.lit(float(level)))


@register("m7_ar_level_1e9", f"""
WITH {_SQL_PRICES}, r AS (SELECT l_returnflag, count(c1) AS n, regr_slope(c, c1) AS b, regr_syy(c, c1) * (1 - power(corr(c, c1), 2)) AS rss FROM l GROUP BY 1)
SELECT l_returnflag, CAST(n AS BIGINT) AS n, round(b, 6) AS ar_1, round(sqrt(rss / n), 3) AS sigma, round(n * ln(rss / n) + 6, 4) AS aic FROM r""")
def q_m7l(spark: SparkSession, sf: str) -> DataFrame:
    """A level of 1e9 changes neither the coefficient nor sigma nor AIC: the SQL fits the centred series."""
    f = model.fit_ar(daily_prices(spark, sf, 1e9), "y", p=1, trend="c", order_cols=["day"], key="l_returnflag")
    return f.select("l_returnflag", "n", F.round(F.col("coef")[1], 6).alias("ar_1"), F.round(F.sqrt("sigma2"), 3).alias("sigma"), F.round("aic", 4).alias("aic"))


@register("m7_arma_fit")
def q_m7ma(spark: SparkSession, sf: str) -> DataFrame:
    """ARMA(1, 1) of the daily totals, by series."""
    f = model.fit_ar(daily_prices(spark, sf, 1e6), "y", p=1, ma=1, trend="c", order_cols=["day"], key="l_returnflag")
    return f.select("l_returnflag", "n", *[F.round(F.col("coef")[i], 4).alias(c) for i, c in enumerate(("const", "ar_1", "ma_1"))], F.round("aic", 3).alias("aic"))


@register("m11_ar_search_levels", f"""
WITH {_SQL_PRICES},
r AS (SELECT l_returnflag, count(*) AS n, regr_syy(c, c1) * (1 - power(corr(c, c1), 2)) AS rss1, regr_syy(c, c1) AS rss0, var_pop(c - c1) * count(*) AS rssd
      FROM l WHERE c1 IS NOT NULL GROUP BY 1),
k AS (SELECT l_returnflag, unnest([0, 1, 2]) AS candidate, unnest([n * ln(rss0 / n) + 4, n * ln(rss1 / n) + 6, n * ln(rssd / n) + 4]) AS aic FROM r)
SELECT l_returnflag, CAST(level AS BIGINT) AS level, CAST(min_by(candidate, (aic, candidate)) AS INTEGER) AS candidate, round(min(aic), 3) AS aic
FROM k, (SELECT unnest([0, 1000000, 1000000000]) AS level) GROUP BY 1, 2""")
def q_m11l(spark: SparkSession, sf: str) -> DataFrame:
    """The candidate that wins by AIC does not depend on the level of the series."""
    grid = [{"p": 0, "d": 0, "trend": "c"}, {"p": 1, "d": 0, "trend": "c"}, {"p": 0, "d": 1, "trend": "c"}]
    series = daily_prices(spark, sf, 0.0).withColumn("level", F.explode(F.array(*[F.lit(v).cast("bigint") for v in (0, 1_000_000, 1_000_000_000)])))
    best = tune.ar_search(series.withColumn("y", F.col("y") + F.col("level")), "y", grid, ["day"], key=["l_returnflag", "level"])
    return best.select("l_returnflag", "level", "candidate", F.round("aic", 3).alias("aic"))


@register("m10_grid_search_cv")
def q_m10(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    t = _classification_table(spark, sf)
    lr = LogisticRegression(featuresCol="features", labelCol="_label", maxIter=50, standardization=False)
    grid = [{"regParam": 1e-4}, {"regParam": 1e-2}]
    data = VectorAssembler(inputCols=_CL_FEATURES, outputCol="features").transform(t)
    cvm = tune.grid_search_cv(lr, grid, data, "label", "l_orderkey", folds=3, parallelism=2)
    rows = [(i, g["regParam"], float(m)) for i, (g, m) in enumerate(zip(grid, cvm.avgMetrics))]
    return spark.createDataFrame(rows, "candidate int, regParam double, cv_accuracy double")


@register("m10_holdout_search")
def q_m10h(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    d = _lagged_daily(spark, sf)
    feats = ["total_lag_1", "total_lag_2", "total_lag_3"]
    s = split.temporal_split(d, order_cols=["day"], key="event_type", layout="keyed")
    s = VectorAssembler(inputCols=feats, outputCol="features").transform(s)
    est = GBTRegressor(featuresCol="features", labelCol="_label", seed=42)
    grid = [{"maxDepth": 2, "maxIter": 5}, {"maxDepth": 3, "maxIter": 10}]
    best, _, results = tune.holdout_search(est, grid, s.filter("split = 'train'"), s.filter("split = 'val'"),
                                           "total", parallelism=2)
    rows = [(i, int(g["maxDepth"]), int(g["maxIter"]), float(m), g == best) for i, (g, m) in enumerate(results)]
    return spark.createDataFrame(rows, "candidate int, maxDepth int, maxIter int, val_mse double, best boolean")


@register("m11_random_search")
def q_m11(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    d = _lagged_daily(spark, sf)
    feats = ["total_lag_1", "total_lag_2", "total_lag_3"]
    s = split.temporal_split(d, order_cols=["day"], key="event_type", layout="keyed")
    s = VectorAssembler(inputCols=feats, outputCol="features").transform(s)
    est = GBTRegressor(featuresCol="features", labelCol="_label", seed=42)
    space = {"maxDepth": ("int", 2, 4), "stepSize": ("loguniform", 0.01, 0.3), "maxIter": ("int", 3, 8)}
    best, _, results = tune.random_search(est, space, 3, s.filter("split = 'train'"), s.filter("split = 'val'"),
                                          "total", seed=42, parallelism=2)
    rows = [(i, int(g["maxDepth"]), float(g["stepSize"]), int(g["maxIter"]), float(m), g == best)
            for i, (g, m) in enumerate(results)]
    return spark.createDataFrame(rows, "draw int, maxDepth int, stepSize double, maxIter int, val_mse double, "
                                       "best boolean")


@register("m11_ar_search", f"""
WITH {_AR_PAIRS},
r AS (SELECT event_type, count(*) AS n, regr_syy(y, y1) * (1 - power(corr(y, y1), 2)) AS rss1, regr_syy(y, y1) AS rss0,
             var_pop(y - y1) * count(*) AS rssd FROM d WHERE y1 IS NOT NULL GROUP BY 1),
c AS (SELECT event_type, n, unnest([0, 1, 2]) AS candidate, unnest([0, 1, 0]) AS p, unnest([0, 0, 1]) AS d,
             unnest([n * ln(rss0 / n) + 4, n * ln(rss1 / n) + 6, n * ln(rssd / n) + 4]) AS aic,
             unnest([n * ln(rss0 / n) + 2 * ln(n), n * ln(rss1 / n) + 3 * ln(n), n * ln(rssd / n) + 2 * ln(n)]) AS bic FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY aic, candidate) AS k FROM c)
SELECT event_type, p, d, round(aic, 5) AS aic, round(bic, 5) AS bic, n, candidate FROM b WHERE k = 1""")
def q_m11a(spark: SparkSession, sf: str) -> DataFrame:
    grid = [{"p": 0, "d": 0, "trend": "c"}, {"p": 1, "d": 0, "trend": "c"}, {"p": 0, "d": 1, "trend": "c"}]
    best = tune.ar_search(daily_rounded(spark, sf), "total", grid, order_cols=["day"], key="event_type")
    return best.select("event_type", "p", "d", F.round("aic", 5).alias("aic"), F.round("bic", 5).alias("bic"), "n", "candidate")


@register("m11_seasonal_ar_search")
def q_m11s(spark: SparkSession, sf: str) -> DataFrame:
    grid = tune.ar_grid({"p": [1, 2], "d": [0, 1], "q": [0], "P": [1], "D": [0], "Q": [0], "s": [None, 7], "trend": ["c"]})
    best = tune.ar_search(daily_rounded(spark, sf), "total", grid, order_cols=["day"], key="event_type")
    return best.select("event_type", "p", "d", "sp", "season", "aic", "bic", "n", "candidate")


@register("m11_accuracy_search")
def q_m11c(spark: SparkSession, sf: str) -> DataFrame:
    t = _classification_table(spark, sf)
    space = {"C": ("loguniform", 0.01, 10.0), "solver": ("choice", ["lbfgs", "liblinear", "saga"]), "penalty": ("choice", ["l2", "l1"])}
    best, _, results = tune.accuracy_search(
        lambda train, **draw: model.fit_logistic(train, _CL_FEATURES, "label", max_iter=15, **draw), space, 4,
        t.filter("split = 'train'"), t.filter("split = 'val'"), "label", seed=3)
    rows = [(i, float(g["C"]), g["solver"], g["penalty"], acc, g == best) for i, (g, acc) in enumerate(results)]
    return spark.createDataFrame(rows, "draw int, C double, solver string, penalty string, accuracy double, best boolean")


_WALK_SQL = f"""
n AS (SELECT event_type, max(rid) + 1 AS n FROM d GROUP BY 1),
f AS (SELECT unnest([0, 1, 2]) AS fold),
t AS (SELECT d.event_type, fold, regr_slope(y, y1) AS b, regr_intercept(y, y1) AS a, max_by(y, rid) AS last
      FROM d JOIN n USING (event_type) JOIN f ON rid >= fold * 2 AND rid < fold * 2 + 14 AND n >= 16
      WHERE rid > fold * 2 GROUP BY 1, 2),
p AS (SELECT d.event_type, f.fold, CAST(rid - fold * 2 - 13 AS INTEGER) AS step, day, y AS actual
      FROM d JOIN f ON rid >= fold * 2 + 14 AND rid < fold * 2 + 16),
w AS (SELECT p.event_type, p.fold, step, day, actual, CASE step WHEN 1 THEN a + b * last ELSE a + b * (a + b * last) END AS forecast
      FROM p JOIN t ON p.event_type = t.event_type AND p.fold = t.fold),
x AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day, fold) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS k FROM w),
y AS (SELECT event_type, fold, step, day, actual, forecast, CASE WHEN i < k // 2 THEN 'val' ELSE 'test' END AS part FROM x)"""


@register("m12_walk_forward", f"""
WITH {_AR_PAIRS}, {_WALK_SQL}
SELECT event_type, fold, step, day, round(actual, 5) AS actual, round(forecast, 5) AS forecast, part FROM y""")
def q_m12(spark: SparkSession, sf: str) -> DataFrame:
    d = daily_rounded(spark, sf)
    w = tune.walk_forward(d, "total", ["day"], W=14, h=2, folds=3, p=1, d=0, trend="c", key="event_type")
    return w.select("event_type", "fold", "step", "day", F.round("actual", 5).alias("actual"), F.round("forecast", 5).alias("forecast"), "part")


@register("m12_walk_forward_metrics", f"""
WITH {_AR_PAIRS}, {_WALK_SQL}
SELECT event_type, part, count(*) AS n, round(avg((actual - forecast) * (actual - forecast)), 2) AS mse,
       round(avg(abs(actual - forecast)), 4) AS mae FROM y GROUP BY 1, 2""")
def q_m12m(spark: SparkSession, sf: str) -> DataFrame:
    d = daily_rounded(spark, sf)
    w = tune.walk_forward(d, "total", ["day"], W=14, h=2, folds=3, p=1, d=0, trend="c", key="event_type")
    return tune.walk_forward_metrics(w, "event_type").select("event_type", "part", "n", F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"))


@register("m14_save_load_score")
def q_m14(spark: SparkSession, sf: str) -> DataFrame:
    t = _classification_table(spark, sf)
    m = model.fit_logistic(t.filter("split = 'train'"), _CL_FEATURES, "label", max_iter=20)
    path = files.scratch_path(spark, "m14-model")
    model.save_model(m, path)
    return _prob1(model.score(model.load_model(path), t))


@register("m15_seasonal_naive", f"""
SELECT event_type, day, total, CAST(lag(total, 7) OVER (PARTITION BY event_type ORDER BY day) AS DOUBLE) AS forecast
FROM ({_SQL_DAILY_R})""")
def q_m15(spark: SparkSession, sf: str) -> DataFrame:
    d = daily_rounded(spark, sf).select("event_type", "day", "total")
    return model.forecast_naive(d, "total", season=7, order_cols=["day"], key="event_type")


# =============================================================================== run records and replay
from kiln.plans import replay, runs  # noqa: E402


def run_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One run document per (ship mode, line status) group of lineitem, built from the
    group's statistics: a cleaning step and a training step. The mode picks the record
    version and the status the search strategy, so the validation rules see records with
    numbers, text and nulls in the metrics, each strategy, and an unknown version."""
    li = (table(spark, sf, "lineitem").withColumn("l_returnflag", F.concat("l_returnflag", (F.col("l_linenumber") % 3).cast("string"))))
    per_day = li.groupBy("l_returnflag", "l_linestatus", F.dayofmonth("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("c"))
    days = per_day.groupBy("l_returnflag", "l_linestatus").agg(  # at most 31 items
        F.transform(F.array_sort(F.collect_list(F.struct("day", "c"))), lambda x: x["c"]).alias("days"))
    g = li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("q"),
        F.round(F.avg("l_discount"), 4).alias("d"), F.round(F.stddev_samp("l_extendedprice") / 1000, 4).alias("s")).join(days, ["l_returnflag", "l_linestatus"])
    flag, digit = F.substring("l_returnflag", 1, 1), F.substring("l_returnflag", 2, 1)
    version = F.when(flag == "R", "2.0").when((flag == "N") & (digit == "0"), "1.0").otherwise("1.1")
    strategy = (F.when(digit == "0", "grid").when((digit == "1") & (flag == "A"), "bayesian").when(digit == "1", "random")
                .when(F.col("l_linestatus") == "F", "bogus"))
    clean_step = F.struct(F.lit("data_cleaning").alias("step"),
                          F.struct(F.lit(True).alias("eliminar_duplicados"), F.lit("media").alias("relleno"))
                          .alias("params"), F.col("n").alias("rows"))
    train_step = F.struct(
        version.alias("schema_version"), F.lit("train_model").alias("step"), F.lit("xgboost").alias("algorithm"),
        F.struct(F.lit(100).alias("n_estimators")).alias("params"),
        F.struct(F.col("q").alias("val_rmse"), F.col("d").alias("val_mae"),
                 F.lit(None).cast("double").alias("val_mape"), F.col("s").alias("test_rmse"),
                 F.col("q").cast("string").alias("test_mae"), F.col("d").alias("test_mape")).alias("metrics"),
        F.struct(strategy.alias("strategy"), F.lit(4).alias("iterations_total"), F.lit(2).alias("best_iteration"),
                 F.col("q").alias("best_val_loss")).alias("hyperparameter_search"),
        F.struct((F.col("n") % 5).alias("n_trials"), F.lit(2).alias("n_initial_points"), F.lit(7).alias("seed")).alias("bayesian_config"),
        F.struct(F.lit(5).alias("sequence_length"), F.lit("a").alias("model_architecture"), digit.alias("training_mode"),
                 (F.col("n") % 2).alias("n_input_features")).alias("lstm_metadata"),
        F.col("days").alias("feature_list"))
    opts = {"ignoreNullFields": "false"}
    doc = F.concat(F.lit('{"steps":['), F.to_json(clean_step, opts), F.lit(","), F.to_json(train_step, opts),
                   F.lit("]}"))
    return g.select(F.concat("l_returnflag", "l_linestatus").alias("run_id"), "l_returnflag", doc.alias("doc"))


_SQL_DOCS = """
SELECT l_returnflag || l_linestatus AS run_id, l_returnflag,
  json_object('steps', json_array(
    json_object('step', 'data_cleaning', 'params', json_object('eliminar_duplicados', true, 'relleno', 'media'),
                'rows', n),
    json_object('schema_version', CASE WHEN flag = 'R' THEN '2.0' WHEN flag = 'N' AND digit = '0' THEN '1.0' ELSE '1.1' END,
                'step', 'train_model', 'algorithm', 'xgboost', 'params', json_object('n_estimators', 100),
                'metrics', json_object('val_rmse', q, 'val_mae', d, 'val_mape', NULL::DOUBLE, 'test_rmse', s,
                                       'test_mae', CAST(q AS VARCHAR), 'test_mape', d),
                'hyperparameter_search', json_object('strategy', CASE WHEN digit = '0' THEN 'grid' WHEN digit = '1' AND flag = 'A' THEN 'bayesian'
                                                                      WHEN digit = '1' THEN 'random' WHEN l_linestatus = 'F' THEN 'bogus' END,
                                                     'iterations_total', 4, 'best_iteration', 2, 'best_val_loss', q),
                'bayesian_config', json_object('n_trials', n % 5, 'n_initial_points', 2, 'seed', 7),
                'lstm_metadata', json_object('sequence_length', 5, 'model_architecture', 'a', 'training_mode', digit, 'n_input_features', n % 2),
                'feature_list', to_json(days)))) AS doc
FROM (SELECT l_returnflag || CAST(l_linenumber % 3 AS VARCHAR) AS l_returnflag, l_linestatus, any_value(l_returnflag) AS flag,
             CAST(any_value(l_linenumber % 3) AS VARCHAR) AS digit, count(*) AS n, round(avg(l_quantity), 4) AS q,
             round(avg(l_discount), 4) AS d, round(stddev_samp(l_extendedprice) / 1000, 4) AS s
      FROM lineitem GROUP BY ALL) g
JOIN (SELECT l_returnflag, l_linestatus, list(c ORDER BY day) AS days FROM (
        SELECT l_returnflag || CAST(l_linenumber % 3 AS VARCHAR) AS l_returnflag, l_linestatus, day(l_shipdate) AS day, count(*) AS c
        FROM lineitem GROUP BY ALL) GROUP BY ALL) d USING (l_returnflag, l_linestatus)"""

_SQL_STEPS = f"""
d AS ({_SQL_DOCS}),
s AS (SELECT run_id, l_returnflag, unnest(range(1, len(steps) + 1)) AS step_no, unnest(steps) AS st
      FROM (SELECT run_id, l_returnflag, CAST(json_extract(doc, '$.steps') AS JSON[]) AS steps FROM d))"""


@register("r1_append_runs", f"""
WITH {_SQL_STEPS}
SELECT run_id, CAST(step_no AS INTEGER) AS step_no, CAST(st AS VARCHAR) AS step_json FROM s""")
def q_r1(spark: SparkSession, sf: str) -> DataFrame:
    docs = run_documents(spark, sf)
    path = files.scratch_path(spark, "r1-runs")
    steps = runs.steps_of(docs)
    runs.append_run(spark, path, steps.filter("step_no = 1"))
    runs.append_run(spark, path, steps.filter("step_no = 2"))
    return spark.read.parquet(path).select("run_id", F.col("step_no").cast("int").alias("step_no"), "step_json")


@register("r2_flatten_runs", f"""
WITH {_SQL_STEPS},
k AS (SELECT run_id, CAST(step_no AS INTEGER) AS step_no, json_extract_string(st, '$.step') AS step,
             unnest(json_keys(st)) AS key, st FROM s),
v AS (SELECT *, json_extract(st, '$."' || key || '"') AS jv FROM k),
one AS (SELECT run_id, step_no, step, key, CAST(0 AS INTEGER) AS part,
               CASE WHEN json_type(jv) IN ('OBJECT', 'ARRAY') THEN CAST(jv AS VARCHAR)
                    ELSE json_extract_string(st, '$."' || key || '"') END AS value
        FROM v WHERE NOT (json_type(jv) = 'ARRAY' AND json_array_length(jv) > 15)),
many AS (SELECT run_id, step_no, step, key, CAST(p + 1 AS INTEGER) AS part,
                to_json(list_slice(CAST(jv AS JSON[]), p * 10 + 1, p * 10 + 10))::VARCHAR AS value
         FROM (SELECT *, unnest(range(0, CAST(ceil(json_array_length(jv) / 10) AS BIGINT))) AS p FROM v
               WHERE json_type(jv) = 'ARRAY' AND json_array_length(jv) > 15))
SELECT * FROM one UNION ALL SELECT * FROM many""")
def q_r2(spark: SparkSession, sf: str) -> DataFrame:
    return runs.flatten_runs(run_documents(spark, sf))


# The rules spelled out for DuckDB, one line per field: (broken when, error).
_R3_V11 = [f"(NOT json_exists(st, '$.{f}'), 'absent:{f}')" for f in (
    "schema_version", "step", "algorithm", "params", "metrics", "hyperparameter_search", "lstm_metadata")] + [
    f"(json_exists(st, '$.metrics') AND NOT json_exists(st, '$.metrics.{m}'), 'absent:metrics.{m}')" for m in (
        "val_rmse", "val_mae", "val_mape", "test_rmse", "test_mae", "test_mape")] + [
    f"(coalesce(json_type(st, '$.metrics.{m}') IN ('VARCHAR', 'ARRAY', 'OBJECT'), false), 'not_a_number:metrics.{m}')" for m in (
        "val_rmse", "val_mae", "val_mape", "test_rmse", "test_mae", "test_mape")] + [
    f"(json_exists(st, '$.hyperparameter_search') AND NOT json_exists(st, '$.hyperparameter_search.{f}'), 'absent:hyperparameter_search.{f}')"
    for f in ("strategy", "iterations_total", "best_iteration", "best_val_loss")] + [
    "(json_exists(st, '$.hyperparameter_search.strategy') AND coalesce(strat, '?') NOT IN ('none', 'grid', 'random', 'bayesian'), 'not_allowed:hyperparameter_search.strategy')",
    "(strat = 'grid' AND st->>'$.hyperparameter_search.grid_search_params' IS NULL, 'needed_by_strategy:hyperparameter_search.grid_search_params')",
    "(strat = 'random' AND st->>'$.hyperparameter_search.random_search_params' IS NULL, 'needed_by_strategy:hyperparameter_search.random_search_params')",
    "(strat = 'random' AND st->>'$.hyperparameter_search.n_random_iterations' IS NULL, 'needed_by_strategy:hyperparameter_search.n_random_iterations')",
    "(strat = 'bayesian' AND NOT json_exists(st, '$.bayesian_config'), 'needed_by_strategy:bayesian_config')"] + [
    f"(strat = 'bayesian' AND json_exists(st, '$.bayesian_config') AND NOT json_exists(st, '$.bayesian_config.{f}'), 'absent:bayesian_config.{f}')"
    for f in ("n_trials", "n_initial_points", "optimization_metric", "best_trial_number", "n_completed_trials", "best_params", "seed")] + [
    "(strat = 'bayesian' AND CAST(st->>'$.bayesian_config.n_trials' AS DOUBLE) < 1, 'too_small:bayesian_config.n_trials')",
    "(strat = 'bayesian' AND CAST(st->>'$.bayesian_config.n_initial_points' AS DOUBLE) >= CAST(st->>'$.bayesian_config.n_trials' AS DOUBLE), "
    "'not_below_n_trials:bayesian_config.n_initial_points')"] + [
    f"(json_exists(st, '$.lstm_metadata') AND NOT json_exists(st, '$.lstm_metadata.{f}'), 'absent:lstm_metadata.{f}')"
    for f in ("sequence_length", "model_architecture", "total_params", "cpu_only")] + [
    "(json_exists(st, '$.lstm_metadata.training_mode') AND coalesce(st->>'$.lstm_metadata.training_mode', '?') NOT IN ('univariate', 'multivariate'), "
    "'not_allowed:lstm_metadata.training_mode')",
    "(json_exists(st, '$.lstm_metadata.n_input_features') AND NOT coalesce(json_type(st, '$.lstm_metadata.n_input_features') IN ('UBIGINT', 'BIGINT') "
    "AND CAST(st->>'$.lstm_metadata.n_input_features' AS DOUBLE) >= 1, false), 'too_small:lstm_metadata.n_input_features')"]


def _validate_sql() -> str:
    v11 = ", ".join(f"CASE WHEN {x[1:-1].rsplit(', ', 1)[0]} THEN {x[1:-1].rsplit(', ', 1)[1]} END" for x in _R3_V11)
    return f"""
WITH {_SQL_STEPS},
t AS (SELECT *, json_extract_string(st, '$.hyperparameter_search.strategy') AS strat,
             coalesce(json_extract_string(st, '$.schema_version'), '1.0') AS version FROM s),
e AS (SELECT run_id, CAST(step_no AS INTEGER) AS step_no, version,
             CASE version WHEN '1.1' THEN list_filter([{v11}], lambda x: x IS NOT NULL)
                          WHEN '1.0' THEN list_filter([CASE WHEN NOT json_exists(st, '$.step') THEN 'absent:step' END,
                                                       CASE WHEN NOT json_exists(st, '$.algorithm') THEN 'absent:algorithm' END],
                                                      lambda x: x IS NOT NULL)
                          ELSE ['unknown_version:' || version] END AS errs FROM t)
SELECT run_id, step_no, version, len(errs) = 0 AS ok, array_to_string(errs, '; ') AS errors,
       CAST(len(errs) AS BIGINT) AS n_errors FROM e"""


@register("r3_validate_runs", _validate_sql())
def q_r3(spark: SparkSession, sf: str) -> DataFrame:
    v = runs.validate_runs(run_documents(spark, sf))
    return v.select("run_id", F.col("step_no").cast("int"), "version", "ok",
                    F.array_join("errors", "; ").alias("errors"), F.size("errors").cast("bigint").alias("n_errors"))


_SQL_METRICS_LONG = f"""
{_SQL_STEPS},
m AS (SELECT run_id, l_returnflag, CAST(step_no AS INTEGER) AS step_no, json_extract(st, '$.metrics') AS mj FROM s
      WHERE json_exists(st, '$.metrics')),
k AS (SELECT run_id, l_returnflag, step_no, unnest(json_keys(mj)) AS metric, mj FROM m),
l AS (SELECT run_id, l_returnflag, step_no, metric,
             TRY_CAST(json_extract_string(mj, '$."' || metric || '"') AS DOUBLE) AS value FROM k
      WHERE metric LIKE 'val\\_%' ESCAPE '\\' OR metric LIKE 'test\\_%' ESCAPE '\\')"""


@register("r5_metrics_long", f"WITH {_SQL_METRICS_LONG} SELECT run_id, step_no, metric, value FROM l WHERE value IS NOT NULL")
def q_r5(spark: SparkSession, sf: str) -> DataFrame:
    return runs.metrics_long(run_documents(spark, sf))


@register("r6_best_runs", f"""
WITH {_SQL_METRICS_LONG}
SELECT l_returnflag, arg_min(run_id, (value, run_id)) AS run_id, min(value) AS value
FROM l WHERE metric = 'val_rmse' AND value IS NOT NULL GROUP BY 1""")
def q_r6(spark: SparkSession, sf: str) -> DataFrame:
    docs = run_documents(spark, sf)
    m = runs.metrics_long(docs).join(docs.select("run_id", "l_returnflag"), "run_id")
    return runs.best_runs(m, "val_rmse", by="l_returnflag")


_REPLAY_CONFIG = {"steps": [
    {"step": "data_cleaning", "outputs": {"raw_data": {"path": "raw/x.csv"}},
     "parameters": {"eliminar_duplicados": True, "filtrar_outliers": True, "relleno_valores_numericos": "media", "valor_imputacion": None}},
    {"step": "data_encoding", "parameters": {"input_features": ["event_type", "event_type_vacio"], "target_variables": ["value"],
                                             "encode_target_ohe": False, "encode_target_label": False}},
]}
# A record that keeps duplicates and outliers, drops rows without values, label-encodes, and trains.
_REPLAY_CL = {"steps": [
    {"step": "data_cleaning", "parameters": {"eliminar_duplicados": False, "filtrar_outliers": False, "relleno_valores_numericos": "eliminar"}},
    {"step": "data_encoding", "parameters": {"input_features": ["value", "user_id"], "target_variables": ["event_type"], "encode_target_label": True}},
    {"step": "train_logistic_regression", "input_features": ["value", "user_id"], "target_variable": "event_type",
     "split_ratios": {"train": 0.6, "val": 0.2, "test": 0.2}, "hyperparameters": {"C": 1.0, "max_iter": 5, "solver": "lbfgs", "random_state": 42},
     "hyperparameter_search_strategy": "none", "grid_search": {"use_grid_search": False}},
]}
# A series record: a list of cleaning methods, two lags, rows without lags dropped, horizon 2.
_REPLAY_TS = {"steps": [
    {"step": "data_cleaning", "parameters": {"optional_methods": {"cleaning_methods": [
        {"method": "fill_missing_numeric_values", "params": {"method": "valor", "value": 0.0}}]}}},
    {"step": "data_encoding", "parameters": {"input_features": ["n_events"], "target_variables": ["total"], "date_column": "day",
                                             "lag_periods": 2, "lag_nan_handling": "drop"}},
    {"step": "train_xgboost", "date_col_name": "day", "target_variable": "total", "input_features": ["n_events"], "forecast_horizon": 2,
     "split_ratios": [0.7, 0.15, 0.15], "hyperparameters": {"n_estimators": 3, "max_depth": 2}},
]}


@register("r4_replay_tabular_record", f"""
WITH c AS (SELECT event_id, coalesce(nullif(trim(event_type), ''), 'vacio') AS event_type, user_id, value FROM ({SQL_DIRTY_EVENTS}) WHERE value IS NOT NULL),
l AS (SELECT event_id, user_id, value, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS event_type FROM c),
h AS (SELECT *, md5(concat_ws(chr(31), '42', event_id)) AS h FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM h),
t AS (SELECT *, ceil(n * 0.4::DOUBLE - 1e-9) AS nt, ceil(ceil(n * 0.4::DOUBLE - 1e-9) * 0.5::DOUBLE - 1e-9) AS ns FROM r)
SELECT event_id, user_id, value, event_type, CASE WHEN pos < n - nt THEN 'train' WHEN pos < n - ns THEN 'val' ELSE 'test' END AS split FROM t""")
def q_r4c(spark: SparkSession, sf: str) -> DataFrame:
    ev = dirty_events(spark, sf).select("event_id", "event_type", "user_id", "value")
    return replay.replay_steps(ev, _REPLAY_CL, train=False, id_cols=["event_id"]).splits.select("event_id", "user_id", "value", "event_type", "split")


@register("r4_replay_series_record", f"""
WITH e AS (SELECT CAST(ts AS DATE) AS day, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END) AS DOUBLE) AS total, count(*) AS n_events FROM events GROUP BY 1),
d AS (SELECT day, CASE WHEN day(day) % 5 = 0 THEN 0.0 ELSE round(total, 4) END AS total, n_events FROM e),
l AS (SELECT *, lag(n_events, 1) OVER w AS n1, lag(n_events, 2) OVER w AS n2 FROM d WINDOW w AS (ORDER BY day)),
k AS (SELECT day, n_events, n1, n2, lead(total, 2) OVER (ORDER BY day) AS y FROM l WHERE n2 IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS n FROM k WHERE y IS NOT NULL)
SELECT CAST(day AS TIMESTAMP) AS day, n_events, n1 AS n_events_lag_1, n2 AS n_events_lag_2, round(y, 4) AS y,
       CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""")
def q_r4t(spark: SparkSession, sf: str) -> DataFrame:
    kept = F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.col("value"))
    daily = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum(kept).alias("total"), F.count(F.lit(1)).alias("n_events"))
    daily = daily.withColumn("total", F.when(F.dayofmonth("day") % 5 != 0, F.round("total", 4)))
    out = replay.replay_steps(daily, _REPLAY_TS, train=False).splits
    return out.select(F.col("day").cast("timestamp_ntz").alias("day"), "n_events", F.col("n_events_lag_1").cast("bigint").alias("n_events_lag_1"),
                      F.col("n_events_lag_2").cast("bigint").alias("n_events_lag_2"), F.round("y", 4).alias("y"), "split")


# A recorded grid search over autoregressions, and a recorded model with a regressor.
_REPLAY_GRID = {"steps": [
    {"step": "data_cleaning", "parameters": {"optional_methods": None}},
    {"step": "train_arima", "date_col_name": "day", "target_variable": "total", "forecast_horizon": 1, "split_ratios": [0.7, 0.15, 0.15],
     "hyperparameter_search_strategy": "grid", "grid_search": {"use_grid_search": True, "p": [0, 1], "d": [0], "q": [0], "trend": ["c"]}}]}
_REPLAY_EXOG = {"steps": [
    {"step": "data_cleaning", "parameters": {"optional_methods": None}},
    {"step": "train_sarimax", "date_col_name": "day", "target_variable": "total", "input_features": ["n_events"], "split_ratios": [0.7, 0.15, 0.15],
     "hyperparameters": {"p": 0, "d": 0, "trend": "c"}}]}
_SQL_REPLAY_DAYS = """
e AS (SELECT CAST(ts AS DATE) AS day, round(sum(value), 4) AS y, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY 1),
r AS (SELECT *, lag(y) OVER (ORDER BY day) AS y1, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS n FROM e),
t AS (SELECT * FROM r WHERE pos < floor(n * 0.7::DOUBLE)),
s AS (SELECT y, CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS step, x FROM r WHERE pos >= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE))"""


def _replay_days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).cast("double").alias("n_events"))


@register("r4_replay_grid_record", f"""
WITH {_SQL_REPLAY_DAYS},
f AS (SELECT count(*) AS n, regr_syy(y, y1) * (1 - power(corr(y, y1), 2)) AS rss1, regr_syy(y, y1) AS rss0, regr_slope(y, y1) AS b,
             regr_intercept(y, y1) AS a, avg(y) AS m FROM t WHERE y1 IS NOT NULL),
w AS (SELECT n * ln(rss0 / n) + 4 <= n * ln(rss1 / n) + 6 AS plain, a, b, (SELECT avg(y) FROM t) AS m, (SELECT max_by(y, pos) FROM t) AS last FROM f)
SELECT step, CASE WHEN plain THEN 0 ELSE 1 END AS p, round(CASE WHEN plain THEN m ELSE a * (1 - power(b, step)) / (1 - b) + power(b, step) * last END, 3) AS forecast,
       round(y, 4) AS actual FROM s, w""")
def q_r4g(spark: SparkSession, sf: str) -> DataFrame:
    res = replay.replay_steps(_replay_days(spark, sf), _REPLAY_GRID)
    return res.forecast.select("step", F.lit(res.best["p"]).alias("p"), F.round("forecast", 3).alias("forecast"), F.round("actual", 4).alias("actual"))


@register("r4_replay_regressor_record", f"""
WITH {_SQL_REPLAY_DAYS}, f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t)
SELECT step, round(a + b * x, 3) AS forecast, round(y, 4) AS actual FROM s, f""")
def q_r4x(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay_steps(_replay_days(spark, sf), _REPLAY_EXOG).forecast.select("step", F.round("forecast", 3).alias("forecast"), F.round("actual", 4).alias("actual"))


@register("r4_replay_recorded_steps", _cl_flow_sql("""
SELECT event_id, ts, user_id, round(value, 6) AS value,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS event_type_error,
       CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS event_type_purchase,
       CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS event_type_signup,
       CASE WHEN event_type = 'vacio' THEN 1 ELSE 0 END AS event_type_vacio,
       CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS event_type_view
FROM {last}"""))
def q_r4(spark: SparkSession, sf: str) -> DataFrame:
    res = replay.replay_steps(dirty_events(spark, sf, with_empty=True), _REPLAY_CONFIG, train=False)
    return _rounded(res.training_table, keep=())


# =============================================================================== streaming
from kiln.streaming import clean_stream  # noqa: E402


@register("streaming_row_local_clean", f"""
SELECT event_id, ts, user_id, coalesce(event_type, 'vacio') AS event_type, coalesce(value, 0.0::DOUBLE) AS value
FROM {_BLANKED}""")
def q_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The row-local cleaning operators on a Structured Streaming source over the events
    table (availableNow trigger, Parquet sink in the shared checkpoint folder)."""
    src = clean_stream.stream_table(spark, f"{sf.rstrip('/')}/events.parquet", table(spark, sf, "events"))
    eid = F.col("event_id")
    dirty = src.select(eid, "ts", "user_id",
                       F.when(eid % 11 == 0, F.lit("   ")).when(eid % 5 == 0, F.concat(F.lit("  "), F.col("event_type"),
                                                                                      F.lit(" ")))
                       .otherwise(F.col("event_type")).alias("event_type"),
                       F.when(eid % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"))
    out = clean_stream.run_available_now(spark, dirty, lambda d: clean_stream.row_local_clean(d, fill_value=0.0),
                                         name="events-clean")
    return out.select("event_id", "ts", "user_id", "event_type", "value")


@register("g15_famd")
def q_g15(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    coords, _ = profile.famd(li, ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"],
                             k=2, keep=["l_orderkey", "l_linenumber"])
    return coords


@register("g15_famd_wide")
def q_g15_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Every part and supplier is a category."""
    coords, _ = wide_factors.famd_wide(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_partkey", "l_suppkey"],
                                       k=2, keep=["l_orderkey", "l_linenumber"], tol=1e-6, max_rounds=8)
    return coords


@register("g15_famd_wide_two_sides", """
SELECT l_orderkey, l_linenumber, round(abs(a + sign(r) * b) / sqrt(2.0::DOUBLE), 5) AS first, round(abs(a - sign(r) * b) / sqrt(2.0::DOUBLE), 5) AS second
FROM (SELECT l_orderkey, l_linenumber, (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem) AS a,
             ((l_linestatus = 'F')::INT - p) / sqrt(p * (1 - p)) AS b
      FROM lineitem, (SELECT avg((l_linestatus = 'F')::INT) AS p FROM lineitem)),
     (SELECT corr(l_quantity, (l_linestatus = 'F')::INT) AS r FROM lineitem)
""")
def q_g15_sides(spark: SparkSession, sf: str) -> DataFrame:
    """The two indicators of a two-valued column are one standardised column; the axes are diagonals."""
    coords, _ = wide_factors.famd_wide(table(spark, sf, "lineitem"), ["l_quantity"], ["l_linestatus"], k=2, keep=["l_orderkey", "l_linenumber"])
    return coords.select("l_orderkey", "l_linenumber", F.round(F.abs(F.col("coords")[0]), 5).alias("first"), F.round(F.abs(F.col("coords")[1]), 5).alias("second"))


@register("g16_pca")
def q_g16(spark: SparkSession, sf: str) -> DataFrame:
    coords, _ = profile.pca(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                            k=2, keep=["l_orderkey", "l_linenumber"])
    return coords


_Z2 = """
SELECT l_orderkey, l_linenumber, (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem) AS a,
       (l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem) AS b FROM lineitem"""


@register("g16_pca_two_columns", f"""
SELECT l_orderkey, l_linenumber, round(abs(a + sign(r) * b) / sqrt(2.0::DOUBLE), 5) AS first, round(abs(a - sign(r) * b) / sqrt(2.0::DOUBLE), 5) AS second
FROM ({_Z2}), (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)""")
def q_g16t(spark: SparkSession, sf: str) -> DataFrame:
    """Two standardised columns have the diagonals as axes; signs are arbitrary, so sizes."""
    coords, _ = profile.pca(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], k=2, keep=["l_orderkey", "l_linenumber"])
    return coords.select("l_orderkey", "l_linenumber", F.round(F.abs(F.col("coords")[0]), 5).alias("first"), F.round(F.abs(F.col("coords")[1]), 5).alias("second"))


@register("g17_explained_two_columns", """
SELECT CAST(k AS INTEGER) AS component, round(CASE k WHEN 1 THEN (1 + abs(r)) / 2 ELSE (1 - abs(r)) / 2 END, 6) AS explained_variance_ratio
FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem), (SELECT unnest([1, 2]) AS k)""")
def q_g17t(spark: SparkSession, sf: str) -> DataFrame:
    _, m = profile.pca(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], k=2)
    e = profile.explained(m)
    return e.select(F.col(e.columns[0]).cast("int").alias("component"), F.round(F.col(e.columns[1]), 6).alias("explained_variance_ratio"))


@register("g17_explained_variance")
def q_g17(spark: SparkSession, sf: str) -> DataFrame:
    _, m = profile.pca(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], k=4)
    return profile.explained(m)


def _assoc_sql() -> str:
    num, cat = ["l_quantity", "l_discount"], ["l_returnflag", "l_linestatus"]
    parts = [f"""SELECT 'l_discount' AS a, 'l_quantity' AS b, 'spearman' AS method, round(corr(l_discount, l_quantity), 6) AS value
FROM ({_ranked_sql(num)})"""]
    binned = {c: _decile_sql(c, "SELECT * FROM lineitem") for c in num}
    pairs = [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_quantity"), ("l_returnflag", "l_discount"),
             ("l_linestatus", "l_quantity"), ("l_linestatus", "l_discount")]
    for a, b in pairs:
        bexpr = binned.get(b, b)
        src = f"SELECT {a}, {bexpr} AS {b} FROM lineitem"
        parts.append(f"SELECT a, b, 'cramers_v' AS method, cramers_v AS value FROM ({_cramers_sql(src, a, b)})")
    return " UNION ALL ".join(parts)


@register("g8_associations_auto", _assoc_sql())
def q_g8(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return _rounded(assoc.associations(li, ["l_quantity", "l_discount"], ["l_returnflag", "l_linestatus"]))


@register("x8_mape_eps", _reg_sql("SELECT event_type, value - 5.0 AS y, value AS p FROM events", "event_type", "y", "p",
                                  "1e-10"))
def q_x8(spark: SparkSession, sf: str) -> DataFrame:
    """MAPE over rows with |y| > 1e-10 (values shifted so some actuals are ~0)."""
    ev = table(spark, sf, "events").select("event_type", (F.col("value") - 5.0).alias("y"), F.col("value").alias("p"))
    return _rounded(metrics.regression_metrics(ev, "y", "p", by="event_type", mape_eps=1e-10))


@register("d12_regular_first_column", f"""
WITH s AS ({_regular_sql(f"SELECT 0 AS k, day FROM ({_SQL_DAILY}) GROUP BY day", "k", "day")})
SELECT is_regular FROM s""")
def q_d12(spark: SparkSession, sf: str) -> DataFrame:
    """Regularity of a table whose first column is the date (no column named): the daily totals of
    all event types."""
    d = daily_events(spark, sf)
    return dates.is_regular(d.groupBy("day").agg(F.sum("total").alias("total"), F.sum("n_events").alias("n_events")))


def _ovr_sql() -> str:
    parts = [f"SELECT '{c}' AS cls, CAST({_OVO_PROBS[i]} AS DOUBLE) AS s, CAST(l_returnflag = '{c}' AS INTEGER) AS y "
             f"FROM lineitem" for i, c in enumerate(_OVO_CLASSES)]
    return f"""
WITH e AS ({" UNION ALL ".join(parts)}),
s AS (SELECT cls, s, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM e GROUP BY 1, 2),
c AS (SELECT cls, s,
             sum(pos) OVER (PARTITION BY cls ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(neg) OVER (PARTITION BY cls ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
             sum(pos) OVER (PARTITION BY cls) AS P, sum(neg) OVER (PARTITION BY cls) AS N FROM s)
SELECT cls AS class, 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr FROM (SELECT DISTINCT cls FROM s)
UNION ALL SELECT cls, s, round(CASE WHEN N > 0 THEN fp / N END, 6), round(CASE WHEN P > 0 THEN tp / P END, 6) FROM c"""


@register("x6_roc_curves_multiclass", _ovr_sql())
def q_x6m(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    x = li.select("l_returnflag", F.array((F.col("l_quantity") / 50.0), F.col("l_discount") * 10.0,
                                          F.col("l_tax") * 12.5).alias("probs"))
    out = metrics.roc_curves_ovr(x, "l_returnflag", "probs", _OVO_CLASSES, drop_intermediate=False)
    return _rounded(out.select("class", "threshold", "fpr", "tpr"), keep=("threshold",))
