"""The flagship end-to-end plan: clean a dirty event log, build daily series per event
type, re-index, add lags, split in time and score a naive forecast.

events (planted blanks / NULLs) -> trim -> blank->NULL -> 'vacio' -> mean fill ->
sequential IQR filter -> daily totals per event_type -> regular daily grid -> lags 1..3
-> drop NULL rows -> temporal split 70/15/15 -> last-value forecast -> MSE / RMSE / MAE /
MAPE per event_type and split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.functions.exprs import r6
from kiln.operators import clean, dates, encode, metrics, model, split
from kiln.plans.tables import dirty_events

DAY_US = 86_400_000_000


def cleaned_events(spark: SparkSession, sf_dir: str, outlier_method: str = "exact") -> DataFrame:
    x = dirty_events(spark, sf_dir)
    x = clean.trim_cells(x)
    x = clean.blank_to_null(x)
    x = clean.fill_categorical_df(x)
    x, _ = clean.fill_numeric(x, "mean")
    x, _ = clean.filter_outliers(x, 2.5, method=outlier_method)
    return x


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular daily totals per event_type (missing days as NULL rows)."""
    x = cleaned_events(spark, sf_dir)
    daily = x.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    return dates.reindex(daily, "day", key="event_type", step_us=DAY_US)


def naive_forecast_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = daily_series(spark, sf_dir)
    # After re-indexing, the position of a day is a closed form: days since the series start.
    start = g.groupBy("event_type").agg(F.min("day").alias("_d0"))
    g = g.join(start, "event_type").withColumn("_rid", F.datediff("day", "_d0").cast("bigint")).drop("_d0")
    g = encode.add_lags(g, ["total"], 3, key="event_type", row_id="_rid")
    g = encode.handle_lag_nulls(g.drop("_rid"), "drop")
    # Daily series are bounded by the calendar (one row per day and type), so a keyed
    # window is the cheapest exact position here.
    g = split.temporal_split(g, (0.7, 0.15, 0.15), order_cols=["day"], key="event_type", layout="keyed")
    g = model.forecast_naive(g, "total", lag_col="total_lag_1")
    m = metrics.regression_metrics(g, "total", "forecast", by=["event_type", "split"])
    return m.select("event_type", "split", F.col("n").cast("bigint").alias("n"), r6(F.col("mse")).alias("mse"),
                    r6(F.col("rmse")).alias("rmse"), r6(F.col("mae")).alias("mae"), r6(F.col("mape")).alias("mape"))
