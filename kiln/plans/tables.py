"""Loading the driver tables and the deterministic dirtying recipes.

The test tables hold no NULLs, blanks or bad dates, so cleaning and date queries derive
dirty inputs with fixed expressions that DuckDB evaluates identically (recipes in
FIXTURES.md). Every row of the source table is kept: the expressions only change values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty_event_type() -> F.Column:
    """Blanks on every 11th id, padded text on every 5th."""
    eid = F.col("event_id")
    return (F.when(eid % 11 == 0, F.lit("   "))
             .when(eid % 5 == 0, F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")))
             .otherwise(F.col("event_type")))


def dirty_value() -> F.Column:
    """NULL on every 7th id."""
    return F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))


def dirty_events(spark: SparkSession, sf_dir: str, with_empty: bool = False) -> DataFrame:
    """events(event_id, ts, user_id, event_type*, value*) with planted blanks and NULLs."""
    ev = table(spark, sf_dir, "events")
    cols = [F.col("event_id"), F.col("ts"), F.col("user_id"), dirty_event_type().alias("event_type"),
            dirty_value().alias("value")]
    if with_empty:
        cols.append(F.lit(None).cast("double").alias("empty_col"))
    return ev.select(*cols)


def dirty_orders_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderdate as dd/MM/yyyy text, every 13th key replaced by 'bad'."""
    o = table(spark, sf_dir, "orders")
    txt = F.when(F.col("o_orderkey") % 13 == 0, F.lit("bad")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return o.select("o_orderkey", txt.alias("o_date_text"))


def holey_events_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ts NULL where event_id % 10 in (3, 4) or event_id < 2."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    ts = F.when((eid % 10).isin(3, 4) | (eid < 2), F.lit(None)).otherwise(F.col("ts"))
    return ev.select("event_id", ts.alias("ts"), "event_type", "value")


def daily_event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D13 / E7-E10 / P3-P8 / X7-X14 input: daily sum of value per event_type."""
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy("event_type", F.to_date("ts").alias("day"))
              .agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_events")))
