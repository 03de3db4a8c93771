"""The blocked layout must equal one global window, for any block size and partitioning."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF
from kiln.operators.order import add_lag_columns, assign_row_id, forward_fill, running_sum


@pytest.mark.parametrize("key,block,parts,layout", [(None, 7, 3, "auto"), ("event_type", 5, 8, "blocked"),
                                                    ("event_type", 5, 8, "auto"), (None, 1000, 1, "auto")])
def test_blocked_equals_global(spark, key, block, parts, layout):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev = ev.withColumn("v", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")))
    r = assign_row_id(ev, ["ts", "event_id"], key=key, with_count="n", partitions=parts, layout=layout)
    r = add_lag_columns(r, key, "row_id", [("l1", "value", 1), ("l3", "value", 3), ("f2", "value", -2)], block=block)
    r = running_sum(r, key, "row_id", "value", "cs", block=block)
    r = forward_fill(r, key, "row_id", ["v"], block=block)
    keys = [key] if key else []
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    g = ev.select("event_id", (F.row_number().over(w) - 1).alias("rid"), F.lag("value", 1).over(w).alias("gl1"),
                  F.lag("value", 3).over(w).alias("gl3"), F.lead("value", 2).over(w).alias("gf2"),
                  F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("gcs"),
                  F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("gv"),
                  F.count("*").over(Window.partitionBy(*keys)).alias("gn"))
    j = r.join(g, "event_id")
    ok = (F.col("row_id").eqNullSafe(F.col("rid")) & F.col("l1").eqNullSafe(F.col("gl1"))
          & F.col("l3").eqNullSafe(F.col("gl3")) & F.col("f2").eqNullSafe(F.col("gf2"))
          & (F.abs(F.col("cs") - F.col("gcs")) < 1e-6) & F.col("v").eqNullSafe(F.col("gv"))
          & (F.col("n") == F.col("gn")))
    assert r.count() == ev.count()
    assert j.filter(~ok).count() == 0
