"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.shared import stored


def _sum_of(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return r[0], r[1]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns) but the roots themselves;
    the root is the smallest node of its component.

    Every round replaces the edges by at most as many, writes them to the shared folder, and
    joins them with one minimum per node, so a node with very many neighbours costs rows, not
    one task's memory. Rounds grow with the logarithm of the longest chain.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = stored(edges.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))
                 .where("hi != lo").distinct(), "edges")
    before = _sum_of(now)
    while before[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, F.col("u") == F.col("k"))
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct())
        large = stored(large, "large-star")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(low, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .union(low.select("hi", F.col("m").alias("lo"))).distinct())
        now = stored(small, "small-star")
        after = _sum_of(now)
        if after == before:
            break
        before = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
