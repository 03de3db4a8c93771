"""Radix counts of inversions against a plain loop over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import assoc, inversions


def plain(rows):
    """rows: (order, rank, count)."""
    rows = sorted(rows)
    return sum(a[2] * b[2] for i, a in enumerate(rows) for b in rows[i + 1:] if a[1] > b[1])


@pytest.mark.parametrize("ranks", [1, 2, 256, 257, 70_000, 1 << 25])
def test_matches_pairs(spark, ranks):
    rng = random.Random(ranks)
    rows = [(i, rng.randrange(ranks), rng.choice([1, 1, 2, 9])) for i in range(600)]
    df = spark.createDataFrame(rows, "o long, r long, c long")
    assert int(inversions.inversions(df, ["o"], "r", "c", ranks).first()[0]) == plain(rows)


def test_groups_over_many_batches_and_partitions(spark):
    """A group that goes on over batches of seven rows and over all range partitions."""
    rng = random.Random(5)
    rows = [(i, rng.choice([3, 3, 3, 300, rng.randrange(1000)]), rng.randrange(1, 4)) for i in range(1500)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = inversions.inversions(spark.createDataFrame(rows, "o long, r long, c long"), ["o"], "r", "c", 1000).first()[0]
    finally:
        spark.conf.set(key, old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert int(got) == plain(rows)


def test_falling_order_and_empty(spark):
    n = 4000
    df = spark.range(n).select("id", (n - 1 - F.col("id")).alias("r"), F.lit(1).alias("c"))
    assert int(inversions.inversions(df, ["id"], "r", "c", n).first()[0]) == n * (n - 1) // 2
    assert int(inversions.inversions(df.filter("id < 0"), ["id"], "r", "c", 0).first()[0]) == 0


def test_counts_beyond_64_bits(spark):
    big = 10 ** 11
    df = spark.createDataFrame([(0, 1, big), (1, 0, big)], "o long, r long, c long")
    assert int(inversions.inversions(df, ["o"], "r", "c", 2).first()[0]) == big * big
    assert inversions._dot(np.array([1 << 40]), np.array([1 << 40])) == 1 << 80


def test_kendall_without_pairs_or_variation(spark):
    none = assoc.kendall_tau(spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double"), "a", "b").first()
    assert (none.concordant, none.discordant, none.tau_b) == (0, 0, None)
    rng = random.Random(9)
    rows = [(float(rng.randrange(9)), float(rng.randrange(400))) for _ in range(500)]
    pairs = [(a[0] - b[0]) * (a[1] - b[1]) for i, a in enumerate(rows) for b in rows[i + 1:]]
    got = assoc.kendall_tau(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    assert (got.concordant, got.discordant) == (sum(p > 0 for p in pairs), sum(p < 0 for p in pairs))
