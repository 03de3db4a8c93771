"""Small helpers the operators share: shared scratch space and clash-free column names."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from kiln.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back: cuts lineage durably."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to Python at a time; long documents make batches of few rows.
BATCH_BYTES = 8 << 20


def size_of(setting: str) -> int:
    """Bytes of a size setting such as ``8388608``, ``64m`` or ``1gb``."""
    number, unit = re.fullmatch(r"\s*([0-9]+)\s*([a-z]*)\s*", setting.lower()).groups()
    return int(number) << 10 * ("kmgtp".index(unit[0]) + 1 if unit.strip("b") else 0)


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ``BATCH_BYTES``, so that a task's memory does not
    grow with the length of documents; a smaller setting stays. It is not raised again, as the
    operators' tables are read later."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if size_of(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(total: int, each: int, least: int) -> int:
    """So many buckets that each gets about ``each`` of ``total`` items, ``least`` or more."""
    return max(least, math.ceil(total / each), 1)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
