"""Structured Streaming entry for the row-local operators.

Trim (C2), blank-to-NULL (C3), constant numeric fill (C8), categorical fill (C11), fixed-
format date parsing (D1 with a given format), UTC standardisation (D2) and boolean casts
(E5) are stateless projections, so the same functions accept a streaming DataFrame. The
stream runs with an ``availableNow`` trigger into a Parquet sink whose checkpoint lives in
the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.operators import clean, dates, encode
from kiln.sources.files import scratch_path


def row_local_clean(df: DataFrame, fill_value: float | None = None, date_col: str | None = None,
                    date_format: str | None = None) -> DataFrame:
    x = clean.trim_cells(df)
    x = clean.blank_to_null(x)
    x = clean.fill_categorical_df(x)
    if fill_value is not None:
        num = [f.name for f in x.schema.fields if f.dataType.typeName() in ("double", "float")]
        x = x.select(*[F.coalesce(F.col(c), F.lit(float(fill_value))).alias(c) if c in num else F.col(c)
                       for c in x.columns])
    if date_col and date_format:
        x = x.withColumn(date_col, F.try_to_timestamp(F.col(date_col), F.lit(date_format)).cast("timestamp_ntz"))
    elif date_col:
        x = dates.to_utc(x, date_col)
    return encode.bool_to_int(x)


def run_available_now(spark: SparkSession, source: DataFrame, transform: Callable[[DataFrame], DataFrame],
                      name: str = "stream") -> DataFrame:
    """Process everything available in a streaming source once, write Parquet, and
    return the written table as a batch DataFrame."""
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    q = (transform(source).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def stream_table(spark: SparkSession, path: str, like: DataFrame, max_files: int | None = None) -> DataFrame:
    """A file-source stream over a Parquet folder, or over one Parquet file (given as a
    one-file glob with its folder as base path, as the file source expects folders)."""
    r = spark.readStream.schema(like.schema).format("parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    p = path.rstrip("/")
    if p.endswith(".parquet"):
        parent, name = p.rsplit("/", 1)
        return r.option("basePath", parent).load(f"{parent}/{name[:-1]}[{name[-1]}]")
    return r.load(p)
