"""Scans and sinks.

CSV is read by Spark's CSV source (header, inferred or given schema, PERMISSIVE), then
the pandas missing tokens become NULL in one projection; BOM and duplicate header names
are repaired on the schema only. ARFF is a Spark text job: the ``@attribute`` lines are
found with a distributed filter and the data lines are parsed with ``from_csv`` against
the schema built from them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.exprs import PANDAS_NA_TOKENS, q
from kiln.operators.clean import na_tokens_to_null
from kiln.operators.order import assign_row_id, running_sum
from kiln.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/kiln-scratch/{name}-{uuid.uuid4().hex[:12]}"


# ----------------------------------------------------------------------------- S1
def columns_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Header names as pandas reports them (BOM stripped, repeats as x, x.1), read from the
    first line only (Spark's own header handling renames repeats differently)."""
    import csv

    first = spark.read.text(path).limit(1).collect()
    if not first:
        return []
    return dedupe_names(next(csv.reader([first[0]["value"]], delimiter=sep)))


def dedupe_names(names: Sequence[str]) -> list[str]:
    """Strip a UTF-8 BOM from the first name and rename repeats as pandas does (x, x.1)."""
    out, seen = [], {}
    for i, n in enumerate(names):
        n = n.lstrip("﻿") if i == 0 else n
        if n in seen:
            seen[n] += 1
            cand = f"{n}.{seen[n]}"
            while cand in seen:
                seen[n] += 1
                cand = f"{n}.{seen[n]}"
            seen[cand] = 0
            out.append(cand)
        else:
            seen[n] = 0
            out.append(n)
    return out


# ----------------------------------------------------------------------------- S2
def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             na_tokens: Sequence[str] = PANDAS_NA_TOKENS, sep: str = ",", infer: bool = True,
             multiline: bool = False) -> DataFrame:
    """CSV with header (UTF-8, optional BOM), pandas NA tokens as NULL, inferred types;
    ragged rows are padded with NULL (PERMISSIVE). A quote inside a quoted cell is doubled.
    ``multiline`` allows line feeds inside quoted cells; such files cannot be split, so it is
    the caller's choice."""
    r = (spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("escape", '"')
         .option("encoding", "UTF-8").option("nullValue", "").option("emptyValue", "").option("multiLine", multiline)
         .option("maxCharsPerColumn", -1))
    if schema is not None:
        df = r.schema(schema).csv(path)
    else:
        # Infer on text first, so that NA tokens do not force a column to string.
        raw = r.option("inferSchema", False).csv(path)
        names = columns_of(spark, path, sep)
        if len(names) == len(raw.columns):
            raw = raw.toDF(*names)
        raw = na_tokens_to_null(raw, na_tokens)
        if not infer:
            return raw
        df = _infer_types(raw)
        return df
    names = columns_of(spark, path, sep)
    return df.toDF(*names) if len(names) == len(df.columns) else df


def _infer_types(raw: DataFrame) -> DataFrame:
    """bigint / double / timestamp / boolean / string per column from one aggregate over
    the text (pandas-like: a column is numeric only if every non-null cell is)."""
    checks = []
    for i, c in enumerate(raw.columns):
        v = q(c)
        checks += [
            F.bool_and(v.isNull() | v.try_cast("bigint").isNotNull()).alias(f"i{i}"),
            F.bool_and(v.isNull() | v.try_cast("double").isNotNull()).alias(f"d{i}"),
            F.bool_and(v.isNull() | F.lower(v).isin("true", "false")).alias(f"b{i}"),
            F.bool_and(v.isNull() | F.try_to_timestamp(v, F.lit("yyyy-MM-dd[ HH:mm:ss[.SSSSSS]]")).isNotNull()).alias(f"t{i}"),
            F.count(v).alias(f"n{i}"),
        ]
    row = raw.agg(*checks).first()
    exprs = []
    for i, c in enumerate(raw.columns):
        if row[f"n{i}"] == 0:
            exprs.append(q(c).cast("double").alias(c))  # all-missing column: float like pandas
        elif row[f"i{i}"]:
            exprs.append(q(c).try_cast("bigint").alias(c))
        elif row[f"d{i}"]:
            exprs.append(q(c).try_cast("double").alias(c))
        elif row[f"b{i}"]:
            exprs.append((F.lower(q(c)) == "true").alias(c))
        elif row[f"t{i}"]:
            exprs.append(F.try_to_timestamp(q(c), F.lit("yyyy-MM-dd[ HH:mm:ss[.SSSSSS]]")).cast("timestamp_ntz").alias(c))
        else:
            exprs.append(q(c))
    return raw.select(*exprs)


# ----------------------------------------------------------------------------- S3
# One cell of a data line: quoted with either quote (a backslash escapes), or bare.
_ARFF_CELL = (r"(?:^|,)[ \t]*+('[^'\\]*+(?:\\.[^'\\]*+)*+'|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|[^,]*+)")
_ARFF_ESCAPES = [("n", "\n"), ("r", "\r"), ("t", "\t")]


# The name (quoted with either quote, or bare) and the kind that an attribute line declares.
_ARFF_ATTRIBUTE = r"^\S+\s+(?:'([^']*)'|\"([^\"]*)\"|(\S+))\s*(.*)$"
# The kinds of number columns.
_ARFF_NUMBERS = ("numeric", "real", "integer")


def _arff_text(cell):
    """A cell's text: NULL for ``?``, quotes taken off and escapes undone."""
    quoted = cell.rlike("^['\"]")
    inner = F.substr(cell, F.lit(2), F.length(cell) - 2)
    inner = F.replace(inner, F.lit("\\\\"), F.lit("\u0000"))  # a lone marker while the others are undone
    for mark, char in _ARFF_ESCAPES:
        inner = F.replace(inner, F.lit("\\" + mark), F.lit(char))
    inner = F.replace(F.regexp_replace(inner, r"\\(['\"%])", "$1"), F.lit("\u0000"), F.lit("\\"))
    bare = F.trim(cell)
    return F.when(quoted, inner).when(bare != "?", bare)


def scan_arff(spark: SparkSession, path: str) -> DataFrame:
    """ARFF files: per file, the ``@attribute`` lines before ``@data`` give the columns (numeric
    -> double, nominal and string -> string) and every later line that is not blank is a row,
    whatever it begins with; ``?`` is missing, cells may be quoted with either quote. Files may
    declare their columns in different orders: rows are matched by name, and a column that a
    file lacks is NULL. Every file's layout is a row that its lines are joined with; the driver sees
    the distinct columns only, however many files there are."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("f"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("o"),
        F.regexp_replace("value", "\r$", "").alias("l"))
    begins = lines.filter(F.lower(F.trim("l")) == "@data").groupBy("f").agg(F.min("o").alias("at"))
    heads = lines.join(begins, "f").filter((F.col("o") < F.col("at")) & F.lower(F.trim("l")).startswith("@attribute"))
    part = lambda i: F.regexp_extract(F.trim("l"), _ARFF_ATTRIBUTE, i)
    heads = heads.select("f", "o", F.concat(part(1), part(2), part(3)).alias("name"),
                         F.lower(F.trim(part(4))).isin(*_ARFF_NUMBERS).alias("number"))
    place = F.struct("f", "o")  # columns in order of first appearance; the last declaration gives the kind
    kinds = heads.groupBy("name").agg(F.min(place).alias("first"), F.max_by("number", place).alias("number")).orderBy("first").collect()
    names = F.transform(F.array_sort(F.collect_list(F.struct("o", "name"))), lambda x: x["name"])
    layouts = heads.groupBy("f").agg(names.alias("names")).select(
        "f", F.array(*[F.array_position("names", F.lit(k["name"])) for k in kinds]).alias("places"))
    rows = lines.join(begins.join(layouts, "f", "left"), "f").filter((F.col("o") > F.col("at")) & (F.trim("l") != ""))
    rows = rows.select("places", F.regexp_extract_all("l", F.lit(_ARFF_CELL), F.lit(1)).alias("c"))
    out = []
    for i, k in enumerate(kinds):
        cell = _arff_text(F.get("c", F.get("places", F.lit(i)).cast("int") - 1))
        out.append((cell.try_cast("double") if k["number"] else cell).alias(k["name"]))
    return rows.select(*out)


def write_arff(df: DataFrame, path: str, relation: str = "data") -> None:
    """Write a table as ARFF part files, each with its own header; text is quoted and escaped
    where it needs to be, so any text comes back. One more part holds a header alone, so a table
    without rows comes back too."""
    head = [f"@relation {relation}"]
    for f in df.schema.fields:
        kind = "numeric" if isinstance(f.dataType, T.NumericType) else "string"
        head.append(f"@attribute '{f.name}' {kind}")
    head.append("@data")

    def cell(f: T.StructField):
        c = q(f.name).cast("string")
        if not isinstance(f.dataType, T.NumericType):
            safe = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
            for mark, char in _ARFF_ESCAPES:
                safe = F.replace(safe, F.lit(char), F.lit("\\" + mark))
            c = F.when(c.rlike(r"^[A-Za-z0-9_.:/+-]+$"), c).otherwise(F.concat(F.lit("'"), safe, F.lit("'")))
        return F.coalesce(c, F.lit("?"))

    row = F.concat_ws(",", *[cell(f) for f in df.schema.fields])
    # the header is the first row of every part: rows are numbered inside their partition
    body = df.select(row.alias("value"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    first = F.col("i") == F.shiftleft(F.col("p").cast("bigint"), 33)
    lines = F.when(first, F.array(*[F.lit(h) for h in head], F.col("value"))).otherwise(F.array("value"))
    alone = df.sparkSession.range(1, numPartitions=1).select(F.explode(F.array(*[F.lit(h) for h in head])).alias("value"))
    body.select(F.explode(lines).alias("value")).union(alone).write.mode("overwrite").text(path)


# ----------------------------------------------------------------------------- S4 / S5
def write_table(df: DataFrame, path: str, fmt: str = "parquet", source_path: str | None = None) -> None:
    """Overwrite ``path`` with the table (header for CSV, no index)."""
    if source_path and source_path.rstrip("/") == path.rstrip("/"):
        raise ValueError("output path equals the input path")
    w = df.write.mode("overwrite")
    if fmt == "csv":
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
          .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.format(fmt).save(path)


def write_by_series(df: DataFrame, path: str, key: str, fmt: str = "parquet") -> None:
    """One output folder per series. A rebalance on the key lets Spark split a series that holds
    a large share of the rows over as many tasks as its size asks for, and merge small ones."""
    df.hint("rebalance", q(key)).write.mode("overwrite").partitionBy(key).format(fmt).save(path)


# ----------------------------------------------------------------------------- S6
def row_bytes(df: DataFrame, cols: Sequence[str] | None = None) -> F.Column:
    """Bytes of the row as a CSV line (comma-joined text plus newline)."""
    cols = list(cols or df.columns)
    return F.octet_length(F.concat_ws(",", *[F.coalesce(q(c).cast("string"), F.lit("")) for c in cols])) + 1


def take_bytes(df: DataFrame, order_cols: Sequence[str], max_bytes: int, block: int | None = None) -> DataFrame:
    """Longest prefix (in ``order_cols`` order) whose CSV bytes stay within the budget. Byte
    totals of the range partitions first tell how far the prefix can reach; only rows up to
    there are put in exact order and summed."""
    order = [q(c) for c in order_cols]
    x = df.withColumn("_b", row_bytes(df))
    ranged = x.select(*order, "_b").repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    totals = ranged.groupBy("_p").agg(F.sum("_b").alias("b"), F.max(F.struct(*order)).alias("last")).orderBy("_p").collect()
    reach, last = 0, None
    for t in totals:  # one row for each range partition
        reach, last = reach + t["b"], t["last"]
        if reach > max_bytes:
            break
    if reach > max_bytes:
        types = df.select(*order).schema
        bound = F.struct(*[F.lit(last[i]).cast(f.dataType).alias(f.name) for i, f in enumerate(types.fields)])
        x = x.filter(F.struct(*order) <= bound)
    x = assign_row_id(x, list(order_cols), row_id="_rid")
    x = running_sum(x, None, "_rid", "_b", "_cum", block=block)
    return x.filter(F.col("_cum") <= F.lit(max_bytes)).select(*df.columns)


# ----------------------------------------------------------------------------- S7 / S8
def first_n_plus_last(df: DataFrame, n: int) -> DataFrame:
    cols = df.columns
    keep = list(dict.fromkeys([*cols[:n], cols[-1]]))
    return df.select(*[q(c) for c in keep])


def preview(df: DataFrame, n: int = 100, order_cols: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows in ``order_cols`` order (TakeOrderedAndProject, no full sort)."""
    if order_cols:
        return df.orderBy(*[q(c) for c in order_cols]).limit(n)
    return df.limit(n)


def first_values(df: DataFrame, col: str, n: int = 5, order_cols: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` non-null values of a column."""
    return preview(df.filter(q(col).isNotNull()).select(*[q(c) for c in dict.fromkeys([col, *(order_cols or [])])]),
                   n, order_cols)
