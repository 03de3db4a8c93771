"""A training-corpus pipeline over ``documents``, in five stages of ``kiln.llm`` operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet
in the shared folder and reads again as the next stage's input. All stages but the last return
the columns they were given.

Defined results: rows with NULL text count as empty text; rows without a doc_id are compared like
any other and rank after rows with one; an empty table stays empty; columns beyond those of
``documents`` pass through, whatever their names.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import queries
from kiln.llm.bpe import bpe_round_trip
from kiln.llm.decontaminate import mark_items
from kiln.llm.quality import passed
from kiln.llm.secret_scan import redacted
from kiln.llm.shared import fresh, stored
from kiln.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return passed(docs, queries.table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component."""
    return one_of_each(docs, shingle=3, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    name = fresh(docs, "items")
    marked = mark_items(docs, queries.table(spark, sf_dir, "benchmark"), out_col=name, threshold=0.8, shingle=5)
    return marked.where(F.size(name) == 0).drop(name)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts secrets out of the texts; the documents stay, ``n_chars`` follows their text."""
    out = redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (token ids) and decoded (their text)."""
    path = os.environ.get("KILN_TOKENIZER") or queries.tokenizer_path()
    rows = docs.select("doc_id", "lang", "source", "text")
    coded = bpe_round_trip(rows, path)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("tokens", tokens)]

#: Training and SimHash are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
