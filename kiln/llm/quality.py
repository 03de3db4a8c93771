"""Quality classifier: hashed word n-grams, logistic regression by FTRL (operator 5).

Features are word unigrams and bigrams, each once as written and once as word shapes (capitals,
digits, marks, and whether a word repeats the one before), hashed to ``2**bits`` coordinates. A
document's value at a coordinate is its share of the document's n-grams times ``scale``, so a
score is a bias plus a sparse dot product with the weights, whatever the length of the text.

Training: the labelled rows (at most about ``max_train``, the documented bound, chosen by a hash
of the id) are dealt by that hash over ``shards`` groups; each group runs
follow-the-regularised-leader updates over its rows in a fixed order, and the shards' weights
are averaged by coordinate. Weights that reach the driver are bounded by ``2**bits``.

Only the text enters a score. Defined results: NULL and empty texts have no n-grams and score
by the bias alone; rows with a NULL label, or an id that is not labelled, are not learnt from;
an id labelled twice is learnt from once per label. Without any usable label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.shared import bounded_batches, fresh
from kiln.llm.text import Batch, mix


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    scale: float = 16.0
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 1.0
    epochs: int = 4
    shards: int = 4
    max_train: int = 20_000


#: Byte classes for word shapes: 0 lower-case or beyond ASCII, 1 upper-case, 2 digit, 3 sentence mark, 4 other mark.
KIND = np.zeros(256, dtype=np.uint64)
KIND[33:127] = 4
KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 3
KIND[48:58], KIND[65:91], KIND[97:123] = 2, 1, 0


def _shapes(b: Batch) -> np.ndarray:
    """A small number for each word: kinds of its first and last byte, its capitals and marks."""
    kind = KIND[b.raw]
    def some(k, least):
        seen = np.concatenate([[0], np.cumsum(kind == k)])
        return (seen[b.end] - seen[b.start] >= least).astype(np.uint64)

    return ((((kind[b.start] * np.uint64(5) + kind[b.end - 1]) * np.uint64(2) + some(1, 2)) * np.uint64(2) + some(3, 2))
            * np.uint64(2) + some(4, 1)) * np.uint64(2) + some(2, 1)


def features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all n-grams of the texts, one text after the other, and where each begins."""
    b = Batch([(t or "").encode("utf-8") for t in texts])
    ids = b.ids()
    shape, fits, own = _shapes(b), b.fits(2), b.owner()
    pair = own[: len(fits)][fits]
    again = (ids[1:] == ids[:-1]).astype(np.uint64) if len(ids) > 1 else np.zeros(0, np.uint64)
    shapes = mix((shape[:-1] * np.uint64(1024) + shape[1:]) * np.uint64(4) + again + np.uint64(2)) if len(ids) > 1 else again
    grams = np.concatenate([ids, b.windows(2, ids=ids)[fits], mix(shape + np.uint64(1 << 40)), shapes[fits]])
    text = np.concatenate([own, pair, own, pair])
    order = np.argsort(text, kind="stable")
    first = np.searchsorted(text[order], np.arange(len(texts) + 1))
    return (grams[order] >> np.uint64(64 - bits)).astype(np.int64), first


def _examples(texts, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    at, first = features(texts, bits)
    out = []
    for i, j in zip(first[:-1], first[1:]):
        where, count = np.unique(at[i:j], return_counts=True)
        out.append((where, count / max(j - i, 1)))
    return out


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias after per-coordinate FTRL-proximal passes over the examples in order."""
    size = (1 << s.bits) + 1  # the last coordinate is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(k):
        zk = z[k]
        w = -(zk - np.sign(zk) * s.l1) / ((s.beta + np.sqrt(n[k])) / s.alpha + s.l2)
        return np.where(np.abs(zk) <= s.l1, 0.0, w)

    for _ in range(s.epochs):
        for (where, share), y in zip(examples, labels):
            k, x = np.append(where, size - 1), np.append(share * s.scale, 1.0)
            w = weights(k)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / s.alpha * w
            n[k] += g * g
    w = weights(np.arange(size))
    return w[:-1], float(w[-1])


def train(examples: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Weights and bias from rows (doc_id, text, label in 0/1)."""
    rows = examples.where("label is not null").select(F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "text", F.col("label").cast("int").alias("label"))
    total = rows.count()
    if total > s.max_train:
        rows = rows.where(F.col("h") < F.lit(int((2 * s.max_train / total - 1) * 2**63)))
    rows = rows.withColumn("shard", F.pmod(F.shiftright("h", 8), F.lit(s.shards)))

    def shard(pdf):
        import pandas as pd

        pdf = pdf.assign(size=pdf["text"].fillna("").str.len()).sort_values(["h", "label", "size", "text"])
        texts, found = pdf["text"].tolist(), []
        for i in range(0, len(texts), 500):
            found += _examples([t if isinstance(t, str) else "" for t in texts[i:i + 500]], s.bits)
        w, bias = ftrl(found, pdf["label"].to_numpy(float), s)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": np.append(at, 1 << s.bits), "w": np.append(w[at], bias)})

    parts = rows.groupBy("shard").applyInPandas(shard, "at long, w double")
    mean = parts.groupBy("at").agg((F.sum("w")).alias("w"), F.count(F.lit(1)).alias("n")).toPandas()
    weights = np.zeros(1 << s.bits)
    shards = max(int(mean.loc[mean["at"] == 1 << s.bits, "n"].sum()), 1)
    own = mean[mean["at"] < 1 << s.bits]
    weights[own["at"].to_numpy(np.int64)] = own["w"].to_numpy() / shards
    return weights, float(mean.loc[mean["at"] == 1 << s.bits, "w"].sum() / shards)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", out_col: str = "score", s: Settings = Settings()) -> DataFrame:
    """``docs`` with the probability of label 1, from the text alone; a column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(out_col)
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                at, first = features(part.column(text_col).to_pylist(), s.bits)
                sums = np.concatenate([[0.0], np.cumsum(weights[at], dtype=np.float64)])
                n = np.diff(first)
                dot = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1) * s.scale
                p = 1.0 / (1.0 + np.exp(-np.clip(dot + bias, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*part.schema.names, out_col])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(out_col)).schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept out of training: CRC-32 of the id as text, modulo 5, is 0 (a NULL id is kept out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("label")).where(
        "label is not null and _id is not null").distinct()
    return docs.select("doc_id", "text").where(~held_out()).join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, s: Settings = Settings()) -> DataFrame:
    """``docs`` (doc_id, text, ...) with held_out, score and predicted (columns of those names are
    replaced); learns from the rows of ``labels`` (doc_id, quality) that are not held out."""
    examples = training_rows(docs, labels)
    return (score(docs.withColumn("held_out", held_out()), train(examples, s), s=s)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def passed(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their own columns only."""
    name = fresh(docs, "score")
    model = train(training_rows(docs, labels), s)
    return score(docs, model, out_col=name, s=s).where(F.col(name) >= threshold).drop(name)
