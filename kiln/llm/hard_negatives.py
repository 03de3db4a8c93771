"""Hard negatives from cover trees over all rows (operator 11).

For every anchor row: its positives are the ``positives`` rows of its own label with the highest
inner products; the negatives of a positive with score p are the first ``negatives`` rows of other
labels whose score lies between ``low`` and ``high`` of p (integer fractions, compared without
rounding). Higher scores come first, then smaller ids, NULL ids last.

Rows are packed where they lie into chunks of at most ``CHUNK_ROWS`` rows, each stored with its cover
tree (``cover_tree``). Anchors go out in blocks of at most ``BLOCK_VALUES`` numbers, the bound of
what is broadcast and of what the driver holds at a time; each block meets all chunks twice, first
for positives, then for negatives in the windows that these span. A task carries the best rows so
far from chunk to chunk, which narrows its search, and hands over at most ``positives`` (then
``negatives``) rows per anchor (and positive); Spark takes the first of these. A block's rows are
written before the next one starts. Work is anchors times rows at worst, in blocks, and less where
covering radii keep chunks' nodes outside the windows.

Defined results: a row with a NULL label or vector, or with a NULL entry, takes no part; an empty
vector is the zero vector, and shorter vectors are filled up with zeros. An anchor is one row: rows
that repeat it, ids included, are other rows, and every repeated anchor is an anchor. Scores whose
hundredfold leaves 64 bits are an error. An empty table, or one without anchors, gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.llm.cover_tree import FAR, Best, Tree, build, descend
from kiln.llm.shared import bounded_batches, scratch, stored
from kiln.operators.order import assign_row_id

CHUNK_ROWS = 8192
#: Numbers in a chunk at most (a single longer vector is a chunk of its own), and in a block of anchors.
CHUNK_VALUES = 1 << 20
BLOCK_VALUES = 1 << 20
#: Anchors that go through a tree together.
TOGETHER = 64
#: Longest squared lengths that floats, and the comparison of hundredfold scores in 64 bits, hold exactly.
EXACT, MOST = float(1 << 53), float(1 << 56)

RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _small(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the fewest bytes."""
    for kind in ("<i1", "<i2", "<i4"):
        if x.size == 0 or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x.astype("<i8")


CHUNK = ("chunk bigint, n int, d int, longest double, anchors binary, ids binary, nulls binary, labels binary, kind string, x binary, n_nodes int, "
         "nodes binary, radius binary")
_WHOLE = [f for f in Tree.FIELDS if f != "radius"]


def _packed(number: int, ids, null, labels, x, anchor) -> pa.RecordBatch:
    tree, order = build(ids, null, labels, x)
    small = _small(tree.x)
    nodes = np.stack([getattr(tree, f) for f in _WHOLE]).astype("<i8")
    row = [number, len(x), x.shape[1], tree.longest2, np.flatnonzero(anchor[order]).astype("<i4").tobytes(), tree.ids.astype("<i8").tobytes(),
           tree.null.tobytes(), tree.labels.astype("<i8").tobytes(), small.dtype.str, small.tobytes(), nodes.shape[1], nodes.tobytes(), tree.radius.tobytes()]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 4, pa.string(), pa.binary(), pa.int32(), *[pa.binary()] * 2]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in CHUNK.split(", ")])


def _unpacked(r: dict, d: int, kind) -> Tree:
    n = r["n"]
    x = np.zeros((n, d), dtype=kind)
    x[:, :r["d"]] = np.frombuffer(r["x"], dtype=r["kind"]).reshape(n, r["d"])
    nodes = dict(zip(_WHOLE, np.frombuffer(r["nodes"], dtype="<i8").reshape(len(_WHOLE), r["n_nodes"])))
    nodes["radius"] = np.frombuffer(r["radius"])
    return Tree(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["nulls"], bool), np.frombuffer(r["labels"], "<i8"), x, nodes)


def planted(df: DataFrame, id_col: str, vector_col: str, label_col: str, anchor: Column) -> DataFrame:
    """The rows packed into chunks with their trees; the vectors are array<bigint>."""
    bounded_batches(df.sparkSession)
    vector = F.col(f"`{vector_col}`")
    whole = F.col(f"`{label_col}`").isNotNull() & F.coalesce(F.forall(vector, lambda v: v.isNotNull()), F.lit(False))
    rows = df.where(whole).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), vector.alias("x"),
                                  F.coalesce(anchor, F.lit(False)).alias("anchor"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, rows_held = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                lengths = np.diff(batch.column(2).offsets.to_numpy())[at:]
                widest = max([int(lengths[0]), *[h[2].shape[1] for h in held]])
                room = min(CHUNK_ROWS, max(1, CHUNK_VALUES // max(1, widest))) - rows_held
                if room <= 0:
                    yield held
                    held, rows_held = [], 0
                    continue
                fitting = np.flatnonzero(lengths > widest)  # a wider vector is looked at anew
                take = min(room, int(fitting[0]) if len(fitting) else len(lengths))
                part = batch.slice(at, take)
                size = lengths[:take]
                x = np.zeros((take, int(size.max(initial=0))), dtype=np.int64)
                x[np.arange(x.shape[1]) < size[:, None]] = part.column(2).flatten().to_numpy()
                held.append((part.column(0).fill_null(0).to_numpy(), part.column(0).is_null().to_numpy(zero_copy_only=False), x,
                             part.column(1).to_numpy(), part.column(3).to_numpy(zero_copy_only=False)))
                rows_held += take
                at += take
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for held in chunks(batches):
            d = max(h[2].shape[1] for h in held)
            x = np.concatenate([np.pad(h[2], ((0, 0), (0, d - h[2].shape[1]))) for h in held])
            ids, null, labels, anchor_rows = (np.concatenate([h[k] for h in held]) for k in (0, 1, 3, 4))
            yield _packed(number, ids, null, labels.astype(np.int64), x, anchor_rows)
            number += 1

    return stored(rows.mapInArrow(run, CHUNK), "cover-trees")


ANCHOR = "chunk bigint, row int, id bigint, label bigint, x array<bigint>"


def _anchors(chunks: DataFrame) -> DataFrame:
    """One row per anchor, with its place in the chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tree, at = _unpacked(r, r["d"], np.int64), np.frombuffer(r["anchors"], "<i4")
                ends = pa.array(np.arange(len(at) + 1) * r["d"], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["chunk"])), pa.array(at), pa.array(tree.ids[at], mask=tree.null[at]),
                                                  pa.array(tree.labels[at]), pa.ListArray.from_arrays(ends, pa.array(tree.x[at].ravel()))],
                                                 names=["chunk", "row", "id", "label", "x"])

    return chunks.where(F.length("anchors") > 0).mapInArrow(run, ANCHOR)


class _Block:
    """A block of anchors as arrays; ``low`` and ``high`` are windows by anchor."""

    def __init__(self, table: pa.Table, d: int, kind):
        n = table.num_rows
        vectors = table.column("x").combine_chunks()
        size = np.diff(vectors.offsets.to_numpy()) if n else np.zeros(0, dtype=int)
        self.q = np.zeros((n, d), dtype=kind)
        self.q[np.arange(d) < size[:, None]] = vectors.flatten().to_numpy() if n else []
        self.chunk, self.row, self.label = (table.column(c).to_numpy() for c in ("chunk", "row", "label"))
        self.ids = table.column("id").to_pylist()


def _search(chunks: DataFrame, block: _Block, low: np.ndarray, high: np.ndarray, k: int, same: bool, d: int, kind) -> tuple[DataFrame, Broadcast]:
    """The first ``k`` rows of every (anchor, window): group (anchor number times windows plus
    window), score, id, rank; and the block that was sent for it."""
    sent = chunks.sparkSession.sparkContext.broadcast((block.q, block.label, block.chunk, block.row, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, label, home, row, low, high = sent.value
        cuts = [slice(a, a + TOGETHER) for a in range(0, len(q), TOGETHER)]
        best = [Best(k, low[c], high[c]) for c in cuts]
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                tree = _unpacked(r, d, kind)
                for c, b in zip(cuts, best):
                    descend(tree, q[c], label[c], np.where(home[c] == r["chunk"], row[c], -1), b, same)
        for c, b in zip(cuts, best):
            yield pa.RecordBatch.from_arrays([pa.array(b.group + c.start * low.shape[1]), pa.array(b.score.astype(np.int64)), pa.array(b.ids, mask=b.null)],
                                             names=["group", "score", "id"])

    found = chunks.mapInArrow(run, "group bigint, score bigint, id bigint")
    first = Window.partitionBy("group").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k), sent


def mine(df: DataFrame, id_col: str, vector_col: str, label_col: str, anchor: Column, positives: int = 5, negatives: int = 10,
         low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100)) -> DataFrame:
    """Hard negatives of all anchors: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. ``low`` and ``high`` are fractions (numerator, denominator) of a positive's score."""
    spark = df.sparkSession
    chunks = planted(df, id_col, vector_col, label_col, anchor)
    path = scratch(spark, "hard-negatives")
    spark.createDataFrame([], RESULT).write.parquet(path)
    shape = chunks.agg(F.max("d").alias("d"), F.max("longest").alias("longest")).first()
    d, longest = shape["d"] or 0, shape["longest"] or 0.0
    if longest >= MOST:
        raise ValueError("scores beyond 64 bits: scale the vectors down")
    kind = np.float64 if longest < EXACT else np.int64
    numbered = stored(assign_row_id(_anchors(chunks), ["chunk", "row"], row_id="no"), "anchors")
    each = max(1, BLOCK_VALUES // max(1, d))
    for start in range(0, numbered.count(), each):
        rows = numbered.where((F.col("no") >= start) & (F.col("no") < start + each))
        block = _Block(rows.orderBy("no").toArrow(), d, kind)
        made, sent = _mine_block(spark, chunks, block, positives, negatives, low, high, d, kind)
        made.write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(RESULT).parquet(path)


def _mine_block(spark: SparkSession, chunks: DataFrame, block: _Block, positives: int, negatives: int, low, high, d: int,
                kind) -> tuple[DataFrame, Broadcast]:
    n = len(block.q)
    nearest, sent = _search(chunks, block, np.full((n, 1), -FAR, dtype=kind), np.full((n, 1), FAR, dtype=kind), positives, True, d, kind)
    found = nearest.toArrow()
    sent.destroy()
    anchor, place = found.column("group").to_numpy(), found.column("rank").to_numpy() - 1  # at most ``positives`` rows an anchor
    score = found.column("score").to_numpy()
    lows, highs = np.full((n, positives), FAR, dtype=kind), np.full((n, positives), -FAR, dtype=kind)
    lows[anchor, place] = -((-low[0] * score) // low[1])
    highs[anchor, place] = (high[0] * score) // high[1]
    known = pa.table({"group": anchor * positives + place, "anchor_id": pa.array([block.ids[a] for a in anchor.tolist()], pa.int64()),
                      "positive_id": found.column("id"), "positive_score": found.column("score")})
    pairs = spark.createDataFrame(known)
    first, sent = _search(chunks, block, lows, highs, negatives, False, d, kind)
    out = first.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(pairs, "group")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), sent
