"""Substring dedup by fixed-block anchors (operator 1).

A passage of ``window`` words that occurs twice holds, in its earlier place, a whole aligned
block of ``window // 2`` words (blocks start at every multiple of that width). So:

1. Texts are packed in chunks of a few MB and stored once, bucketed by chunk; the later steps
   read that table and move hashes only, never texts.
2. Each chunk hands in its rolling block-wide window hashes, each once, marked where they are
   aligned blocks or repeat inside the chunk. Hash buckets of bounded size find the hashes that
   are a block somewhere and occur at least twice. A passage shared by a third of the corpus
   counts once per chunk here, so no bucket is hot.
3. Each chunk extends every hit to the ``window``-word windows around it and hands in their
   96-bit hashes with the smallest doc_id; the buckets answer with those that start in a
   smaller doc_id elsewhere.
4. Each chunk marks its repeated windows, whose runs are the maximal exact repeats, and drops
   the words under them.

No pair of documents is ever formed: work and traffic are linear in the words.

Buckets and chunks both grow with the data, so a chunk must not hand a row to every bucket. Up to
``FAN`` buckets it does; beyond, hashes are dealt twice. A chunk hands rows to about sqrt(buckets)
ranges of hashes; as many chunks form a group, whose sections of one range are merged and cut into
the buckets of that range; the answers go back the same way. A chunk hands over, and a group passes
on for each of its chunks, about sqrt(buckets) rows: 2400 of them at 100 TB, where one level would
take 5.5 million.

Defined results: NULL or empty text has no words; a text of fewer than ``window`` words keeps
all; a NULL doc_id ranks before all others; rows that share a doc_id are separate documents
of which neither is earlier. Words are compared as bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm import text as tx
from kiln.llm.shared import bounded_batches, buckets_for, partitions, scratch, stored

CHUNK_BYTES = 4 << 20
#: Windows in one hash bucket, on average; a bucket is one task's group.
BUCKET_WINDOWS = 3_000_000
#: Rows a chunk may hand over, one a bucket; with more buckets hashes are dealt in two levels.
FAN = 256
#: Bits of the block hash that travel; a false hit only costs an extra candidate.
ANCHOR_BITS = 48
NO_ID = -(1 << 63)


def _pack(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 33
    ids, texts, size, words, seq = [], [], 0, 0, 0

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array([part + seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
             pa.array([texts], pa.list_(pa.binary())), pa.array([words], pa.int64())],
            names=["chunk", "ids", "texts", "n_words"])

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = t.encode("utf-8") if t else b""
            ids.append(i)
            texts.append(data)
            size += len(data)
            words += len(data) // 2 + 1  # no text has more words than this
            if size >= chunk_bytes or len(ids) >= 100_000:
                yield flush()
                ids, texts, size, words, seq = [], [], 0, 0, seq + 1
    if ids:
        yield flush()


def _cuts(values: np.ndarray, n_buckets: int, bits: int, parts: int = 1, part: int = 0) -> np.ndarray:
    """Where the buckets begin and end in an ascending list of hashes; with ``parts``, the buckets of
    one range of ``parts`` that the hashes lie in, each range holding ``n_buckets``."""
    total, first = n_buckets * parts, n_buckets * part
    limits = np.array([(first + k) * (1 << bits) // total for k in range(1, n_buckets)], dtype=tx.U64)
    return np.concatenate([[0], np.searchsorted(values, limits), [len(values)]])


def _marked(answers, cut: np.ndarray) -> np.ndarray:
    """The buckets' answers to one chunk, a bit for each hash it handed in."""
    out = np.zeros(cut[-1], dtype=bool)
    for a in answers or ():
        i, j = cut[a["bucket"]], cut[a["bucket"] + 1]
        out[i:j] = np.unpackbits(np.frombuffer(a["mask"], np.uint8), count=j - i)
    return out


class _Anchors:
    """The distinct block-wide hashes of a chunk, ascending."""

    def __init__(self, b: tx.Batch, word: np.ndarray, width: int):
        self.all = b.windows(width, ids=word) >> tx.U64(64 - ANCHOR_BITS)
        self.ok = b.fits(width)
        at = np.flatnonzero(self.ok)
        self.order = at[np.argsort(self.all[at])]
        h = self.all[self.order]
        self.new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        self.value = h[self.new]

    def where(self, marked: np.ndarray) -> np.ndarray:
        """Marks the windows of the chunk whose hash is marked."""
        out = np.zeros(len(self.all), dtype=bool)
        out[self.order] = np.repeat(marked, np.diff(self.new, append=len(self.order)))
        return out


def _anchors(batches, width: int, n_buckets: int):
    """Per chunk and bucket: its distinct block-wide hashes, with two marks each."""
    for batch in batches:
        for chunk, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            b = tx.Batch(texts)
            a = _Anchors(b, b.ids(), width)
            aligned = (a.order - np.repeat(b.first[:-1], b.n_words)[a.order]) % width == 0
            block = np.logical_or.reduceat(aligned, a.new) if len(a.new) else aligned
            many = np.diff(a.new, append=len(a.order)) > 1
            cut = _cuts(a.value, n_buckets, ANCHOR_BITS)
            rows = [(k, chunk, tx.pack_sorted(a.value[i:j]), np.packbits(block[i:j]).tobytes(), np.packbits(many[i:j]).tobytes())
                    for k, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["bucket", "chunk", "hashes", "block", "many"])


def _answer(pdf, mark: np.ndarray, sizes: list[int]):
    """For each chunk of a bucket that has marks, its bit mask."""
    import pandas as pd

    out, at = [], 0
    for chunk, n in zip(pdf["chunk"], sizes):
        mine = mark[at: at + n]
        at += n
        if mine.any():
            out.append((chunk, int(pdf["bucket"].iloc[0]), np.packbits(mine).tobytes()))
    return pd.DataFrame(out, columns=["chunk", "bucket", "mask"])


def _shared_anchors(pdf):
    """One bucket: marks the hashes that are a block somewhere and occur twice."""
    parts = [tx.unpack_sorted(x) for x in pdf["hashes"]]
    n = [len(p) for p in parts]
    h = np.concatenate(parts)
    block = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(pdf["block"], n)])
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(pdf["many"], n)])
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    count = np.diff(new, append=len(s))
    hit = (np.maximum.reduceat(block[order], new) > 0) & ((count > 1) | (np.maximum.reduceat(many[order], new) > 0))
    mark = np.zeros(len(h), dtype=bool)
    mark[order] = np.repeat(hit, count)
    return _answer(pdf, mark, n)


class _Candidates:
    """The windows of a chunk that hold a hit, with their hashes, in order of hash and doc_id."""

    def __init__(self, ids, texts, hits, width: int, window: int, n_buckets: int):
        self.batch = b = tx.Batch(texts)
        word = b.ids()
        anchors = _Anchors(b, word, width)
        hit = anchors.where(_marked(hits, _cuts(anchors.value, n_buckets, ANCHOR_BITS)))
        seen = np.concatenate([[0], np.cumsum(hit)])
        at = np.flatnonzero(b.fits(window))
        at = at[seen[at + window - width + 1] > seen[at]]
        if len(at):
            long = b.windows(window, ids=word)[at]
            other = b.windows(window, lane=1)[at] >> tx.U64(32)
        else:
            long = other = np.zeros(0, tx.U64)
        doc = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
        row = b.owner()[at]
        order = np.lexsort((at, row, doc[row], other, long))
        self.at, self.hash, self.other, self.row = at[order], long[order], other[order], row[order]
        self.doc = doc[self.row]
        self.same = np.zeros(len(order), dtype=bool)
        self.same[1:] = (self.hash[1:] == self.hash[:-1]) & (self.other[1:] == self.other[:-1])
        self.new = np.flatnonzero(~self.same)
        self.cut = _cuts(self.hash[self.new], n_buckets, 64)


def _windows(batches, width: int, window: int, n_buckets: int):
    """Per chunk and bucket: the distinct candidate windows with their smallest doc_id."""
    names = ["bucket", "chunk", "hashes", "other", "base", "docs"]
    for batch in batches:
        for chunk, ids, texts, hits in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if not hits:
                continue
            c = _Candidates(ids, texts, hits, width, window, n_buckets)
            h, o, d = c.hash[c.new], c.other[c.new].astype("<u4"), c.doc[c.new]
            rows = []
            for k, (i, j) in enumerate(zip(c.cut[:-1], c.cut[1:])):
                if j > i:
                    base = int(d[i:j].min())
                    rows.append((k, chunk, tx.pack_sorted(h[i:j]), o[i:j].tobytes(), base, tx.pack_planes((d[i:j] - base).astype("<u8"))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def _earlier(pdf):
    """One bucket: marks, for each chunk, its windows that start in a smaller doc_id elsewhere."""
    parts = [tx.unpack_sorted(x) for x in pdf["hashes"]]
    n = [len(p) for p in parts]
    h, o = np.concatenate(parts), np.concatenate([np.frombuffer(x, "<u4") for x in pdf["other"]])
    d = np.concatenate([tx.unpack_planes(x, k).astype(np.int64) + b for x, b, k in zip(pdf["docs"], pdf["base"], n)])
    order = np.lexsort((o, h))
    sh, so = h[order], o[order]
    new = np.flatnonzero(np.concatenate([[True], (sh[1:] != sh[:-1]) | (so[1:] != so[:-1])]))
    least = np.minimum.reduceat(d[order], new)
    late = np.zeros(len(h), dtype=bool)
    late[order] = d[order] > np.repeat(least, np.diff(new, append=len(h)))
    return _answer(pdf, late, n)


class _Merged:
    """The sections that a group's chunks handed to one range, as one list without repeats."""

    def __init__(self, pdf, fine: int, ranges: int, bits: int, keys: list[np.ndarray]):
        self.n = [int.from_bytes(x[:8], "little") for x in pdf["hashes"]]  # as pack_sorted wrote them
        self.order = np.lexsort(keys[::-1])
        self.size = len(keys[0])
        new = np.zeros(self.size, dtype=bool)
        new[:1] = True
        for k in keys:
            s = k[self.order]
            new[1:] |= s[1:] != s[:-1]
        self.new = np.flatnonzero(new)
        self.count = np.diff(self.new, append=self.size)
        self.value = keys[0][self.order][self.new]
        self.cut = _cuts(self.value, fine, bits, ranges, int(pdf["bucket"].iloc[0]))

    def rows(self, pdf, fine: int):
        """The buckets that have hashes, as (bucket, from, to)."""
        first = int(pdf["bucket"].iloc[0]) * fine
        return [(first + k, i, j) for k, (i, j) in enumerate(zip(self.cut[:-1], self.cut[1:])) if j > i]

    def marked(self, answers) -> np.ndarray:
        """The buckets' answers, a bit for each hash of the merged list."""
        out = np.zeros(len(self.value), dtype=bool)
        for k, mask in zip(answers["fine"], answers["mask"]):
            i, j = self.cut[k], self.cut[k + 1]
            out[i:j] = np.unpackbits(np.frombuffer(mask, np.uint8), count=j - i)
        return out

    def spread(self, per_value: np.ndarray) -> np.ndarray:
        """A value of each merged hash, handed to the rows it stands for."""
        out = np.empty(self.size, dtype=per_value.dtype)
        out[self.order] = np.repeat(per_value, self.count)
        return out


def _bits(column, n: list[int]) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(column, n)])


def _merge_anchors(pdf, fine: int, ranges: int) -> _Merged:
    return _Merged(pdf, fine, ranges, ANCHOR_BITS, [np.concatenate([tx.unpack_sorted(x) for x in pdf["hashes"]])])


def _gather_anchors(pdf, fine: int, ranges: int):
    """The sections of a group as rows for the buckets: the marks of a hash are joined, and a hash
    of two chunks is one that repeats."""
    import pandas as pd

    m = _merge_anchors(pdf, fine, ranges)
    block = np.maximum.reduceat(_bits(pdf["block"], m.n)[m.order], m.new)
    many = np.maximum.reduceat(_bits(pdf["many"], m.n)[m.order], m.new) | (m.count > 1)
    return pd.DataFrame([(k, int(pdf["grp"].iloc[0]), tx.pack_sorted(m.value[i:j]), np.packbits(block[i:j]).tobytes(),
                          np.packbits(many[i:j]).tobytes()) for k, i, j in m.rows(pdf, fine)],
                        columns=["bucket", "chunk", "hashes", "block", "many"])


def _spread_anchors(pdf, answers, fine: int, ranges: int):
    """The buckets' answers to a group, as answers to its chunks."""
    if not len(answers) or not len(pdf):
        return _no_answer()
    m = _merge_anchors(pdf, fine, ranges)
    return _answer(pdf, m.spread(m.marked(answers)), m.n)


def _merge_windows(pdf, fine: int, ranges: int) -> tuple[_Merged, np.ndarray]:
    """The merged windows, and the doc_id of every row of the sections."""
    h = np.concatenate([tx.unpack_sorted(x) for x in pdf["hashes"]])
    o = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["other"]])
    m = _Merged(pdf, fine, ranges, 64, [h, o])
    return m, np.concatenate([tx.unpack_planes(x, k).astype(np.int64) + b for x, b, k in zip(pdf["docs"], pdf["base"], m.n)])


def _gather_windows(pdf, fine: int, ranges: int):
    """The sections of a group as rows for the buckets, with the group's smallest doc_ids."""
    import pandas as pd

    m, doc = _merge_windows(pdf, fine, ranges)
    o = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["other"]])[m.order][m.new].astype("<u4")
    d = np.minimum.reduceat(doc[m.order], m.new)
    rows = []
    for k, i, j in m.rows(pdf, fine):
        base = int(d[i:j].min())
        rows.append((k, int(pdf["grp"].iloc[0]), tx.pack_sorted(m.value[i:j]), o[i:j].tobytes(), base,
                     tx.pack_planes((d[i:j] - base).astype("<u8"))))
    return pd.DataFrame(rows, columns=["bucket", "chunk", "hashes", "other", "base", "docs"])


def _spread_windows(pdf, answers, fine: int, ranges: int):
    """A window of a chunk is late if the group's is, or if another chunk of the group has it earlier."""
    if not len(pdf):
        return _no_answer()
    m, doc = _merge_windows(pdf, fine, ranges)
    late = doc > m.spread(np.minimum.reduceat(doc[m.order], m.new))
    if len(answers):
        late |= m.spread(m.marked(answers))
    return _answer(pdf, late, m.n)


def _no_answer():
    import pandas as pd

    return pd.DataFrame({"chunk": np.zeros(0, np.int64), "bucket": np.zeros(0, np.int64), "mask": np.zeros(0, object)})


_ANSWER = "chunk long, bucket long, mask binary"


def _answered(rows: DataFrame, judge, gather, spread, ranges: int, fine: int, groups: int) -> DataFrame:
    """(chunk, bucket, mask): the answers of the buckets to the rows (bucket, chunk, ..) that chunks
    handed to ``ranges`` ranges of hashes; with ``fine`` > 1 each range is that many buckets."""
    if fine == 1:
        return rows.groupBy("bucket").applyInPandas(judge, _ANSWER)
    grouped = rows.withColumn("grp", F.pmod(F.xxhash64("chunk"), F.lit(groups)))
    merged = grouped.groupBy("bucket", "grp").applyInPandas(lambda pdf: gather(pdf, fine, ranges), rows.schema)
    answers = merged.groupBy("bucket").applyInPandas(judge, _ANSWER).select(
        F.expr(f"bucket div {fine}").alias("bucket"), F.col("chunk").alias("grp"), F.expr(f"bucket % {fine}").alias("fine"), "mask")
    return grouped.groupBy("bucket", "grp").cogroup(answers.groupBy("bucket", "grp")).applyInPandas(
        lambda pdf, a: spread(pdf, a, fine, ranges), _ANSWER)


def _removed(batches, width: int, window: int, n_buckets: int, with_text: bool):
    """Per document: the maximal repeats that go, and what is kept."""
    for batch in batches:
        for ids, texts, hits, late in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
            c = _Candidates(ids, texts, hits, width, window, n_buckets)
            b = c.batch
            group = np.cumsum(~c.same) - 1
            repeated = c.doc > c.doc[c.new][group]
            repeated[1:] |= c.same[1:] & (c.row[1:] == c.row[:-1])
            repeated |= _marked(late, c.cut)[group]
            edge = np.zeros(len(b.start) + 1, dtype=np.int64)
            np.add.at(edge, c.at[repeated], 1)
            np.add.at(edge, c.at[repeated] + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            rows = []
            for i, doc in enumerate(ids):
                lo, hi = int(b.first[i]), int(b.first[i + 1])
                g = gone[lo:hi]
                if g.any():
                    step = np.flatnonzero(np.diff(np.concatenate([[0], g, [0]])))
                    spans = [{"start": int(x), "end": int(y)} for x, y in zip(step[0::2], step[1::2])]
                    kept = b" ".join(b.data[x:y] for x, y in zip(b.start[lo:hi][~g].tolist(), b.end[lo:hi][~g].tolist()))
                else:
                    spans, kept = [], b" ".join(texts[i].split())
                rows.append((doc, hi - lo, int(g.sum()), hashlib.sha256(kept).hexdigest(), spans, kept.decode("utf-8") if with_text else None))
            for k in range(0, len(rows), 4000):
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows[k: k + 4000]), _OUT.values())], names=list(_OUT))


_OUT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(),
        "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept_text": pa.string()}


def _levels(buckets: int, chunks: int, fan: int) -> tuple[int, int, int]:
    """(ranges a chunk deals to, buckets a range is cut into, groups of chunks)."""
    if buckets <= fan:
        return buckets, 1, 1
    ranges = math.ceil(math.sqrt(buckets))
    return ranges, math.ceil(buckets / ranges), max(1, chunks // ranges)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                    with_text: bool = True, chunk_bytes: int = CHUNK_BYTES,
                    bucket_windows: int = BUCKET_WINDOWS, fan: int = FAN) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, spans (word ranges, end
    exclusive, one per maximal repeat) and kept_text (NULL unless ``with_text``). ``chunk_bytes``,
    ``bucket_windows`` and ``fan`` size the work and leave the result as it is."""
    if window < 2:
        raise ValueError("window must be 2 words or more")
    spark, width = docs.sparkSession, window // 2
    bounded_batches(spark)
    width = width if 2 * width - 1 <= window else 1
    n = partitions(spark)
    table = scratch(spark, "substring").rsplit("/", 1)[-1].replace("-", "_")
    (docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
         .mapInArrow(lambda it: _pack(it, chunk_bytes), "chunk long, ids array<long>, texts array<binary>, n_words long")
         .write.format("parquet").option("compression", "zstd").option("path", scratch(spark, "substring-chunks"))
         .bucketBy(n, "chunk").saveAsTable(table))
    chunks = spark.table(table)
    size = chunks.agg(F.sum("n_words"), F.count(F.lit(1))).first()
    k, fine, groups = _levels(buckets_for((size[0] or 0) // 3, bucket_windows, n), size[1], fan)

    anchors = chunks.select("chunk", "texts").mapInArrow(
        lambda it: _anchors(it, width, k), "bucket long, chunk long, hashes binary, block binary, many binary")
    shared = (_answered(anchors, _shared_anchors, _gather_anchors, _spread_anchors, k, fine, groups)
              .groupBy("chunk").agg(F.collect_list(F.struct("bucket", "mask")).alias("hits")))
    shared = stored(shared, "substring-hits")

    def with_hits(cols: list[Column | str]) -> DataFrame:
        return chunks.join(shared.hint("shuffle_hash"), "chunk", "left").select(*cols)

    windows = with_hits(["chunk", "ids", "texts", "hits"]).mapInArrow(
        lambda it: _windows(it, width, window, k),
        "bucket long, chunk long, hashes binary, other binary, base long, docs binary")
    late = (_answered(windows, _earlier, _gather_windows, _spread_windows, k, fine, groups)
            .groupBy("chunk").agg(F.collect_list(F.struct("bucket", "mask")).alias("late")))
    return (with_hits(["chunk", "ids", "texts", "hits"]).join(late.hint("shuffle_hash"), "chunk", "left")
            .select("chunk", "ids", "texts", "hits", "late")
            .mapInArrow(lambda it: _removed(it, width, window, k, with_text),
                        "doc_id long, n_words long, n_removed long, kept_sha256 string, "
                        "spans array<struct<start:long,end:long>>, kept_text string"))
