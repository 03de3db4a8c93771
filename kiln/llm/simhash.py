"""SimHash near-duplicates compared bit-sliced (operator 6).

Fingerprints: for each bit, whether it is set in over half of the XXH64 hashes (seed 42) of the
text's word shingles, repeats included.

Links: two fingerprints within ``radius`` bits agree on two or more of ``radius + 2`` blocks, so
each distinct fingerprint goes to the bucket of every pair of blocks. A bucket of more than
``LARGE_BUCKET`` is dealt again by pairs of blocks of its remaining bits, which leaves so few
free bits that a bucket is bounded by construction (2**16 fingerprints for radius 2); no link is
lost and no pair of rows is formed. Inside a bucket the fingerprints stand as bit planes, 64 to
a machine word; a probe updates all distances with carry-save counters plane by plane, and is
abandoned once every lane has exceeded the radius. A bucket hands on one link per fingerprint,
to its component's first member, not all pairs.

Components of the links come from large-star / small-star rounds; each row joins back by its
fingerprint, so thousands of copies count as one fingerprint until then.

Defined results: NULL or empty text has fingerprint zero and links like any other; rows with a
NULL doc_id belong to their component, whose id is the smallest doc_id that is not NULL (NULL if
there is none); repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.graph import components
from kiln.llm.shared import bounded_batches, fresh, stored

LARGE_BUCKET = 4096
SHINGLES_AT_ONCE = 50_000
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()
    n = max(len(words) - shingle + 1, 1 if words else 0)
    if not n:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = words[at: at + SHINGLES_AT_ONCE + shingle - 1]
        if len(part) > shingle:
            grams = map(b" ".join, zip(*(part[k:] for k in range(shingle))))
        else:
            grams = iter([b" ".join(part)])
        counts += _set_bits(np.fromiter((xxh64_intdigest(g, seed) for g in grams), dtype=np.uint64))
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, with_digest: bool = False) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row, on request the digest of its text."""
    bounded_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])

    also = [_digest(text_col).alias("digest")] if with_digest else []
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *also).mapInArrow(
        run, "doc_id long, fp long" + (", digest string" if with_digest else ""))


def _digest(text_col: str) -> Column:
    """SHA-256 of a text; NULL text comes before any other."""
    return F.coalesce(F.sha2(F.col(f"`{text_col}`"), 256), F.lit(""))


# ---------------------------------------------------------------------- bit-sliced comparison
def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 bit planes; bit i of a plane's words is that bit of fingerprint i."""
    n = len(fps)
    bits = np.zeros((-(-n // 64) * 64, 64), dtype=np.uint8)
    bits[:n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")


def within(planes: np.ndarray, probes: np.ndarray, radius: int, check_every: int = 8) -> np.ndarray:
    """For each probe, a word mask of the lanes at most ``radius`` bits away.

    ``digits`` are the vertical counters: digit d of all lanes in one array, increased by a
    carry-save ripple; ``over`` marks lanes past the radius. Probes whose lanes are all over
    leave the work.
    """
    n_digits = max(radius + 1, 1).bit_length()
    alive = np.arange(len(probes))
    out = np.zeros((len(probes), planes.shape[1]), dtype=np.uint64)
    digits = [np.zeros_like(out) for _ in range(n_digits)]
    over = np.zeros_like(out)
    for bit in range(64):
        flip = np.where((probes[alive] >> np.uint64(bit)) & np.uint64(1), ONES, np.uint64(0))
        carry = planes[bit][None, :] ^ flip[:, None]
        for d in range(n_digits):
            digits[d], carry = digits[d] ^ carry, digits[d] & carry
        over |= carry
        past = np.full_like(over, ONES)
        for d in range(n_digits):
            past &= digits[d] if (radius + 1) >> d & 1 else ~digits[d]
        over |= past
        if bit % check_every == check_every - 1 or bit == 63:
            stay = (over != ONES).any(axis=1)
            if not stay.all():
                alive, over, digits = alive[stay], over[stay], [x[stay] for x in digits]
            if not len(alive):
                return out
    out[alive] = ~over
    return out


def _lanes(mask: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(mask).astype("<u8").view(np.uint8), axis=-1, bitorder="little", count=None)[..., :n].astype(bool)


def _one_bucket(fps: np.ndarray, radius: int, at_once: int = 256) -> np.ndarray:
    """For each fingerprint of a bucket, the index of its component's first member."""
    n = len(fps)
    planes, root = planes_of(fps), np.full(n, -1)
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first] = first
        front = np.array([first])
        while len(front):
            found = np.zeros(n, dtype=bool)
            for k in range(0, len(front), at_once):
                near = np.bitwise_or.reduce(within(planes, fps[front[k: k + at_once]], radius), axis=0)
                found |= _lanes(near, n)
            front = np.flatnonzero(found & (root < 0))
            root[front] = first
    return root


def _small_buckets(key: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """The same for several small buckets laid side by side in one set of planes."""
    n = len(fps)
    near = _lanes(within(planes_of(fps), fps, radius), n) & (key[:, None] == key[None, :])
    root = np.arange(n)
    while True:
        new = np.where(near, root[None, :], n).min(axis=1)
        if (new == root).all():
            return root
        root = new


def _links(batches: Iterator[pa.RecordBatch], radius: int, side_by_side: int = 512) -> Iterator[pa.RecordBatch]:
    """Links of the buckets of a partition, whose rows come in order of their key."""
    def solved(key, fps):
        if not len(key):
            return
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        i = 0
        while i < len(cut) - 1:
            j = max(i + 1, int(np.searchsorted(cut, cut[i] + side_by_side, side="right")) - 1)
            lo, hi = cut[i], cut[j]
            k, f = key[lo:hi], fps[lo:hi]
            root = _small_buckets(k, f, radius) if j > i + 1 or hi - lo <= side_by_side else _one_bucket(f, radius)
            own = np.flatnonzero(root != np.arange(len(f)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(f[own].view(np.int64)), pa.array(f[root[own]].view(np.int64))], names=["a", "b"])
            i = j

    keys, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for b in batches:
        keys = np.concatenate([keys, b.column(0).to_numpy(zero_copy_only=False)])
        held = np.concatenate([held, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        last = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last bucket may go on
        yield from solved(keys[:last], held[:last])
        keys, held = keys[last:], held[last:]
    yield from solved(keys, held)


def _blocks(positions: list[int], n_blocks: int) -> list[list[int]]:
    cut = [round(k * len(positions) / n_blocks) for k in range(n_blocks + 1)]
    return [positions[i:j] for i, j in zip(cut[:-1], cut[1:])]


def _mask(positions: list[int]) -> int:
    m = sum(1 << p for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _plans(radius: int) -> list[tuple[int, list[int]]]:
    """For each pair of blocks: the mask of its bits, and the masks of the finer buckets."""
    out = []
    for pair in combinations(_blocks(list(range(64)), radius + 2), 2):
        own = sorted(sum(pair, []))
        rest = [p for p in range(64) if p not in own]
        out.append((_mask(own), [_mask(own + sum(finer, [])) for finer in combinations(_blocks(rest, radius + 2), 2)]))
    return out


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that join distinct fingerprints (column ``fp``) into their components."""
    plans = _plans(radius)
    # A bucket's key is a hash of the masked bits; buckets that fall together compare a little more.
    first = fps.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m, _ in plans])).alias("sub", "mask")).select(
        F.xxhash64("sub", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "sub", "fp")
    size = first.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(first.join(size, "key"), "simhash-buckets")
    finer = F.array(*[F.array(*[F.lit(m).cast("long") for m in f]) for _, f in plans])
    large = shared.where(F.col("n") > LARGE_BUCKET)
    fine = large.select("sub", "fp", F.posexplode(F.get(finer, F.col("sub"))).alias("subsub", "mask")).select(
        F.xxhash64("sub", "subsub", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")
    buckets = shared.where(F.col("n") <= LARGE_BUCKET).select("key", "fp").union(fine)
    return (buckets.repartition("key").sortWithinPartitions("key", "fp")
            .mapInArrow(lambda it: _links(it, radius), "a long, b long"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id and n_copies (rows that share
    its fingerprint)."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    distinct = stored(distinct, "distinct-fingerprints")
    tree = components(links(distinct.select("fp"), radius), "a", "b")
    rooted = distinct.join(tree, distinct.fp == tree.node, "left").select("fp", "least", "n_copies", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(whole, "root").select("fp", "component_id", "n_copies"), "components")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component: that of its least doc_id (NULL ids come last), of texts that share
    it the first by digest. Components whose least doc_id is the same stay apart."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest"))
    distinct = fingerprints(docs, id_col, text_col, shingle, with_digest=True).groupBy("fp").agg(first.alias("first"))
    distinct = stored(distinct, "distinct-fingerprints")
    tree = components(links(distinct.select("fp"), radius), "a", "b")
    rooted = distinct.join(tree, distinct.fp == tree.node, "left").select("first", F.coalesce("root", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first"))  # one text has one root: no pair comes twice
    key, text, digest, place = (fresh(docs, c) for c in ("kept_id", "kept_text", "digest", "place"))
    kept = kept.select(F.col("first.doc_id").alias(key), F.col("first.digest").alias(text))
    marked = docs.withColumn(digest, _digest(text_col))
    named = marked.join(kept, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(key)) & (F.col(digest) == F.col(text)), "inner")
    same = Window.partitionBy(key, text).orderBy(digest)  # rows repeated whole
    return named.withColumn(place, F.row_number().over(same)).where(F.col(place) == 1).drop(key, text, digest, place)
