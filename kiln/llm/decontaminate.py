"""Benchmark decontamination by size-partitioned MinHash containment search (operator 10).

Texts are compared as word shingles of five (lower case, ASCII punctuation apart; an item of
fewer words is one shingle of all its words). An item is found in a document when at least
``threshold`` of its distinct shingles stand in the document.

A short item inside a long document has next to no resemblance to the whole of it, so sizes are
partitioned on both sides: items fall into classes by powers of two of their length, and for the
class of up to ``u`` shingles a document is cut in passages of ``2u`` shingles, ``u`` apart, so
that an item of the class lies inside one passage. Passages and items get one-permutation
MinHash signatures of ``bins_per * u`` bins (the least hash of each bin); an item and a document
become candidates when one of its passages shares a bin's least hash. With far more bins than
shingles nearly every common shingle is the least of its bin, so the chance to miss an item of
``q`` contained shingles is about ``(2 / bins_per) ** (0.8 q)``; items with fewer than
``EXACT_BELOW`` shingles, where that is not small, get a bin for every hash value, which misses
none. Candidates are verified by exact shingle containment on the words themselves.

The items are the stated query set: they go to the executors in blocks of at most
``block_items`` items and ``block_bytes`` bytes of text, one pass over the documents for each
block. A document's work and memory depend on its own length.

Defined results: NULL or empty items and documents match nothing; equal items are found alike;
a repeated document id keeps a row per document row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.shared import bounded_batches, fresh
from kiln.llm.text import MARKS, U64, Batch, mix

EXACT_BELOW = 12
ALL_BINS = 1 << 62


def words(text: str | None) -> list[bytes]:
    b = Batch([(text or "").encode("utf-8")], lower=True, ends=MARKS)
    data = b.raw.tobytes()
    return [data[i:j] for i, j in zip(b.start.tolist(), b.end.tolist())]


def shingles_of(w: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(w[i:] for i in range(k))))


class Index:
    """The items of one block, by shingle length and size class."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, bins_per: int):
        self.items, self.classes = [], {}
        groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            w = words(text)
            k = min(shingle, len(w))
            if not k:
                continue
            here = len(self.items)
            own = shingles_of(w, k)
            self.items.append((item_id, k, own))
            h = np.unique(Batch([b" ".join(w)]).windows(k))
            size = len(w) - k + 1
            groups.setdefault((k, 0 if len(own) < EXACT_BELOW else size.bit_length()), []).append((here, h))
        for (k, c), found in groups.items():
            reach = max(1 << c, 1) if c else 2 * EXACT_BELOW
            bins = bins_per * reach if c else ALL_BINS
            value, owner = [], []
            for here, h in found:
                least = h[np.unique(bin_of(h, bins), return_index=True)[1]] if c else h
                value.append(least)
                owner.append(np.full(len(least), here))
            value, owner = np.concatenate(value), np.concatenate(owner)
            order = np.argsort(value, kind="stable")
            self.classes[k, c] = (reach, bins, value[order], owner[order])


def bin_of(h: np.ndarray, bins: int) -> np.ndarray:
    """The bin of a hash, by other bits than those its order within the bin depends on."""
    return h if bins == ALL_BINS else (mix(h) % U64(bins)).astype(np.int64)


def candidates(index: Index, hashes: dict[int, tuple[np.ndarray, np.ndarray]], first: np.ndarray) -> set[tuple[int, int]]:
    """(document of the batch, item) pairs that share the least hash of a bin in some passage."""
    out: set[tuple[int, int]] = set()
    for (k, c), (reach, bins, value, owner) in index.classes.items():
        h, fits = hashes[k]
        table = np.zeros(1 << 20, dtype=bool)
        table[(value & U64((1 << 20) - 1)).astype(np.int64)] = True
        at = np.flatnonzero(table[(h & U64((1 << 20) - 1)).astype(np.int64)] & fits)
        lo = np.searchsorted(value, h[at])
        at = at[(lo < len(value)) & (value[np.minimum(lo, len(value) - 1)] == h[at])]
        if not len(at):
            continue
        doc = np.searchsorted(first, at, side="right") - 1
        if bins != ALL_BINS:
            # Among shared hashes keep those that are the least of their bin in a passage around them.
            keep = np.zeros(len(at), dtype=bool)
            place = at - first[doc]
            passages = np.unique(np.stack([np.concatenate([doc, doc]), np.maximum(np.concatenate([place // reach, place // reach - 1]), 0)]), axis=1)
            for d, p in passages.T.tolist():
                i, j = first[d] + p * reach, min(first[d] + (p + 2) * reach, first[d + 1])
                own = h[i:j][fits[i:j]]
                b = bin_of(own, bins)
                order = np.lexsort((own, b))
                least = own[order][np.flatnonzero(np.diff(b[order], prepend=-1))]
                mine = np.flatnonzero((at >= i) & (at < j)) if len(at) < 64 else np.arange(np.searchsorted(at, i), np.searchsorted(at, j))
                keep[mine] |= np.isin(h[at[mine]], least)
            at, doc = at[keep], doc[keep]
        lo, hi = np.searchsorted(value, h[at]), np.searchsorted(value, h[at], side="right")
        for d, i, j in zip(doc.tolist(), lo.tolist(), hi.tolist()):
            out.update((d, int(x)) for x in owner[i:j])
    return out


def _search(batches: Iterator[pa.RecordBatch], items, shingle: int, bins_per: int, threshold: float, text_at: int,
            out_col: str) -> Iterator[pa.RecordBatch]:
    index = Index(items, shingle, bins_per)
    lengths = {k for k, _ in index.classes}
    found_type = pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64()), ("n_shingles", pa.int64())]))
    for batch in batches:
        for s in range(0, batch.num_rows, 200):
            part = batch.slice(s, 200)
            b = Batch([(t or "").encode("utf-8") for t in part.column(text_at).to_pylist()], lower=True, ends=MARKS)
            ids = b.ids()
            hashes = {k: _padded(b.windows(k, ids=ids), b.fits(k), len(ids)) for k in lengths}
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            now, own_words, own = -1, [], {}
            for d, i in sorted(candidates(index, hashes, b.first)):
                item_id, k, wanted = index.items[i]
                if now != d:
                    lo, hi = b.first[d], b.first[d + 1]
                    raw, at = b.raw[b.start[lo]:b.end[hi - 1]].tobytes(), b.start[lo]
                    now, own_words, own = d, [raw[x:y] for x, y in zip((b.start[lo:hi] - at).tolist(), (b.end[lo:hi] - at).tolist())], {}
                if k not in own:
                    own[k] = shingles_of(own_words, k)
                share = len(wanted & own[k]) / len(wanted)
                if share >= threshold:
                    found[d].append({"item_id": item_id, "containment": share, "n_shingles": len(wanted)})
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, found_type)], names=[*part.schema.names, out_col])


def _padded(h: np.ndarray, fits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([h, np.zeros(n - len(h), U64)]), np.concatenate([fits, np.zeros(n - len(fits), bool)])


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_items: int, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks; the driver holds one block (and one partition of items) at a time."""
    block, size = [], 0
    for r in items.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).where(F.col(f"`{text_col}`").isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if len(block) >= block_items or size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def mark_items(docs: DataFrame, items: DataFrame, text_col: str = "text", out_col: str = "found", item_id_col: str = "item_id",
               item_text_col: str = "text", threshold: float = 0.8, shingle: int = 5, bins_per: int = 32,
               block_items: int = 20_000, block_bytes: int = 16 << 20, keep_text: bool = True) -> DataFrame:
    """``docs`` with the items found in each row, array<struct(item_id, containment, n_shingles)>;
    a column of that name is replaced. Nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(out_col)
    kind = "array<struct<item_id:bigint,containment:double,n_shingles:bigint>>"
    marked, passes = docs, []
    for n, block in enumerate(item_blocks(items, item_id_col, item_text_col, block_items, block_bytes)):
        name = fresh(marked, f"{out_col}_{n}")
        shared = docs.sparkSession.sparkContext.broadcast(block)
        schema = marked.select("*", F.lit(None).cast(kind).alias(name)).schema
        marked = marked.mapInArrow(lambda it, shared=shared, name=name, at=marked.columns.index(text_col): _search(
            it, shared.value, shingle, bins_per, threshold, at, name), schema)
        passes.append(name)
    found = F.concat(*passes) if passes else F.array().cast(kind)
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns if keep_text or c != text_col], found.alias(out_col))


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per document row and item found in it: doc_id, item_id, containment, n_shingles."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return mark_items(rows, items, keep_text=False, **settings).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
