"""Document fingerprints: a Merkle tree over sections and paragraphs (operator 3, native).

A text is split at blank lines (two line feeds) into sections, those at line feeds into
paragraphs, those into leaves of at most 12 words (a word longer than 64 characters counts as
several). Nothing is dropped, so leaf digests determine the text. A paragraph's digest is the
SHA-256 of its leaves' digests, a section's of its paragraphs', the root's of its sections'; the
root in hexadecimal is the fingerprint. Equal roots mean equal texts; where roots differ, only
the branches that differ need a look.

``likeness`` is the share of tree nodes in common (twice the common distinct nodes over the sum
of both trees' distinct nodes), 1 exactly for equal roots. Leaves count from the start of their
paragraph, so an edit changes its paragraph's leaves from there on and the nodes above.

Everything is built from DataFrame functions. Defined results: NULL text is empty text, which
has one empty paragraph; rows that share an id follow one another in order of their text; a NULL
id ranks first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.shared import partitions

LEAF = r"(?:\S{1,64}\s{0,64}|\s{1,64}){1,12}"
OUTER_BINS = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _node(kind: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), F.array_join(children, "")), 256)


def tree(text: Column) -> Column:
    """struct(root string, sections array<struct(digest, paragraphs array<struct(digest, leaves
    array<long>)>)>); leaves are given by 64 bits of their digest."""
    def paragraph(p):
        leaves = F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256))
        return _let(leaves, lambda d: F.struct(_node("p", d).alias("digest"), F.transform(d, lambda x: F.xxhash64(x)).alias("leaves")))

    def section(s):
        return _let(F.transform(F.split(s, "\n"), paragraph), lambda ps: F.struct(
            _node("s", F.transform(ps, lambda x: x["digest"])).alias("digest"), ps.alias("paragraphs")))

    return _let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section), lambda ss: F.struct(
        _node("r", F.transform(ss, lambda x: x["digest"])).alias("root"), ss.alias("sections")))


def nodes(t: Column) -> Column:
    """The distinct nodes of a tree below its root, 64 bits each."""
    return F.array_distinct(F.flatten(F.transform(t["sections"], lambda s: F.concat(
        F.array(F.xxhash64(s["digest"])),
        F.flatten(F.transform(s["paragraphs"], lambda p: F.concat(F.array(F.xxhash64(p["digest"])), p["leaves"])))))))


def likeness(root_a: Column, nodes_a: Column, root_b: Column, nodes_b: Column) -> Column:
    """0 (nothing in common) to 1 (equal texts)."""
    common = F.size(F.array_intersect(nodes_a, nodes_b))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(
        2.0 * common / (F.size(nodes_a) + F.size(nodes_b) + F.lit(2)))  # the roots, which differ


def edits(a: Column, b: Column) -> Column:
    """Where tree ``a`` differs from tree ``b``: an array of (section, paragraph, leaf) numbers,
    found by descending only into sections and paragraphs whose digest ``b`` does not have."""
    there = F.transform(b["sections"], lambda s: s["digest"])
    paragraphs = F.flatten(F.transform(b["sections"], lambda s: F.transform(s["paragraphs"], lambda p: p["digest"])))
    leaves = F.flatten(F.transform(b["sections"], lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["leaves"]))))

    def numbered(items, keep):
        return F.filter(F.transform(items, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), keep)

    found = F.flatten(F.transform(
        numbered(a["sections"], lambda s: ~F.array_contains(there, s["x"]["digest"])),
        lambda s: F.flatten(F.transform(
            numbered(s["x"]["paragraphs"], lambda p: ~F.array_contains(paragraphs, p["x"]["digest"])),
            lambda p: F.transform(numbered(p["x"]["leaves"], lambda v: ~F.array_contains(leaves, v["x"])),
                                  lambda v: F.struct(s["i"].alias("section"), p["i"].alias("paragraph"), v["i"].alias("leaf")))))))
    return F.when(a["root"] == b["root"], F.filter(found, lambda x: F.lit(False))).otherwise(found)


def fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "tree") -> DataFrame:
    """``docs`` with the tree of its text; a column of that name is replaced."""
    return docs.withColumn(out_col, tree(F.col(f"`{text_col}`")))


def with_next(docs: DataFrame, n_bins: int | None = None) -> tuple[DataFrame, object]:
    """Rows (doc_id, text) dealt to bins of consecutive ids, each bin with a copy of the row that
    follows it (``ahead`` not 0); and the window over a bin in order. Rows without an id have a
    bin of their own before the others. The row after the last is the first. Texts are shuffled
    once; what the driver sees is one id for each bin.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.col("doc_id").cast("long").alias("place"))
    n_bins = n_bins or 4 * partitions(docs.sparkSession)
    outer = min(n_bins, OUTER_BINS)
    cuts = rows.agg(F.percentile_approx("place", [k / outer for k in range(outer + 1)], 10_000)).first()[0] or [0]
    cuts = sorted(set(cuts))
    inner = max(1, n_bins // len(cuts))
    low = F.array(*[F.lit(c).cast("long") for c in cuts])
    wide = F.array(*[F.lit(float(max(1, -(-(b - a) // inner)))) for a, b in zip(cuts, [*cuts[1:], cuts[-1] + 1])])
    k = F.greatest(F.size(F.filter(low, lambda c: c <= F.col("place"))), F.lit(1))
    past = F.col("place").cast("decimal(20,0)") - F.element_at(low, F.col("k")).cast("decimal(20,0)")  # may be beyond a long
    binned = rows.withColumn("k", k).withColumn("bin", F.when(F.col("place").isNull(), F.lit(0)).otherwise(F.col("k") * inner + F.least(
        F.lit(inner - 1), F.greatest(F.lit(0), F.floor(past.cast("double") / F.element_at(wide, F.col("k")))))))
    first = binned.groupBy("bin").agg(F.min("place").alias("place")).orderBy("bin").collect()  # one row for each bin
    before = [(r["place"], first[i - 1]["bin"], 2 if i == 0 else 1) for i, r in enumerate(first)]
    ahead = docs.sparkSession.createDataFrame(before, "starts long, before long, ahead int")
    spread = (binned.join(F.broadcast(ahead), F.col("place").eqNullSafe(F.col("starts")), "left")  # at most one row for each bin
              .select("doc_id", "text", "place", F.explode(F.array(
                  F.struct(F.col("bin").cast("long").alias("bin"), F.lit(0).alias("ahead")),
                  F.struct(F.col("before").alias("bin"), F.col("ahead")))).alias("to"))
              .where("to.bin is not null").select("doc_id", "text", "place", "to.bin", "to.ahead"))
    return spread, Window.partitionBy("bin").orderBy("ahead", "place", "text")


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Per row: fingerprints of its text and of its edited text (the last floor(n/2) characters
    replaced by the first as many of the next row's text), and likenesses."""
    rows, order = with_next(docs)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = (rows.withColumn("next_text", F.lead("text").over(order))
            .withColumn("n_chars", F.length("text").cast("long"))
            .withColumn("edited", F.when(F.col("ahead") == 0, F.concat(
                F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half)))))
    rows = rows.select("doc_id", "n_chars", "bin", "ahead", "place", "text", F.sha2("edited", 256).alias("edited_sha256"),
                       tree(F.col("text")).alias("t"), tree(F.col("edited")).alias("e"))
    rows = rows.select("doc_id", "n_chars", "bin", "ahead", "place", "text", "edited_sha256", F.col("t.root").alias("fingerprint"),
                       nodes(F.col("t")).alias("nodes"), F.col("e.root").alias("edited_fingerprint"), nodes(F.col("e")).alias("edited_nodes"))
    rows = rows.withColumn("next_root", F.lead("fingerprint").over(order)).withColumn("next_nodes", F.lead("nodes").over(order))
    return rows.where("ahead = 0").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("nodes"), F.col("edited_fingerprint"), F.col("edited_nodes")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("nodes"), F.col("next_root"), F.col("next_nodes")).alias("near_next"),
        F.size("nodes").alias("n_nodes"))
