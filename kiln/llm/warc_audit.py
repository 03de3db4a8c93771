"""WARC fixity audit: Merkle trees over records and ordered ranges of them (operator 7).

A replica is a table of records by key, with each record's bytes. Its tree has a leaf per key
(SHA-256 and length of the record) and, over keys in order, a node for every range of 16, 256,
... keys: the SHA-256 of its children's places, digests and lengths, which fix the offsets
inside the range. Inserting or losing bytes therefore changes one path of the tree, not all that
follows. Two replicas whose roots agree are equal. Otherwise the audit descends from the root,
level by level, only into ranges whose digests differ, to the records that are changed, missing
or extra, and states where in the WARC files of the first replica they stand.

A range is grouped by its place, so no group has more than 16 children. A key that occurs several
times is one leaf: the root of a tree over its distinct digests and their numbers of copies, whose
nodes are ranges of digests with about 16 children, however many records the key has.

Defined results: a NULL key is the key -1; equal keys make one leaf, which does not depend on
their order; a NULL url, payload or record is an empty one; an empty replica has the root of no
records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.shared import stored

FAN_BITS = 4
#: Keys that share a WARC file.
FILE_BITS = 9


def record_bytes(key: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.1 resource record as text."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:kiln:record:"), key.cast("string"),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(key, record) of every page."""
    key = F.coalesce(F.col(f"`{key_col}`").cast("long"), F.lit(-1))
    return pages.select(key.alias("key"), record_bytes(key, F.col(f"`{url_col}`"), F.col(f"`{payload_col}`")).alias("record"))


def leaves(replica: DataFrame) -> DataFrame:
    """One row per key of (key, record): place, digest, length."""
    record = F.coalesce("record", F.lit(""))
    r = replica.select(F.coalesce("key", F.lit(-1)).alias("place"), F.sha2(record, 256).alias("d"), F.octet_length(record).cast("long").alias("n"))
    r = stored(r.groupBy("place", "d").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")), "warc-digests")
    kinds = r.groupBy("place").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1 << FAN_BITS)
    most = kinds.agg(F.max("k")).first()[0] or 0
    # so many hexadecimal digits of a digest make ranges of about 16; by the key's own number, so
    # that its leaf does not depend on other keys
    digits = F.ceil((F.length(F.bin(F.col("k") - 1)) - FAN_BITS) / FAN_BITS).cast("int")
    r = r.join(kinds.select("place", digits.alias("digits")), "place", "left") if most else r.withColumn("digits", F.lit(0))
    r = r.select("place", F.left("d", F.coalesce("digits", F.lit(0))).alias("range"), F.col("c").alias("copies"), "d", "n")
    for k in range((-(-((most - 1).bit_length() - FAN_BITS) // FAN_BITS)) if most else 0, -1, -1):
        due = F.length("range") == k  # the others wait for their level
        r = r.groupBy("place", "range", F.when(~due, F.col("d")).alias("waits")).agg(
            F.sort_array(F.collect_list(F.struct("d", "copies"))).alias("c"), F.sum("n").alias("n"), F.sum("copies").alias("copies"))
        whole = F.sha2(F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["d"], x["copies"])), ","), 256)
        one = F.when(F.col("copies") == 1, F.col("c")[0]["d"]).otherwise(whole)  # one record is its own digest
        r = r.select("place", F.when(F.col("waits").isNull(), F.left("range", F.lit(max(k - 1, 0)))).otherwise(F.col("range")).alias("range"),
                     "copies", "n", F.coalesce("waits", one).alias("d"))
    return r.select("place", F.col("d").alias("digest"), F.col("n").alias("length"))


def parents(level: DataFrame) -> DataFrame:
    """The next level: one row for each range of 16 places."""
    child = F.struct("place", "digest", "length")
    return level.groupBy(F.shiftright("place", FAN_BITS).alias("place")).agg(
        F.sort_array(F.collect_list(child)).alias("c"), F.sum("length").alias("length")).select(
        "place", F.sha2(F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["place"], x["digest"], x["length"])), ","), 256).alias("digest"), "length")


class Tree:
    """The levels of a replica's tree, leaves first, each a table in the shared folder."""

    def __init__(self, replica: DataFrame, height: int | None = None):
        self.levels = [stored(leaves(replica), "warc-leaves")]
        while len(self.levels) <= height if height is not None else not self._is_top(self.levels[-1]):
            self.levels.append(stored(parents(self.levels[-1]), "warc-level"))

    @staticmethod
    def _is_top(level: DataFrame) -> bool:
        """At most one place on either side of zero."""
        r = level.agg(F.min("place"), F.max("place")).first()
        return r[0] is None or (r[0] >= -1 and r[1] <= 0)

    def root(self) -> str:
        """The digest of all records; the top level has two rows at most."""
        return self.levels[-1].agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]), ","), 256)).first()[0]


def audit(replica_a: DataFrame, replica_b: DataFrame) -> DataFrame:
    """The damaged records of two replicas (key, record): key, status (changed, missing or extra
    in the second), digest_a, digest_b, length_a, length_b. No rows if the roots agree."""
    a = Tree(replica_a)
    b = Tree(replica_b, len(a.levels) - 1)
    while not Tree._is_top(b.levels[-1]):  # the second reaches further: raise both
        for t in (a, b):
            t.levels.append(stored(parents(t.levels[-1]), "warc-level"))
    suspect = None
    for la, lb in zip(reversed(a.levels), reversed(b.levels)):
        one = la.select("place", F.col("digest").alias("digest_a"), F.col("length").alias("length_a"))
        two = lb.select("place", F.col("digest").alias("digest_b"), F.col("length").alias("length_b"))
        if suspect is not None:
            above = suspect.select(F.col("place").alias("above"))
            one, two = (x.join(above, F.shiftright("place", FAN_BITS) == F.col("above"), "left_semi") for x in (one, two))
        suspect = one.join(two, "place", "full").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        if lb is not b.levels[0]:
            suspect = stored(suspect, "warc-differing")
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    return suspect.select(F.col("place").alias("key"), status.alias("status"), "digest_a", "digest_b", "length_a", "length_b")


def located(damage: DataFrame, replica: DataFrame) -> DataFrame:
    """``damage`` with the WARC file and the byte offset of each record in the first replica
    (records stand in order of their key, files hold the keys of a range); NULL for extra ones."""
    order = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = replica.groupBy(F.coalesce("key", F.lit(-1)).alias("place")).agg(F.sum(F.octet_length("record").cast("long")).alias("length"))
    at = at.withColumn("file", F.shiftright("place", FILE_BITS)).withColumn("offset", F.sum("length").over(order) - F.col("length"))
    return damage.join(at.select(F.col("place").alias("key"), "file", "offset"), "key", "left")
