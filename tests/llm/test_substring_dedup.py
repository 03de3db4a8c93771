"""Substring dedup against the definition, window by window."""

import hashlib
import re

from pyspark.sql import functions as F

from kiln.llm import substring_dedup as module
from kiln.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """A window goes if its words also start in a smaller doc_id, or earlier in the same row."""
    texts = [(-(1 << 63) if i is None else i, WORD.findall(t or "")) for i, t in rows]
    least, out = {}, []
    for i, w in texts:
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            least[k] = min(least.get(k, i), i)
    for i, w in texts:
        gone, seen = [False] * len(w), set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            if k in seen or least[k] < i:
                gone[s:s + window] = [True] * window
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((None if i == -(1 << 63) else i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def _got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_matches_definition(messy, rows):
    plain = [(r[0], r[1]) for r in rows]
    assert _got(substring_dedup(messy, window=20)) == brute(plain, 20)
    # other widths, an odd one among them, and chunks of a row or two
    assert _got(substring_dedup(messy, window=7, chunk_bytes=200)) == brute(plain, 7)


def test_spans_and_kept_text(messy, rows):
    texts = {r[0]: WORD.findall(r[1] or "") for r in rows}
    for r in substring_dedup(messy, window=20).where("doc_id in (5, 6, 8, 13, 14)").collect():
        w = texts[r.doc_id]
        gone = {k for s in r.spans for k in range(s.start, s.end)}
        assert len(gone) == r.n_removed
        assert r.kept_text.encode() == b" " .join(x.encode() for k, x in enumerate(w) if k not in gone)
        assert all(b.start > a.end for a, b in zip(r.spans, r.spans[1:]))  # maximal runs


def test_many_copies_are_linear(spark):
    text = " ".join(f"w{k}" for k in range(100))
    got = substring_dedup(spark.range(3000).selectExpr("id as doc_id", f"'{text}' as text"), chunk_bytes=20_000).collect()
    assert sorted(r.n_removed for r in got) == [0] + [100] * 2999


def test_empty(empty):
    assert substring_dedup(empty).collect() == []


def test_two_levels_of_dealing(messy, rows, empty):
    """Chunks of a row or two, buckets of a few windows: the hashes are dealt twice."""
    plain = [(r[0], r[1]) for r in rows]
    for window, fan in ((7, 4), (20, 1)):
        got = substring_dedup(messy, window=window, chunk_bytes=200, bucket_windows=20, fan=fan)
        assert _got(got) == brute(plain, window)
    assert substring_dedup(empty, fan=1).collect() == []


def test_rows_handed_over_stay_bounded(spark, monkeypatch):
    """No chunk hands a row to every bucket, and no group a row of every chunk."""
    seen = []
    answered = module._answered

    def watched(rows, *rest):
        seen.append((rows, rest[3:]))
        return answered(rows, *rest)

    monkeypatch.setattr(module, "_answered", watched)
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.expr(
        "concat_ws(' ', transform(sequence(1, 60), i -> concat('w', pmod(hash(id div 2, i), 500))))").alias("text"))
    got = substring_dedup(texts, chunk_bytes=1000, bucket_windows=100, fan=8)
    assert sorted(r.n_removed for r in got.collect()) == [0] * 200 + [60] * 200
    assert len(seen) == 2
    for rows, (ranges, fine, groups) in seen:
        assert fine > 1 and ranges <= 20 and fine <= 20 and groups > 1
        assert rows.groupBy("chunk").count().agg(F.max("count")).first()[0] <= ranges
        gathered = rows.withColumn("grp", F.pmod(F.xxhash64("chunk"), F.lit(groups))).groupBy("bucket", "grp")
        assert gathered.count().agg(F.max("count")).first()[0] < rows.select("chunk").distinct().count()


def test_levels():
    assert module._levels(256, 10, 256) == (256, 1, 1)
    for buckets, chunks in ((257, 1000), (5_500_000, 25_000_000)):
        ranges, fine, groups = module._levels(buckets, chunks, 256)
        assert ranges * fine >= buckets and max(ranges, fine) <= buckets ** 0.5 + 1
        assert groups >= 1 and chunks / groups <= 2 * ranges
