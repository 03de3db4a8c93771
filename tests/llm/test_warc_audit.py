"""The audit finds every kind of damage, and nothing else."""

import hashlib

from kiln.llm.warc_audit import Tree, audit, leaves, located, records


def _pages(spark, ids):
    return spark.createDataFrame([(i, f"http://x/{i}", None if i == 7 else f"<p>{i} é</p>" * (i % 5 if i else 1)) for i in ids],
                                 "page_id long, url string, html string")


def test_equal_replicas(spark):
    a = records(_pages(spark, [*range(-40, 700, 3), None, 8, 8]))
    b = a.repartition(7)
    assert audit(a, b).collect() == [] and Tree(a).root() == Tree(b).root()


def test_damage_is_located(spark):
    ids = [*range(0, 3000, 2), -5, -100, None]
    a = records(_pages(spark, ids))
    b = a.where("key not in (10, 2998)").selectExpr("key", "if(key in (100, -5), concat(record, 'x'), record) as record").union(
        records(_pages(spark, [3, 50_001, 200])))  # 200 occurs twice now
    got = {r.key: r for r in located(audit(a, b), a).collect()}
    assert {k: r.status for k, r in got.items()} == {10: "missing", 2998: "missing", 100: "changed", -5: "changed", 200: "changed",
                                                    3: "extra", 50_001: "extra"}
    text = {r.key: r.record.encode() for r in a.collect()}
    for k in (10, 100, 2998):
        before = sum(len(t) for j, t in text.items() if j < k and j >> 9 == k >> 9)
        assert (got[k].file, got[k].offset, got[k].length_a) == (k >> 9, before, len(text[k]))
        assert got[k].digest_a == hashlib.sha256(text[k]).hexdigest()
    assert got[3].offset is None and got[3].digest_a is None


def test_empty_replicas(spark):
    a = records(_pages(spark, [1, 20, 300]))
    none = a.limit(0)
    assert audit(none, none).collect() == []
    assert {(r.key, r.status) for r in audit(a, none).collect()} == {(k, "missing") for k in (1, 20, 300)}
    assert {(r.key, r.status) for r in audit(none, a).collect()} == {(k, "extra") for k in (1, 20, 300)}


def test_only_differing_branches_are_read(spark):
    a = records(_pages(spark, range(4096)))
    one = Tree(a)
    assert [t.count() for t in one.levels] == [4096, 256, 16, 1]
    other = Tree(a.selectExpr("key", "if(key = 1234, 'x', record) as record"))
    for x, y in zip(one.levels, other.levels):
        assert x.join(y, ["place", "digest"]).count() == x.count() - 1


def _plain_leaf(records):
    """The digest of one key's records, by plain loops."""
    copies = {}
    for x in records:
        d = hashlib.sha256(x.encode()).hexdigest()
        copies[d] = copies.get(d, 0) + 1
    digits = max(0, -(-((len(copies) - 1).bit_length() - 4) // 4)) if len(copies) > 16 else 0

    def node(prefix, found):
        if sum(c for _, c in found) == 1:
            return found[0][0]
        if len(prefix) < digits:
            parts = [(h, [x for x in found if x[0].startswith(prefix + h)]) for h in "0123456789abcdef"]
            found = [(node(prefix + h, part), sum(c for _, c in part)) for h, part in parts if part]
        return hashlib.sha256(",".join(f"{d}:{c}" for d, c in sorted(found)).encode()).hexdigest()

    return node("", sorted(copies.items()))


def test_repeated_keys_against_plain_loops(spark):
    held = {1: ["a"], 2: ["a", "a"], 3: ["a", "b"], 4: [f"r{i}" for i in range(17)], 5: [f"s{i % 900}" for i in range(1000)], 6: [""] * 3,
            None: [f"t{i}" for i in range(5000)]}
    rows = [(k, x) for k, v in held.items() for x in v]
    got = {r.place: (r.digest, r.length) for r in leaves(spark.createDataFrame(rows, "key long, record string").repartition(6)).collect()}
    assert got == {-1 if k is None else k: (_plain_leaf(v), sum(map(len, v))) for k, v in held.items()}
    # a key's leaf does not depend on the other keys of its replica
    few = [r for r in rows if r[0] is not None]
    assert {r.place: r.digest for r in leaves(spark.createDataFrame(few, "key long, record string")).collect()} == {
        k: d for k, (d, _) in got.items() if k != -1}


def test_null_records_and_lost_copies(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "y"), (2, "y"), (3, "z")], "key long, record string")
    assert audit(a, a.repartition(3)).collect() == []
    b = spark.createDataFrame([(1, ""), (2, "x"), (2, "x"), (2, "y"), (3, None)], "key long, record string")
    assert {(r.key, r.status) for r in audit(a, b).collect()} == {(2, "changed"), (3, "changed")}
