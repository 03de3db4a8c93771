"""Fingerprints: equality, likeness, located edits, the next row."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kiln.llm.merkle_docs import LEAF, edit_likeness, edits, tree


def _expected(rows):
    rows = sorted(((-(1 << 63) if i is None else i, t or "") for i, t in rows), key=lambda r: (r[0], r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt, h = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[:len(t) - h] + nxt[:h]
        out.append((None if i == -(1 << 63) else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, nxt))
    return out


def test_edited_texts_and_likeness(messy, rows):
    want = _expected([(r[0], r[1]) for r in rows])
    got = edit_likeness(messy).collect()
    assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(str, (w[:3] for w in want)))
    prints = {}
    by_key = {(w[0], w[1], w[2]): w for w in want}
    for r in got:
        w = by_key[r.doc_id, r.n_chars, r.edited_sha256]
        prints.setdefault(w[3], set()).add(r.fingerprint)
        prints.setdefault(w[4], set()).add(r.edited_fingerprint)
        for near, other in ((r.near_edited, w[4]), (r.near_next, w[5])):
            assert 0 <= near <= 1 and (near == 1) == (w[3] == other)
        if r.n_chars > 2000 and len(set(w[3].split())) > 50 and w[3] != w[4]:
            assert 0.2 < r.near_edited < 0.8  # half of it stands
    assert all(len(p) == 1 for p in prints.values())
    assert len({next(iter(p)) for p in prints.values()}) == len(prints)


def test_edits_are_located(spark):
    words = [" ".join(f"w{p}x{k}" for k in range(30)) for p in range(9)]
    a = "\n\n".join("\n".join(words[i:i + 3]) for i in (0, 3, 6))
    b = a.replace("w4x20", "other")
    row = spark.createDataFrame([(a, b, a)], "a string, b string, c string").select(
        edits(tree(F.col("a")), tree(F.col("b"))).alias("ab"), edits(tree(F.col("a")), tree(F.col("c"))).alias("ac")).first()
    assert [tuple(x) for x in row.ab] == [(1, 1, 1)] and row.ac == []


def test_layout_changes_the_root(spark):
    texts = ["a b\nc", "a\nb c", "a b\n\nc", "a b\nc\n", "a  b\nc", "", "\n", "\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tree(F.col("t"))["root"].alias("r"))
    assert len({r.r for r in df.collect()}) == len(texts)


def test_single_row_and_empty(spark, empty):
    one = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    r = edit_likeness(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abc abc").hexdigest() and r.near_next == 1.0
    assert edit_likeness(empty).collect() == []


@pytest.mark.parametrize("ids", [[None, *range(1000)], [None, None, -(1 << 63), -5, *range(300), (1 << 63) - 1], [None, None]])
def test_null_and_far_ids(spark, ids):
    """A NULL id ranks first, before every id a long can hold."""
    rows = sorted(((i, f"{k} text of {i}") for k, i in enumerate(ids)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        h = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[:len(t) - h] + rows[(k + 1) % len(rows)][1][:h]).encode()).hexdigest()))
    got = edit_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(str, want))


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _plain_tree(text):
    """The root and the set of the other nodes, by plain loops."""
    below, sections = set(), []
    for section in text.split("\n\n"):
        paragraphs = []
        for paragraph in section.split("\n"):
            leaves = [_sha(x) for x in re.findall(LEAF, paragraph, re.ASCII)]
            assert "".join(re.findall(LEAF, paragraph, re.ASCII)) == paragraph
            paragraphs.append(_sha("p" + "".join(leaves)))
            below |= {*leaves, paragraphs[-1]}
        sections.append(_sha("s" + "".join(paragraphs)))
        below.add(sections[-1])
    return _sha("r" + "".join(sections)), below


def _plain_likeness(a, b):
    return 1.0 if a[0] == b[0] else 2 * len(a[1] & b[1]) / (len(a[1]) + len(b[1]) + 2)


def _held_against_plain_trees(docs, pairs):
    want = {}
    for i, n, sha, text, edited, nxt in _expected(pairs):
        t, e, x = _plain_tree(text), _plain_tree(edited), _plain_tree(nxt)
        want.setdefault((i, n, sha), set()).add((t[0], e[0], round(_plain_likeness(t, e), 12), round(_plain_likeness(t, x), 12), len(t[1])))
    got = edit_likeness(docs).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert (r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12), r.n_nodes) in want[r.doc_id, r.n_chars, r.edited_sha256]


def test_every_row_against_plain_trees(messy, rows):
    _held_against_plain_trees(messy, [(r[0], r[1]) for r in rows])


def test_very_long_texts_against_plain_trees(spark):
    rng = random.Random(11)
    words = [rng.choice(["é", "word", "longer", "x" * 70, "tab\t", "  "]) + rng.choice(["", "", "", "\n", "\n\n", "\n\n\n"]) for _ in range(150_000)]
    pairs = [(1, " ".join(words)), (2, "y" * 400_000), (3, " " * 200_000), (4, "\n" * 5_000), (5, "short")]
    assert len(pairs[0][1]) > 1_000_000
    _held_against_plain_trees(spark.createDataFrame(pairs, "doc_id long, text string").repartition(2), pairs)
