"""The classifier: features, updates, held-out rows, degenerate tables."""

import random
import zlib

import numpy as np
import pytest
import xxhash

from kiln.llm.quality import Settings, classify, features, ftrl, passed

S = Settings(bits=14, shards=2)


def _corpus(spark, n=600):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(10, 60))]
        kind = rng.choice(["good", "good", "good", "caps", "marks", "repeat"])
        if kind == "caps":
            w = [x.upper() + "!!" for x in w]
        elif kind == "marks":
            w = [x + rng.choice(["###", "$$$"]) for x in w]
        elif kind == "repeat":
            w = [w[0]] * len(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind == "good")))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_features_count_every_ngram():
    at, first = features(["a b a", None, "", "x"], 10)
    assert first.tolist() == [0, 10, 10, 10, 12]  # 3 words and 2 pairs, as written and as shapes
    assert (at < 1 << 10).all() and (at >= 0).all()
    again, _ = features(["x", "a b a"], 10)
    assert sorted(again[2:].tolist()) == sorted(at[:10].tolist())


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(400):
        label = int(rng.integers(0, 2))
        rows.append((np.array([label, 2 + int(rng.integers(0, 500))]), np.array([0.5, 0.5])))
        y.append(label)
    w, _ = ftrl(rows, np.array(y), Settings(bits=10, l1=2.0))
    assert w[1] > 0 > w[0] and (w[600:] == 0).all() and (w[2:502] == 0).mean() > 0.5


def test_held_out_accuracy(spark):
    docs, labels, truth = _corpus(spark)
    got = classify(docs, labels, s=S).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum((r.score >= 0.5) == (truth[r.doc_id] == 1) for r in held) / len(held) > 0.95


def test_scores_depend_on_the_text_alone(spark):
    docs, labels, _ = _corpus(spark, 200)
    twice = docs.union(docs.selectExpr("doc_id + 100000", "text"))
    got = {}
    for r in classify(twice, labels, s=S).collect():
        got.setdefault(r.doc_id % 100000, set()).add(r.score)
    assert all(len(v) == 1 for v in got.values())
    # labels of held-out rows change nothing
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality")
    a = {r.doc_id: r.score for r in classify(docs, labels, s=S).collect()}
    assert a == {r.doc_id: r.score for r in classify(docs, flipped, s=S).collect()}


def test_awkward_tables(spark, messy, empty):
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, None), (None, 1), (10, 0), (999, 1)], "doc_id long, quality int")
    got = classify(messy, labels, s=S)
    assert got.count() == messy.count() and got.where("score is null").count() == 0
    assert classify(empty, labels, s=S).collect() == []
    none = classify(messy, labels.limit(0), s=S).collect()
    assert {r.score for r in none} == {0.5}
    assert passed(messy, labels.limit(0), s=S).columns == messy.columns
    assert passed(messy, labels.limit(0), s=S).count() == messy.count()


def test_bounded_sample(spark):
    docs, labels, truth = _corpus(spark, 400)
    got = classify(docs, labels, s=Settings(bits=14, shards=3, max_train=150)).collect()
    assert len(got) == 400 and np.mean([(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in got]) > 0.85


def _plain_weights(examples, labels, s):
    """The passes coordinate by coordinate; ``examples`` are {coordinate: value} with the bias at -1."""
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= s.l1:
            return 0.0
        sign = 1.0 if z[k] > 0 else -1.0
        return -(z[k] - sign * s.l1) / ((s.beta + n[k] ** 0.5) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for x, y in zip(examples, labels):
            w = {k: weight(k) for k in x}
            dot = sum(w[k] * v for k, v in x.items())
            p = 1.0 / (1.0 + np.exp(-max(-35.0, min(35.0, dot))))
            for k, v in x.items():
                g = (p - y) * v
                z[k] = z.get(k, 0.0) + g - ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / s.alpha * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z}


def _plain_example(text, s):
    at = features([text], s.bits)[0].tolist()
    return {**{k: at.count(k) / len(at) * s.scale for k in set(at)}, -1: 1.0}


def test_scores_against_plain_loops(spark):
    """Sample, shards, passes, average and dot products once more, without arrays."""
    docs, labels, truth = _corpus(spark, 150)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = []
    for i, text in texts.items():
        if zlib.crc32(str(i).encode()) % 5:
            h = xxhash.xxh64_intdigest(str(i).encode(), seed=42)
            rows.append((h - (1 << 64) if h >> 63 else h, truth[i], text))
    rows.sort()
    total, shards = {}, sorted({(h >> 8) % S.shards for h, _, _ in rows})
    for shard in shards:
        mine = [r for r in rows if (r[0] >> 8) % S.shards == shard]
        for k, w in _plain_weights([_plain_example(t, S) for _, _, t in mine], [y for _, y, _ in mine], S).items():
            total[k] = total.get(k, 0.0) + w / len(shards)
    got = {r.doc_id: r.score for r in classify(docs, labels, s=S).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        dot = sum(total.get(k, 0.0) * v for k, v in _plain_example(text, S).items())
        assert got[i] == pytest.approx(1 / (1 + np.exp(-dot)), abs=1e-5)


def test_a_very_long_text_scores_as_a_short_one(spark):
    """Shares of n-grams, not their numbers, make the score; no part of the text is left out."""
    docs, labels, _ = _corpus(spark, 200)
    block = "abc de fgh bad cab ace beg had hag fed"
    tail = " ".join(["!!!###$$$ AAA"] * 100_000)
    more = spark.createDataFrame([(10_000, " ".join([block] * 50)), (10_001, " ".join([block] * 50_000)),
                                  (10_002, " ".join([block] * 20_000) + " " + tail), (10_003, "z" * 2_000_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in classify(docs.union(more), labels, s=S).collect() if r.doc_id >= 10_000}
    assert len(got) == 4 and got[10_000] == pytest.approx(got[10_001], abs=0.01)
    assert got[10_002] < got[10_001]  # what the end of the text adds is seen
