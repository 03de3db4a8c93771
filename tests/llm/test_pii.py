"""Base spans against Python's regular expressions; disguises planted at known places."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from kiln.llm.pii import KINDS, Deobfuscator, Rewrite, base_spans, find_pii, listed, masked

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for no, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "phone": lambda: 8 <= len(digits) <= 15,
                  "card": lambda: 16 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
                                                                    for i, c in enumerate(digits[::-1])) % 10 == 0}[kind]()
            if ok:
                out.append((no, *m.span()))
    return out


@pytest.fixture(scope="module")
def clear():
    return Deobfuscator()


def test_base_equals_regular_expressions():
    rng = random.Random(1)
    parts = ["1", "22", "333", "0", ".", "-", " ", "@", "a", "bc", "_", "+", "(", ")", "4041894974608795", "é", "\n", ".com", "x.y", "5555", "00255", "256", "٣"]
    n = 0
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        n += len(plain(text))
        assert base_spans(text) == plain(text), text
    assert n > 4000


PEOPLE = [("email", "jo.doe@mail7.example.com"), ("ip", "97.51.17.173"), ("card", "4041894974608795"), ("phone", "+1 (017) 555-7713")]
DISGUISES = [
    ("email", "jo.doe (at) mail7 (dot) example (dot) com"), ("email", "jo.doe[at]mail7[.]example[dot]com"), ("email", "jo.doe at mail7.example.com"),
    ("email", "jo dot doe AT mail7 DOT example DOT com"), ("email", "jо.dоe@mаil7.еxample.com"), ("email", "jo.doe@mail7.exam​ple.com"),
    ("email", "ｊｏ.doe＠mail7．example．com"), ("email", "jo.doe @ mail7 . example . com"), ("email", "jo punto doe arroba mail7 punto example punto com"),
    ("ip", "97[.]51[.]17[.]173"), ("ip", "nine seven dot five one dot 17 dot 173"), ("ip", "٩٧.٥١.١٧.١٧٣"), ("ip", "97 dot 51 dot 17 dot 173"),
    ("card", "4o41 8949 7460 8795"), ("card", "vier null vier eins acht neun vier neun sieben vier sechs null acht sieben neun fünf"),
    ("card", "4041–8949–7460–8795"), ("card", "4041­8949­7460­8795"), ("phone", "plus one (zero one seven) five five five seven seven one three"),
    ("phone", "+1 (017) triple five-double seven 13"), ("phone", "plus one (017) five five five seven seven one three"), ("phone", "＋１ (017) 555－7713"),
    ("phone", "+1 (o17) 555-77l3")]


@pytest.mark.parametrize("kind, hidden", DISGUISES)
def test_disguises_are_found_where_they_stand(clear, kind, hidden):
    plain_digits = lambda v: re.sub("[^A-Za-z0-9]", "", v)
    for head, tail in (("", ""), ("é😀 über ", " und"), ("see ", ", then more."), ("un 12, ", "\n7")):
        text = head + hidden + tail
        got = [(KINDS[no], s, e) for no, s, e, disguised, _ in clear.spans(text) if disguised]
        assert (kind, len(head), len(head) + len(hidden)) in got, (text, got)
        values = {plain_digits(v) for no, *_, disguised, v in clear.spans(text) if disguised and KINDS[no] == kind}
        assert plain_digits(dict(PEOPLE)[kind]) in values


@pytest.mark.parametrize("text", [
    "look at example.com", "we met at noon. Point two: one of the two was at home.", "un 4041894974608795 deux", "почта@пример.рф", "at at at . . .",
    "It costs 3 point 5 (at) most", "dos de tres en uno", "a (dot) b", "plus one", "Zwei und drei sind fünf; vier, fünf, sechs.", "@ . @ (at) (dot)"])
def test_ordinary_text_has_no_disguises(clear, text):
    assert [x for x in clear.spans(text) if x[3]] == []


def test_base_spans_stay(clear):
    rng = random.Random(3)
    parts = [p for _, p in PEOPLE] + [h for _, h in DISGUISES] + ["word", "and", "é", "at", "one", ".", "(", "7"]
    for _ in range(400):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        found = clear.spans(text)
        assert [(no, s, e) for no, s, e, hidden, _ in found if not hidden] == plain(text)
        assert found == sorted(found)
        assert all(text[s:e] != v for _, s, e, hidden, v in found if hidden)


def test_rewrite_maps_places_back():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 4)) // 2 * 2))
        pieces = [(s, e, rng.choice(["", "X", "YZ"])) for s, e in zip(cuts[::2], cuts[1::2])]
        made = Rewrite(text, pieces)
        origin = []  # for each output character, the source places it stands for
        at = 0
        for s, e, new in [*pieces, (len(text), len(text), "")]:
            origin += [(i, i + 1) for i in range(at, s)] + [(s, e)] * len(new)
            at = e
        assert len(origin) == len(made.text)
        for s in range(len(origin)):
            for e in range(s + 1, len(origin) + 1):
                assert made.back(s, e) == (origin[s][0], origin[e - 1][1])


@pytest.mark.parametrize("unit", ["1", "a.", "+1(", "@a", "one ", " ", "1.2.", "[ ", "a at ", "é@", "four (at) x (dot) ", "о", "1​", "l1", "- "])
def test_long_texts_take_linear_time(clear, unit):
    text = unit * (2_000_000 // len(unit))
    start = time.perf_counter()
    found = clear.spans(text + "\njo.doe (at) mail7 (dot) example (dot) com")
    assert time.perf_counter() - start < 30
    assert any(hidden and v.endswith("jo.doe@mail7.example.com") for *_, hidden, v in found)


def test_table(spark, messy, rows, empty):
    extra = [(100 + k, f"see {h} ok") for k, (_, h) in enumerate(DISGUISES)] + [(100, f"see {DISGUISES[0][1]} ok")]
    docs = messy.select("doc_id", "text", "found").unionByName(spark.createDataFrame(extra, "doc_id long, text string").withColumn("found", F.lit("x")))
    got = find_pii(docs)
    assert got.columns == ["doc_id", "text", "found"]
    clear = Deobfuscator()
    want = sorted((str(i), [(no, s, e, h, v, KINDS[no]) for no, s, e, h, v in clear.spans(t or "")]) for i, t in [(r[0], r[1]) for r in rows] + extra)
    assert sorted((str(r.doc_id), [tuple(x) for x in r.found]) for r in got.collect()) == want
    first = got.where("doc_id = 100").select(listed(F.col("found")).alias("l")).collect()
    assert [r.l for r in first] == ["email:4:45", "email:4:45"]
    assert find_pii(empty).collect() == [] and masked(empty).collect() == []


def test_masked(spark):
    docs = spark.createDataFrame([(1, "a jo.doe (at) mail7 (dot) example (dot) com b 97.51.17.173"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.text for r in masked(docs).orderBy("doc_id").collect()] == ["a [email] b [ip]", None, ""]
