"""The grammar round trip, its parser, and the read-back of tables."""

import hashlib
import random

import pytest

from kiln.llm.chat import Parser, escape, format_turns, parse, read_back, render, unescape

PARTS = ["<|im_start|>", "<|im_end|>", "<", "|", "\\", "\n", "<\\|", "<\\\\|", "im_end|>", "a", "%0A", "%", "é", "\r", ">", "😀"]


def test_round_trip_of_hostile_content():
    rng = random.Random(2)
    for _ in range(20_000):
        text, role = ("".join(rng.choice(PARTS) for _ in range(rng.randint(0, n))) for n in (8, 3))
        formatted, a, b = render(role, text)
        assert unescape(formatted[a:b]) == text and parse(formatted * 2) == [(role, text)] * 2
        assert unescape(escape(text)) == text and "<|" not in escape(text)


def test_plain_content_stays_as_it_is():
    assert render("user", "a < b | c")[0] == "<|im_start|>user\na < b | c<|im_end|>\n"


def test_parser_takes_pieces_of_any_size():
    rng = random.Random(3)
    turns = [("user", "".join(rng.choice(PARTS) for _ in range(6))) for _ in range(50)]
    formatted = "".join(render(*t)[0] for t in turns)
    p, got, at = Parser(), [], 0
    while at < len(formatted):
        n = rng.randint(1, 9)
        got += p.feed(formatted[at:at + n])
        at += n
    p.close()
    assert got == turns


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user\nab", "<|im_start|>user\na<|im_end|>", "<|im_start|>u\n<|im_start|><|im_end|>\n", "<|im_st"])
def test_parser_rejects(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_tables(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, None]), rng.choice(["user", "assistant", "system", None, "a\nb"]),
             rng.choice([None, "", "x" * 20_000, *("".join(rng.choice(PARTS) for _ in range(5)) for _ in range(4))]), "extra") for _ in range(200)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    turns = format_turns(df)
    got = {r.conv_id: r for r in read_back(turns).collect()}
    lengths = {r.conv_id: r.n for r in turns.selectExpr("conv_id", "length(formatted) as k").groupBy("conv_id").sum("k").withColumnRenamed("sum(k)", "n").collect()}
    assert set(got) == {1, 2, 3, None}
    for c, r in got.items():
        own = sorted(((-1 if t is None else t, (role or "").encode(), (text or "").encode()) for i, t, role, text, _ in rows if i == c))
        loss = b"".join(text for _, role, text in own if role == b"assistant")
        assert r.n_turns == len(own) and r.formatted_chars == lengths[c]
        assert r.turns_sha256 == hashlib.sha256(b"".join(role + b"\n" + text + b"\n" for _, role, text in own)).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss.decode()), hashlib.sha256(loss).hexdigest())
    assert read_back(format_turns(df.limit(0))).collect() == []
