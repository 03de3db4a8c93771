"""The transducers against the public library, and their lookahead and state."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kiln.llm.bpe import SEGMENT_CHARS, Model, bpe_decode, bpe_encode, bpe_round_trip, load, sufficient_lookahead

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def model():
    return Model(load(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _same(model, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert [i for part in model.encode(text) for i in part] == want, repr(text[:80])
    assert "".join(model.decode(want)) == library.decode(want, skip_special_tokens=False)
    return want


def test_awkward_texts(model, library):
    texts = ["", " ", "ΑΣΣΑΣ ΟΔΟΣ İstanbul ǅ ß", "a\x1cb\x85c​d e", "it's we'll I'D é é", "가각 ①²½", "<|endoftext|>hi<|startoftext|> x",
             "<|endoftext|", "=-" * 3000, "aaaa" * 5000, "é" * 3000, "\u0000\u0001 ﻿ a", "!" * 5000, " ́a"]
    for t in texts:
        _same(model, library, t)
    assert model.encode_batch([*texts, None], at_once=3) == [*(library.encode(t, add_special_tokens=False).ids for t in texts), []]


def test_random_texts(model, library):
    rng = random.Random(3)
    vocab = [t.replace("</w>", "") for t in model.vocab]
    for _ in range(400):
        _same(model, library, "".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))))


def test_long_runs_stream_through_a_window(model, library):
    rng = random.Random(4)
    for _ in range(30):
        text = "".join(rng.choice(["a", "e", "t", "h", "th", "in", "er", "an", "o", "s", "l"]) for _ in range(rng.randint(1500, 4000)))
        held = []

        def symbols():
            for k, s in enumerate(model._symbols(text)):
                held.append(k)
                yield s
        got, first = [], None
        for t in model.run(symbols()):
            first = first or len(held)
            got.append(t)
        assert got == library.encode(text, add_special_tokens=False).ids
        assert first <= model.window  # the first tokens leave while the run still comes in


def test_lookahead_by_hand():
    # ab needs one symbol; bc is tried before ab, so ab also waits for c
    assert sufficient_lookahead([("a", "b")], len) == 1
    assert sufficient_lookahead([("b", "c"), ("a", "b")], len) == 2
    assert sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")], len) == 3


def test_byte_level_decoder_is_incremental():
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, library = Model(load(path)), Tokenizer.from_file(path)
    ids = library.encode("héllo 가 😀 end", add_special_tokens=False).ids
    parts = list(model.decode(ids))
    assert "".join(parts) == "héllo 가 😀 end" and len(parts) == len(ids) + 1
    assert "".join(model.decode(ids[:-1] + [10**6])) == "héllo 가 😀"


def test_tables(messy, rows, empty, library):
    def digests(df):
        return sorted((str(r.doc_id), hashlib.sha256(str(r.ids).encode()).hexdigest(), r.decoded) for r in df.collect())

    got = digests(bpe_decode(bpe_encode(messy, PATH), PATH))
    assert digests(bpe_round_trip(messy, PATH, rows=7)) == got
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), hashlib.sha256(str(ids).encode()).hexdigest(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe_decode(bpe_encode(empty, PATH), PATH).collect() == []


def test_texts_beyond_one_segment(spark, model, library):
    rng = random.Random(9)
    prose = " ".join(rng.choice(["the", "It's", "Straße", "naïve", "1234", "…", "가각", "<|endoftext|>", "a-b"]) for _ in range(60_000))
    unbroken = "".join(rng.choice("etaoin") for _ in range(SEGMENT_CHARS * 2 + 77))
    lines = "\n".join("x" * 997 for _ in range(200))
    texts = [prose, unbroken + " tail " + prose[:SEGMENT_CHARS], lines, " " * (SEGMENT_CHARS * 2), prose[:SEGMENT_CHARS], prose[: SEGMENT_CHARS + 1]]
    assert len(prose) > 4 * SEGMENT_CHARS
    for t in texts:
        _same(model, library, t)
    assert model.encode_batch(texts, at_once=2) == [library.encode(t, add_special_tokens=False).ids for t in texts]
