"""BPE encoding and decoding as bounded-lookahead streaming transducers (operator 2).

Encoding equals the public ``tokenizers`` library with ``add_special_tokens=False``; decoding
equals its ``decode(ids, skip_special_tokens=False)`` for a file without a decoder (token
strings joined by a space) or with a byte-level one (bytes turned back into text).

**Sufficient lookahead.** Whether merge ``r = (a, b)`` is applied at some place depends, on its
right, only on the symbols of ``b`` and on whether a part of ``b``'s right edge is taken away
first by a merge ``(x, y)`` of higher priority; that again depends on ``y`` and on merges of
still higher priority. Each step strictly lowers the rank, so
``need(r) = |b| + max(need(r') : r' before r, left part of r' on the right edge of b)``
is finite, and the largest ``need`` over the merge list bounds how far right any token can
depend on the text. A run of symbols is therefore read through a window: once that many symbols
follow a token's end, the token is stable and is emitted, and its symbols are forgotten.
Memory per run is one window, however long the run is.

Known difference: the library reorders combining marks by older Unicode tables than Python's
NFC, so two marks in non-canonical order, one of which got its class after Unicode 9, may come
out swapped.

Defined results: NULL text is treated as empty; empty text has no tokens. Rows are handled one
by one, so repeated rows give equal results and extra columns pass through untouched.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.shared import bounded_batches

CACHE_PIECES = 100_000
SHORT = 40
NEVER = 1 << 40
SEGMENT_CHARS = 1 << 16


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies (a fixed public rule):
    printable Latin-1 characters stand for themselves, the others for 256, 257, ... in order."""
    own = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols to the right of a token's end that can still change it."""
    right_part = {a + b: b for a, b in merges}
    ranks_of: dict[str, list[tuple[int, int]]] = {}  # left part -> (rank, largest need so far)
    most = 0
    for rank, (a, b) in enumerate(merges):
        need, edge = 0, b
        while edge is not None:
            if found := ranks_of.get(edge):
                need = max(need, found[-1][1])
            edge = right_part.get(edge) if len(edge) > 1 else None
        need += length(b)
        seen = ranks_of.setdefault(a, [])
        seen.append((rank, max(need, seen[-1][1] if seen else 0)))
        most = max(most, need)
    return most


# Letters and numbers that Unicode 16 added (first and last code point), known to
# the library but not to Python's unicodedata 15.
UNICODE_16_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x113B7), (0x113D1, 0x113D3), (0x116D0, 0x116E3),
    (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139),
    (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FA),
]
# Lower-case forms that Unicode 16 and 17 added.
NEWER_LOWER = ({0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5,
                0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
               | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)})


def newer_letters() -> str:
    """Letters and numbers of the ``regex`` module from after Unicode 16, which the library does
    not know yet, as ranges of a character class."""
    import regex

    known = {c for a, b in UNICODE_16_LETTERS for c in range(a, b + 1)}
    unknown = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn" and c not in known)
    return "".join(f"\\U{ord(run[0]):08X}-\\U{ord(run[-1]):08X}" for found in regex.findall(r"[\p{L}\p{N}]+", unknown)
                   for run in _runs(found))


def _runs(chars: str) -> list[str]:
    out: list[str] = []
    for c in chars:
        if out and ord(out[-1][-1]) + 1 == ord(c):
            out[-1] += c
        else:
            out.append(c)
    return out


class Model:
    """What a tokenizer file says, ready for encoding and decoding."""

    def __init__(self, data: bytes | str, lookahead: int | None = None, newer: str | None = None):
        spec = json.loads(data)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("only plain BPE files are supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(merges)}
        pairs = sorted((a << 32) + b for a, b in self.merges)
        self._pairs = np.array(pairs, dtype=np.int64)
        self._pair_ranks = np.array([self.merges[p >> 32, p & 0xFFFFFFFF][0] for p in pairs], dtype=np.int64)
        self._made = np.array([new for _, new in self.merges.values()], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self._strings = np.full(max(self.token) + 1, None, dtype=object)
        for i, t in self.token.items():
            self._strings[i] = t
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self._steps(spec, newer_letters() if newer is None else newer)
        letters = byte_letters()
        self._inner = [self.vocab.get(c) for c in letters]
        self._final = [self.vocab.get(c + self.suffix) for c in letters]
        self._byte = {c: b for b, c in enumerate(letters)}
        k = len(self.suffix)
        self.lookahead = lookahead or sufficient_lookahead(
            merges, lambda t: len(t) - k if k and t.endswith(self.suffix) else len(t)) + 1
        self.window = max(4 * self.lookahead, 256)
        self._cache: dict[str, list[int]] = {}

    def _steps(self, spec, newer: str) -> None:
        import regex

        norm = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
        kinds = [n["type"] for n in norm.get("normalizers", [norm])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        pre = spec["pre_tokenizer"]
        parts = pre.get("pretokenizers", [pre])
        split = next((p["pattern"]["Regex"] for p in parts if p["type"] == "Split"), None)
        if split is None:
            split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.newer = newer
        self._newer = regex.compile(f"[{newer}]").search if newer else lambda part: None
        self._pieces = regex.compile(split).findall
        older = split
        for kind in (r"\p{L}", r"\p{N}"):
            older = older.replace(kind, f"[{kind}--[{newer}]]")
        self._pieces_newer = regex.compile(older, regex.V1).findall if newer else None
        self._blank_gone = any(p["type"] == "Split" for p in parts)

    # ------------------------------------------------------------------ merging
    def _symbols(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        out = [self._inner[b] for b in data]
        out[-1] = self._final[data[-1]]
        return out

    def _merge(self, ids: list[int]) -> list[int]:
        """Merges applied by rank, the leftmost first: short runs by scanning, others by a heap."""
        merges = self.merges
        if len(ids) <= SHORT:
            while len(ids) > 1:
                best, at, new = 1 << 60, -1, 0
                for i, pair in enumerate(zip(ids, ids[1:])):
                    if (m := merges.get(pair)) and m[0] < best:
                        best, at, new = m[0], i, m[1]
                if at < 0:
                    break
                ids[at:at + 2] = [new]
            return ids
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = new
            gone[j] = True
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (p := before[i]) >= 0 and (m := merges.get((ids[p], new))):
                heapq.heappush(heap, (m[0], p, ids[p], new, m[1]))
        return [x for x, g in zip(ids, gone) if not g]

    def _merge_all(self, runs: list[list[int]]) -> list[list[int]]:
        """The same for many short runs at once: one row each, one merge per row and step."""
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        width = int(size.max())
        ids = np.full((len(runs), width + 1), -1, dtype=np.int64)
        ids[np.arange(width + 1)[None, :] < size[:, None]] = [i for r in runs for i in r]
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        out: list[list[int]] = [[]] * len(runs)
        row, column = np.arange(len(runs)), np.arange(width + 1)[None, :]
        while len(row):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            done = best == NEVER
            if done.any():
                for r, x in zip(row[done].tolist(), ids[done].tolist()):
                    out[r] = x[:x.index(-1)]
                go = ~done
                row, ids, rank, at, best = row[go], ids[go], rank[go], at[go], best[go]
                if not len(row):
                    break
            own = np.arange(len(row))
            move = column + (column > at[:, None])
            move[:, -1] = width  # stays -1
            ids = np.take_along_axis(ids, np.minimum(move, width), axis=1)
            ids[own, at] = self._made[best]
            rank = np.take_along_axis(rank, np.minimum(move[:, :width], width - 1), axis=1)
            rank[:, -1] = NEVER
            rank[own, at] = self._ranks(ids[own, at], ids[own, at + 1])
            left = np.maximum(at - 1, 0)
            rank[own, left] = self._ranks(ids[own, left], ids[own, left + 1])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NEVER where there is no merge."""
        pair = (a << 32) + b
        k = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where((self._pairs[k] == pair) & (b >= 0), self._pair_ranks[k], NEVER)

    def learn(self, pieces: set[str]) -> None:
        """Runs not longer than ``SHORT`` end before a window fills; those not met before are
        merged together and remembered."""
        new = [p for p in pieces.difference(self._cache) if len(p) <= SHORT]
        if len(self._cache) + len(new) > CACHE_PIECES:
            self._cache.clear()
            new = [p for p in pieces if len(p) <= SHORT]
        runs = [self._symbols(p) for p in new]
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        for k in range(0, len(order), 4000):
            part = order[k: k + 4000]
            for i, ids in zip(part, self._merge_all([runs[i] for i in part])):
                self._cache[new[i]] = ids

    def width(self, token_id: int) -> int:
        """Symbols that a token covers."""
        t = self.token[token_id]
        return len(t) - len(self.suffix) if self.suffix and t.endswith(self.suffix) else len(t)

    def run(self, symbols: Iterable[int]) -> Iterator[int]:
        """The transducer: tokens of one run of symbols, each emitted once it is stable."""
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) >= self.window:
                stable, at = len(held) - self.lookahead, 0
                for t in self._merge(list(held)):
                    w = self.width(t)
                    if at + w > stable:
                        break
                    at += w
                    yield t
                del held[:at]
                if not at:  # a single token fills the window: no token is so long, by the vocabulary
                    raise ValueError("window shorter than a token")
        if held:
            yield from self._merge(held)

    def _piece(self, piece: str) -> list[int]:
        return list(self.run(self._symbols(piece)))

    # ------------------------------------------------------------------ texts
    @staticmethod
    def _newer_possible(part: str) -> bool:
        """Whether a code point from U+0540 on occurs; all newer letters lie there."""
        return not part.isascii() and int(np.frombuffer(part.encode("utf-8"), np.uint8).max()) >= 0xD5

    def _segments(self, text: str) -> Iterator[str]:
        """Parts that end behind white space, where no piece, special token or composition runs across."""
        if not self._blank_gone:
            yield text
            return
        at = 0
        while len(text) - at > SEGMENT_CHARS:
            cut = max(text.rfind(" ", at, at + SEGMENT_CHARS), text.rfind("\n", at, at + SEGMENT_CHARS)) + 1
            if not cut:
                found = re.compile(r"[ \n]").search(text, at + SEGMENT_CHARS)
                cut = found.end() if found else len(text)
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _parts(self, text: str) -> Iterator[list[str] | int]:
        """The pieces of each segment; special tokens as their id."""
        for segment in self._segments(text):
            for k, part in enumerate(self._special.split(segment) if self._special else [segment]):
                if k % 2:
                    yield self.special[part]
                    continue
                if self.nfc and not part.isascii():
                    part = unicodedata.normalize("NFC", part)
                high = self._newer_possible(part)
                newer = high and bool(self._newer(part))
                if self.lower:
                    part = part.replace("Σ", "σ").lower()  # capital sigma: letter by letter
                    part = part.translate(NEWER_LOWER) if high else part
                yield (self._pieces_newer if newer else self._pieces)(part)

    def _ids(self, part: list[str] | int) -> list[int]:
        if isinstance(part, int):
            return [part]
        cache = self._cache
        try:
            return list(chain.from_iterable([cache[p] for p in part]))
        except KeyError:  # a run longer than SHORT, or the cache was emptied meanwhile
            self.learn(set(part))
            return [i for p in part for i in (self._cache.get(p) or self._piece(p))]

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in parts."""
        for part in self._parts(text):
            yield self._ids(part)

    def encode_batch(self, texts: Iterable[str | None], at_once: int = 50_000) -> list[list[int]]:
        """The ids of each text; runs are learnt for many texts together."""
        out: list[list[int]] = []
        held, n = [], 0

        def flush():
            self.learn(set(chain.from_iterable(part for _, part in held if not isinstance(part, int))))
            for row, part in held:
                out[row] += self._ids(part)
            held.clear()

        for row, text in enumerate(texts):
            out.append([])
            for part in self._parts(text or ""):
                held.append((row, part))
                n += 1 if isinstance(part, int) else len(part)
                if n >= at_once:
                    flush()
                    n = 0
        flush()
        return out

    def decode(self, ids: Sequence[int]) -> Iterator[str]:
        """Text of ids, in parts: a byte-level file runs a byte-to-text state machine."""
        if not self.byte_level:
            strings = self._strings
            at = np.asarray(ids, dtype=np.int64)
            at = at[(at >= 0) & (at < len(strings))]
            yield " ".join([t for t in strings[at].tolist() if t is not None])
            return
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            t = self.token.get(i)
            if t in self.special:
                yield machine.decode(t.encode("utf-8"))
            elif t is not None:
                yield machine.decode(bytes(self._byte[c] for c in t))
        yield machine.decode(b"", True)


def load(path: str) -> bytes:
    """The tokenizer file as it lies on the driver; executors get it by broadcast."""
    with open(path, "rb") as f:
        return f.read()


def _run(df: DataFrame, path: str, columns: dict[str, tuple[pa.DataType, str]], work, rows: int) -> DataFrame:
    """``df`` with new columns (replaced where they exist) that ``work(model, rows)`` gives for a
    few rows at a time; the model is built once per task from the broadcast file."""
    df = df.drop(*columns)
    bounded_batches(df.sparkSession)
    data = load(path)
    made = Model(data)
    lookahead, newer = made.lookahead, made.newer
    shared = df.sparkSession.sparkContext.broadcast(data)
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value, lookahead, newer)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*part.columns, *work(model, part)], names=[*part.schema.names, *names])
        del model
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    kinds = [F.lit(None).cast(kind).alias(n) for n, (_, kind) in columns.items()]
    return df.mapInArrow(run, df.select("*", *kinds).schema)


IDS, TEXT = (pa.list_(pa.int32()), "array<int>"), (pa.string(), "string")


def _decoded(model: Model, column: pa.Array) -> pa.Array:
    column = column.fill_null([])
    flat, first = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))])
    return pa.array(["".join(model.decode(flat[i:j])) for i, j in zip(first[:-1], first[1:])], pa.string())


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", rows: int = 200) -> DataFrame:
    """``df`` with the token ids (array<int>) of its text; a column of that name is replaced."""
    return _run(df, path, {ids_col: IDS}, lambda model, part: [pa.array(model.encode_batch(part.column(text_col).to_pylist()), IDS[0])], rows)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded", rows: int = 200) -> DataFrame:
    """``df`` with the text of its token ids; NULL ids give empty text, unknown ids nothing. A column
    of that name is replaced."""
    return _run(df, path, {text_col: TEXT}, lambda model, part: [_decoded(model, part.column(ids_col))], rows)


def bpe_round_trip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded",
                   rows: int = 200) -> DataFrame:
    """Both in one pass: ``df`` with the token ids of its text and the text decoded from those ids."""
    def work(model: Model, part: pa.RecordBatch) -> list[pa.Array]:
        ids = pa.array(model.encode_batch(part.column(text_col).to_pylist()), IDS[0])
        return [ids, _decoded(model, ids)]

    return _run(df, path, {ids_col: IDS, decoded_col: TEXT}, work, rows)
