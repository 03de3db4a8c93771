"""Personal data behind disguises, with offsets kept (operator 13).

Base spans come from four patterns (e-mail addresses, IP addresses, card numbers, telephone
numbers), leftmost and non-overlapping per kind; matches that fail their check are dropped and
not tried again. Each is found in time linear in the text: a mail address from its ``@`` outwards,
an IP address from maximal chains of numbers, and so on.

Disguises are undone by a chain of transducers over the whole text:

1. look-alikes: letters of other scripts, wide and mathematical letters, digits of any script,
   marks that look like ``@ . - +`` or a blank, and the letters O, o, I, l among digits,
2. invisible characters inside words,
3. runs of spelled digits (English, German, French, Spanish; ``double``, ``triple``), single ones
   between digits, and the word ``plus`` before digits,
4. disguised dots: ``(dot)``, ``[.]``, `` dot ``, ``_dot_``, a dot between blanks,
5. disguised ``@``: ``(at)``, ``[@]``, `` at ``, ``_at_``. A bare word counts only where the domain
   behind it has a disguised dot, or the name before it a digit or one of ``. _ % +``; else
   "look at example.com" would be an address.

Each transducer maps places of its output to its input, so a match in the last text has exact
places in the source. A match is added if the source differs from what was matched, if no letter
of another script touches it, and if no base span holds it. Added spans have the kinds of the base
ones; ``found`` says which are disguised and what they read as.

Places count code points, ends exclusive. Defined results: NULL text is empty; a text without spans
has an empty list; repeated rows are repeated results; other columns pass through, and a column of
the output's name is replaced. Work and memory of a task follow the longest single text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.shared import bounded_batches

# Kinds in the order they are listed, and the parts of their patterns.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = range(16, 20), range(8, 16)

Span = tuple[int, int, int]  # number of the kind, start, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = at - len(before) + len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        # a name holds no "@", so nothing before this one belongs to a later address
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for chain in NUMBERS.finditer(text):
        if chain.end() - chain.start() < 7:
            continue
        at, parts = chain.start(), chain[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) in CARD_DIGITS and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if sum(map(str.isdigit, m[0])) in PHONE_DIGITS:
            yield m.span()


def base_spans(text: str) -> list[Span]:
    """The base spans of a text by kind, then start."""
    return [(no, s, e) for no, finder in enumerate((emails, addresses, cards, phones)) for s, e in finder(text)]


# Letters of other scripts that look like Latin ones.
CYRILLIC = dict(zip("АВЕКМНОРСТУХІЈЅаеорсухіјѕԁһԛԝ", "ABEKMHOPCTYXIJSaeopcyxijsdhqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυ", "ABEZHIKMNOPTYXaikvopu"))
SIGNS = {"․": ".", "。": ".", "•": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " "}
INVISIBLE = re.compile("[­᠎​-‏⁠-⁤﻿]+")
PLAIN = re.compile("[A-Za-z0-9@.+() -]")
#: All look-alikes lie behind the Latin letters with marks.
FOREIGN = re.compile("[^\\x00-\\u036f]")


def _lookalikes() -> dict[int, str]:
    """Characters that stand for one plain character: by the tables above, by compatibility (wide,
    mathematical, circled letters and the like), or as a decimal digit of any script."""
    out = {ord(c): to for c, to in {**CYRILLIC, **GREEK, **SIGNS}.items()}
    for low, high in ((0x2000, 0x3400), (0xFE00, 0x10000), (0x1D400, 0x1D800), (0x1F100, 0x1F200)):
        for code in range(low, high):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and PLAIN.match(plain):
                out.setdefault(code, plain)
    for code in [*range(0x80, 0x10000), *range(0x10400, 0x20000)]:
        if (digit := unicodedata.decimal(chr(code), None)) is not None:
            out.setdefault(code, str(digit))
    return out


# Spelled digits by language.
DIGIT_WORDS = [
    "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve"]
SPELLED = {w: str(d) for line in DIGIT_WORDS for d, w in enumerate(line.split())} | {"oh": "0"}
REPEATED = {"double": 2, "triple": 3}

def _any_of(words) -> str:
    """A pattern for one of the words, grouped by first letter."""
    tails: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        tails.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(t)})" for c, t in tails.items()) + ")"


_ONE = rf"(?:{_any_of([f'{r} {w}' for r in REPEATED for w in SPELLED] + list(SPELLED))}\b)"
RUN = re.compile(rf"\b{_ONE}(?:[ ,()-]{{1,3}}{_ONE})*")
#: What stands before and after a single spelled digit that counts.
BEFORE, AFTER = re.compile(r"(?:[0-9][ -]|\+ ?|\bplus )\Z"), re.compile(r"[ -]?\(?[0-9]")
ONE = re.compile(rf"(?:({'|'.join(REPEATED)}) )?({_any_of(SPELLED)})\b")
PLUS = re.compile(r"\bplus {1,2}(?=[0-9(])")
MIDST = re.compile("([0-9(+])([OoIl])(?=[0-9])")
DOT = re.compile(r"[\[({<_ -] {0,2}(?:dot|punto|punkt|point|\.) {0,2}[\])}>_ -]")
AT = re.compile(r"[\[({<_ -] {0,2}(?:at|arroba|@) {0,2}[\])}>_ -]")
#: Longest name that is looked at before a bare "at".
NAME_CHARS = 64


def lowered(text: str) -> str:
    """Lower case, character by character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Rewrite:
    """A text after replacements, with its places mapped back to the text before."""

    def __init__(self, text: str, pieces: list[tuple[int, int, str]]):
        self.start, self.end, self.source = [], [], []
        out, at, length = [], 0, 0
        for s, e, new in pieces:
            length += s - at
            out += [text[at:s], new]
            self.start.append(length)
            length += len(new)
            self.end.append(length)
            self.source.append((s, e))
            at = e
        out.append(text[at:])
        self.text = "".join(out)

    def _place(self, at: int, side: int) -> int:
        """The source place of an output character: where it starts (0) or ends (1)."""
        i = bisect_right(self.start, at) - 1
        if i >= 0 and at < self.end[i]:
            return self.source[i][side]
        return at + side + (self.source[i][1] - self.end[i] if i >= 0 else 0)

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._place(start, 0), self._place(end - 1, 1)

    def within(self, start: int, end: int) -> bool:
        """Whether a replacement ends inside the output's start..end."""
        return bisect_right(self.end, end) > bisect_right(self.end, start)


class Deobfuscator:
    """The transducers with their tables, built once per task."""

    def __init__(self):
        self.table = _lookalikes()

    def plain(self, text: str) -> str:
        """Look-alikes replaced one by one; the length stays."""
        if not text.isascii() and FOREIGN.search(text):
            text = text.translate(self.table)
        return MIDST.sub(lambda m: m[1] + ("0" if m[2] in "Oo" else "1"), text)

    @staticmethod
    def _digits(text: str, low: str) -> list[tuple[int, int, str]]:
        out = []
        for m in RUN.finditer(low):
            words = ONE.findall(m[0])
            s, e = m.span()
            if len(words) > 1 or words[0][0] or (AFTER.match(low, e) and BEFORE.search(low[max(0, s - 6):s])):
                out.append((s, e, "".join(SPELLED[w] * REPEATED.get(times, 1) for times, w in words)))
        return out

    @staticmethod
    def _marks(low: str, pattern: re.Pattern) -> Iterator[tuple[int, int, bool]]:
        """(start, end, bare) of disguised marks: in brackets, blanks around them included, or as a
        bare word between blanks, ``_`` or ``-``."""
        for m in pattern.finditer(low):
            s, e = m.span()
            opened, closed = low[s] in "[({<", low[e - 1] in "])}>"
            if opened and closed:
                s -= sum(low[s - k:s - k + 1] == " " for k in (1, 2) if s >= k and low[s - k:s].isspace())
                e += len(low[e:e + 2]) - len(low[e:e + 2].lstrip(" "))
                yield s, e, False
            elif not opened and not closed and (low[s] == " ") == (low[e - 1] == " ") and low[s - 1:s].isalnum() and low[e:e + 1].isalnum():
                yield s, e, True

    @staticmethod
    def _ats(text: str, low: str, dots: Rewrite | None) -> list[tuple[int, int, str]]:
        out = []
        for s, e, bare in Deobfuscator._marks(low, AT):
            if bare:
                domain = DOMAIN.match(text, e)
                before = text[max(0, s - NAME_CHARS):s]
                name = before[len(before.rstrip(LOCAL)):]
                marked = any(c in "0123456789._%+" for c in name)
                if not (domain and name and (marked or (dots and dots.within(e, domain.end())))):
                    continue
            out.append((s, e, "@"))
        return out

    def stages(self, text: str) -> tuple[str, list[Rewrite]]:
        """The text after all transducers, and those that changed places."""
        done: list[Rewrite] = []
        dots = None
        now = self.plain(text)
        low = lowered(now)
        steps = ((lambda t, w: () if t.isascii() else [(*m.span(), "") for m in INVISIBLE.finditer(t)]), self._digits,
                 (lambda t, w: [(*m.span(), "+") for m in PLUS.finditer(w)] if "plus" in w else ()), (lambda t, w: [(a, b, ".") for a, b, _ in self._marks(w, DOT)]),
                 (lambda t, w: self._ats(t, w, dots)))
        for k, step in enumerate(steps):
            pieces = step(now, low)
            if pieces:
                done.append(Rewrite(now, pieces))
                now = done[-1].text
                low = lowered(now)
                dots = done[-1] if k == 3 else dots
        return now, done

    def spans(self, text: str) -> list[tuple[int, int, int, bool, str]]:
        """(kind, start, end, disguised, value) of a text by kind, start, end."""
        base = base_spans(text)
        out = [(no, s, e, False, text[s:e]) for no, s, e in base]
        now, done = self.stages(text)
        if not done and now == text:
            return out
        held = _Holder(base)
        for no, s, e in base_spans(now):
            value = now[s:e]
            if no == 0 and not re.search(r"\.[A-Za-z]{2,}$", value):
                continue
            if any(c.isalpha() and not c.isascii() for c in (now[s - 1:s], now[e:e + 1])):
                continue
            for stage in reversed(done):
                s, e = stage.back(s, e)
            if text[s:e] != value and not held.holds(s, e):
                out.append((no, s, e, True, value))
        return sorted(out)


class _Holder:
    """Whether a span lies inside one of given spans."""

    def __init__(self, spans: list[Span]):
        self.start, self.reach = [], []
        for s, e in sorted((s, e) for _, s, e in spans):
            self.start.append(s)
            self.reach.append(max(e, self.reach[-1]) if self.reach else e)

    def holds(self, start: int, end: int) -> bool:
        """Spans that start at ``start`` or before reach ``end``; overlapping ones count as one."""
        i = bisect_right(self.start, start) - 1
        return i >= 0 and self.reach[i] >= end


FOUND = "array<struct<kind_no:int,start:bigint,end:bigint,disguised:boolean,value:string,kind:string>>"
_FOUND = pa.list_(pa.struct([("kind_no", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_()), ("value", pa.string()),
                             ("kind", pa.string())]))


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "found", keep_text: bool = True) -> DataFrame:
    """``docs`` with the personal data of each text: ``found``, array<struct(kind_no, start, end,
    disguised, value, kind)> by kind as listed, start, end. Nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(out_col)
    kept = [c for c in docs.columns if keep_text or c != text_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept if c != text_col], F.col(f"`{text_col}`"))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear = Deobfuscator()
        for batch in batches:
            found = [[(no, s, e, hidden, value, KINDS[no]) for no, s, e, hidden, value in clear.spans(t or "")] for t in batch.column(len(names) - 1).to_pylist()]
            columns = [dict(zip(_FOUND.value_type.names, x)) for f in found for x in f]
            ends = pa.array([0, *_running(map(len, found))], pa.int32())
            made = pa.ListArray.from_arrays(ends, pa.array(columns, _FOUND.value_type))
            keep = len(names) - (not keep_text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], made], names=[*names[:keep], out_col])

    kept_rows = rows if keep_text else rows.drop(text_col)
    out = rows.mapInArrow(run, kept_rows.select("*", F.lit(None).cast(FOUND).alias(out_col)).schema)
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{out_col}`"))


def _running(counts) -> Iterator[int]:
    total = 0
    for n in counts:
        total += n
        yield total


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda t: F.concat_ws(":", t["kind"], t["start"], t["end"])), ",")


def masked(docs: DataFrame, text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind; overlapping spans become one,
    named after the first. The other columns and NULL texts stay."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear = Deobfuscator()
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                if text is not None:
                    out, done = [], 0
                    for s, e, no in sorted((s, e, no) for no, s, e, *_ in clear.spans(text)):
                        if s >= done:
                            out += [text[done:s], mark.format(KINDS[no])]
                        done = max(done, e)
                    text = "".join([*out, text[done:]])
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
