"""Chat formatting as a grammar round trip (operator 8).

Grammar (each turn stands alone, so turns render without knowing their neighbours):

    conversation := turn*
    turn         := "<|im_start|>" role LF text "<|im_end|>" LF

A turn is rendered, parsed again by the deterministic parser below and compared with its source;
while they differ, its content is escaped and it is rendered again. Escaping puts a backslash
behind the ``<`` of every ``<``, backslashes, ``|``; so escaped text holds no control string,
and unescaping takes one backslash away. In a role, ``%``, line ends and ``<`` become ``%XX``.

Rendering, checking and the loss mask work turn by turn where the rows lie. Reading back runs
over each conversation's turns in order, in constant memory: the parser is fed piece by piece
and digests grow as turns come out, so a conversation of any length is never gathered. (One
digest over a whole conversation is sequential by nature; only that part follows a hot
conversation into one task.)

Defined results: NULL role or text is empty; turns are ordered by turn (NULL first), then role,
then text; repeated rows are repeated turns; rows without conv_id form one conversation with a
NULL id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.shared import bounded_batches

START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"[%\r\n<]")


def escape(text: str) -> str:
    return _OPEN.sub(lambda m: "<\\" + m[1] + "|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" + m[1] + "|", text)


class Parser:
    """Recovers (role, text) turns from formatted text that comes in pieces of any size."""

    def __init__(self):
        self.state, self.held, self.role = "between", "", ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.held += piece
        while True:
            if self.state == "between":
                if len(self.held) < len(START):
                    return
                if not self.held.startswith(START):
                    raise ValueError("a turn must begin with its mark")
                self.held, self.state = self.held[len(START):], "role"
            elif self.state == "role":
                at = self.held.find("\n")
                if at < 0:
                    return
                self.role, self.held, self.state = unquote(self.held[:at]), self.held[at + 1:], "text"
            else:
                at = self.held.find(END)
                if at < 0 or len(self.held) <= at + len(END):
                    return
                if self.held[at + len(END)] != "\n" or START in self.held[:at]:
                    raise ValueError("a turn must end with its mark and a line feed")
                text, self.held, self.state = unescape(self.held[:at]), self.held[at + len(END) + 1:], "between"
                yield self.role, text

    def close(self) -> None:
        if self.state != "between" or self.held:
            raise ValueError("the text ends inside a turn")


def parse(formatted: str) -> list[tuple[str, str]]:
    p = Parser()
    out = list(p.feed(formatted))
    p.close()
    return out


def _returns(formatted: str, role: str, text: str) -> bool:
    try:
        return parse(formatted) == [(role, text)]
    except ValueError:
        return False


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its content begins and ends in it."""
    r, t = role, text
    formatted = f"{START}{r}\n{t}{END}\n"
    while not _returns(formatted, role, text):
        if (r, t) != (role, text):
            raise ValueError("escaped content does not come back")  # cannot happen, see the tests
        r, t = _ROLE.sub(lambda m: quote(m[0], safe=""), role), escape(text)
        formatted = f"{START}{r}\n{t}{END}\n"
    return formatted, len(START) + len(r) + 1, len(formatted) - len(END) - 1


def format_turns(conversations: DataFrame, loss_role: str = "assistant", rows: int = 1000) -> DataFrame:
    """Per turn: conv_id, turn, role, text, formatted, loss_start, loss_end (code points in
    ``formatted`` that count for the loss; both 0 for other roles). A conversation's formatted
    text is its turns' in order, end to end."""
    bounded_batches(conversations.sparkSession)
    source = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                  F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, rows):
                part = b.slice(k, rows)
                roles = part.column(2).to_pylist()
                done = [render(r, t) for r, t in zip(roles, part.column(3).to_pylist())]
                masked = [(s, e) if r == loss_role else (0, 0) for r, (_, s, e) in zip(roles, done)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([d[0] for d in done], pa.string()), pa.array([m[0] for m in masked], pa.int64()), pa.array([m[1] for m in masked], pa.int64())],
                    names=["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"])

    return source.mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_end long")


class _Reader:
    """What is read back from one conversation, piece by piece."""

    def __init__(self, conv_id):
        self.conv_id, self.parser = conv_id, Parser()
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, start: int, end: int) -> None:
        self.chars += len(formatted)
        for role, text in self.parser.feed(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        masked = unescape(formatted[start:end])
        self.loss_chars += len(masked)
        self.loss.update(masked.encode())

    def row(self) -> tuple:
        self.parser.close()
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation of ``format_turns``: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, all taken from the formatted text and its mask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            ids, *rest = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, rest)],
                                              names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        now, out = None, []
        for b in batches:
            for conv_id, formatted, start, end in zip(*(b.column(k).to_pylist() for k in range(4))):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.row())
                    now = _Reader(conv_id)
                now.add(formatted, start, end)
            if out:
                yield batch_of(out)
                out = []
        if now is not None:
            yield batch_of([now.row()])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
