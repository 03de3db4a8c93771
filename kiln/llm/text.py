"""Whole batches of texts as numpy arrays: words, 64-bit word ids, rolling window hashes.

A word is a maximal run of bytes other than space and TAB..CR (``[^\\x20\\x09-\\x0D]+``).
Hashes are polynomials modulo 2**64 taken from prefix sums, then mixed, so every window of a
batch costs a few vector operations whatever its width.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For comparisons that ignore punctuation: every ASCII byte but letters and digits ends a word.
MARKS = np.ones(256, dtype=bool)
MARKS[128:] = False
MARKS[48:58] = MARKS[65:91] = MARKS[97:123] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd multipliers, one pair (bytes of a word, words of a window) for each independent lane.
LANES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))


#: Bytes of text whose prefix sums are held at a time (a single longer word is held whole).
BLOCK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply, twice)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base, dtype=U64)
    p[0] = 1
    return np.cumprod(p, dtype=U64)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Batch:
    """The words of several texts, end to end.

    ``first[i]:first[i + 1]`` are the words of text i; ``start`` / ``end`` are byte offsets
    into ``data``, where the texts stand one after the other with a line feed between.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, ends: np.ndarray = SPACE):
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        if lower:
            raw = LOWER[raw]
        self.raw = raw
        blank = np.ones(len(raw) + 2, dtype=bool)
        blank[1:-1] = ends[raw]
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)

    def ids(self, lane: int = 0) -> np.ndarray:
        """A 64-bit id for each word; worked out for a bounded number of bytes at a time."""
        base = LANES[lane][0]
        out = np.empty(len(self.start), dtype=U64)
        cut = np.unique(np.append(np.searchsorted(self.start, np.arange(0, len(self.raw), BLOCK_BYTES)), len(self.start)))
        for i, j in zip(cut[:-1], cut[1:]):
            lo, hi = self.start[i], self.end[j - 1]
            n = int(hi - lo)
            prefix = np.zeros(n + 1, dtype=U64)
            np.cumsum((self.raw[lo:hi].astype(U64) + U64(1)) * _powers(base, n)[:n], out=prefix[1:])
            start, end = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = (prefix[end] - prefix[start]) * _powers(_inverse(base), n)[start] + (end - start).astype(U64) * U64(0x2545F4914F6CDD1D)
        return mix(out)

    def windows(self, width: int, lane: int = 0, ids: np.ndarray | None = None) -> np.ndarray:
        """A hash of the ``width`` words from each word on; only those that ``fits`` marks count."""
        ids = self.ids(lane) if ids is None else ids
        n = len(ids)
        if n < width:
            return np.zeros(0, dtype=U64)
        base = LANES[lane][1]
        prefix = np.zeros(n + 1, dtype=U64)
        np.cumsum(ids * _powers(base, n)[:n], out=prefix[1:])
        return mix((prefix[width:] - prefix[:-width]) * _powers(_inverse(base), n)[: n - width + 1])

    def fits(self, width: int) -> np.ndarray:
        """Marks the words from which ``width`` words of the same text follow."""
        n = len(self.start)
        if n < width:
            return np.zeros(0, dtype=bool)
        own = self.owner()
        return own[: n - width + 1] == own[width - 1:]


def pack_planes(values: np.ndarray) -> bytes:
    """64-bit values with their byte planes apart, empty planes left out, so that they compress."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = [k for k in range(8) if planes[k].any()]
    return bytes([sum(1 << k for k in used)]) + b"".join(planes[k].tobytes() for k in used)


def unpack_planes(blob: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``pack_planes``."""
    used = [k for k in range(8) if blob[0] >> k & 1]
    planes = np.zeros((8, n), dtype=np.uint8)
    if used:
        planes[used] = np.frombuffer(blob, dtype=np.uint8, offset=1).reshape(len(used), n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences in byte planes, behind their count."""
    return len(values).to_bytes(8, "little") + pack_planes(np.diff(values, prepend=U64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    """The inverse of ``pack_sorted``."""
    return np.cumsum(unpack_planes(blob[8:], int.from_bytes(blob[:8], "little")), dtype=U64)
