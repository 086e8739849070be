"""Words of whole Arrow batches as numpy arrays: code points, word bounds and 64-bit word hashes, without a Python loop over words.

A word is a longest run of letters and digits, in lower case. Hashes are the same in every process.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

#: Code points from here on are unassigned, tags or private use: no letters, no digits.
TOP = 0x33480
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x += ODD
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _chars() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the scrambled code point of its lower case, or 0 if it belongs to no word; and whether it is a letter."""
    text = [chr(i) for i in range(TOP)]
    alnum = np.array([c.isalnum() for c in text])
    lower = np.array([ord(low) if len(low := c.lower()) == 1 else ord(low[0]) for c in text], dtype=np.uint64)
    letter = np.zeros(0x110000, bool)
    letter[:TOP] = [c.isalpha() for c in text]
    value = np.zeros(0x110000, np.uint64)
    value[:TOP] = np.where(alnum, mix(lower) | np.uint64(1), np.uint64(0))
    return value, letter


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD to the powers 0..size, and the inverses, modulo 2**64."""
    up = np.full(size + 1, ODD, np.uint64)
    up[0] = 1
    down = np.full(size + 1, np.uint64(pow(int(ODD), -1, 1 << 64)), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(size).bit_length()))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in one array, and the position where each text begins (one more at the end). Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.string()).fill_null("")
    count = len(texts)
    if not count:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + count + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    begins = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))[at]
    try:
        return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), begins
    except UnicodeDecodeError:
        parts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]
        return np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in parts])))


def letter_mask(points: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    return _chars()[1][points]


@dataclass
class Words:
    """All words of a batch in reading order. start and end are positions in points; row is the text each stands in."""

    points: np.ndarray
    begins: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    rows: int

    def text(self, k: int) -> str:
        return self.points[self.start[k] : self.end[k]].tobytes().decode("utf-32-le").lower()

    def bounds(self) -> np.ndarray:
        """Index of the first word of each row, and the number of words."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each k consecutive words of one text: the index of the first, and their hash."""
        if len(self.hash) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = np.flatnonzero(self.row[k - 1 :] == self.row[: len(self.row) - k + 1])
        out = np.zeros(len(self.hash) - k + 1, np.uint64)
        for j in range(k):
            out *= ODD
            out += self.hash[j : len(self.hash) - k + 1 + j]
        return whole, mix(out[whole])


def words(texts: pa.Array) -> Words:
    points, begins = code_points(texts)
    value = _chars()[0][points]
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = value != 0
    edge = np.diff(inside)
    # a word ends where its text ends
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = begins[1:-1]
    if len(cut):
        cut = np.unique(cut)
        cut = cut[(cut > 0) & (cut < len(points))]
        cut = cut[(value[cut - 1] != 0) & (value[cut] != 0)]
        if len(cut):
            first, last = np.sort(np.concatenate((first, cut))), np.sort(np.concatenate((last, cut)))
    up, down = powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(value * up[: len(points)], out=total[1:])
    hashed = mix((total[last] - total[first]) * down[first])
    row = np.searchsorted(begins, first, side="right") - 1
    return Words(points, begins, first, last, row, hashed, len(begins) - 1)
