"""Vectorised hashes of words and word windows over a whole batch of texts.

All hashes are polynomials modulo 2**64 over the UTF-8 bytes (words) or over
mixed word hashes (windows). They are read off running sums, so the cost per
byte is a few array operations whatever the window; no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
# Odd multipliers of the two hash lanes (fixed values of this library).
BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
SLICE_BYTES = 1 << 20


def byte_class(pattern: str) -> np.ndarray:
    """A lookup of 256 booleans from text of the form ``00-2F 3A-60`` (hexadecimal byte ranges)."""
    table = np.zeros(256, bool)
    for part in pattern.split():
        low, _, high = part.partition("-")
        table[int(low, 16) : int(high or low, 16) + 1] = True
    return table


WHITE_SPACE = byte_class("09-0D 20")
NOT_WORD = byte_class("00-2F 3A-40 5B-60 7B-7F")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64."""
    inverse = pow(base, -1, 1 << 64)
    steps = [np.full(size, b, U64) for b in (base, inverse)]
    for s in steps:
        s[:1] = 1
        np.multiply.accumulate(s, out=s)
    return steps[0], steps[1]


def _power_tables(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    rounded = SLICE_BYTES
    while rounded < size:
        rounded *= 2
    return _powers(base, rounded)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for every span, unmixed."""
    up, down = _power_tables(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * down[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * up[starts]


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text; a longer text is a range of its own."""
    first, size = 0, 0
    lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    for row, n in enumerate(lengths):
        if size and size + n > limit:
            yield first, row
            first, size = row, 0
        size += int(n)
    if first < len(lengths):
        yield first, len(lengths)


class Words:
    """The words of some texts: byte spans, word hashes, and the first word of each text.

    ``first`` has one entry more than there are texts. A null text has no words.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray):
        encoded = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
        # one separator after each text keeps words of neighbours apart
        data = b" ".join([*encoded, b""])
        self.bytes = np.frombuffer(data, np.uint8)
        bounds = np.zeros(len(encoded) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in encoded], out=bounds[1:])
        inside = ~separators[self.bytes]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, bounds)
        self.lengths = np.diff(self.first)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """One mixed 64-bit hash per word."""
        plain = span_hashes(self.bytes.astype(U64) + U64(1), self.starts, self.ends, BYTE_BASES[lane])
        return mix(plain + (self.ends - self.starts).astype(U64))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)


def window_hashes(words: np.ndarray, first: np.ndarray, size: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first word of the window, Rabin-Karp hash) of every run of ``size`` words that stays inside its text."""
    room = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
    starts = np.flatnonzero(room >= size)
    return starts, mix(span_hashes(words, starts, starts + size, WORD_BASES[lane]))


def sequence_hashes(words: np.ndarray, first: np.ndarray, lane: int = 0) -> np.ndarray:
    """One hash per text over all its words; texts without words share one value."""
    plain = span_hashes(words, first[:-1], first[1:], WORD_BASES[lane])
    return mix(plain + np.diff(first).astype(U64))


def as_long(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return np.ascontiguousarray(values).view(np.int64)
