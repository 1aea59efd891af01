"""Words and their fingerprints over whole Arrow batches, by NumPy on the UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D; those bytes never occur
inside a longer UTF-8 sequence, so this equals the regex ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = SEPARATOR.copy()
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def unused(columns: list[str], stem: str = "_x") -> str:
    """A beginning of column names that none of these has, in either case."""
    while any(c.lower().startswith(stem) for c in columns):
        stem += "_"
    return stem


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random_u64(n: int, seed: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


@lru_cache(4)
def byte_table(seed: int) -> tuple[np.ndarray, int, int]:
    """A random value per byte, an odd multiplier and its inverse modulo 2**64."""
    mult = int(random_u64(1, seed + 7919)[0]) | 5
    return random_u64(256, seed), mult, pow(mult, -1, 1 << 64)


_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get((base, 0))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, U64)
        have[0] = 1
        have = _powers[base, 0] = np.multiply.accumulate(have)
    return have[:n]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins. A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``most`` bytes of text each; one longer text stands alone. Work on a slice
    takes some hundred bytes of memory for each of these."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    lo = 0
    ends = np.cumsum(sizes)
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


class Words:
    """Words of a column of texts.

    start, end: byte spans; doc: for each text, the number of its first word
    (one more entry than texts). ``hash(seed)`` gives 64-bit word fingerprints.
    ``punctuation``: ASCII punctuation separates words as well; ``separators``: these bytes do, in place of white space.
    """

    def __init__(self, column: pa.Array, lower: bool = False, punctuation: bool = False, separators: np.ndarray | None = None):
        self.data, self.at = raw(column)
        if lower:
            self.data = LOWER[self.data]
        if separators is None:
            separators = PUNCTUATION if punctuation else SEPARATOR
        word = ~separators[self.data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = self.at[1:-1]
        inner = inner[(inner > 0) & (inner < len(word))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.start, self.at)
        self.n = np.diff(self.doc)

    def sums(self, seed: int) -> np.ndarray:
        table, mult, _ = byte_table(seed)
        out = np.empty(len(self.data) + 1, U64)
        out[0] = 0
        np.cumsum(table[self.data] * powers(mult, len(self.data)), out=out[1:])
        return out

    def hash(self, seed: int = 1, *, prefixes: tuple[int, ...] = ()) -> np.ndarray | list[np.ndarray]:
        """Fingerprints of the words; with ``prefixes`` also of their first bytes, for each of these lengths."""
        inverse, sums = byte_table(seed)[2], self.sums(seed)
        back = powers(inverse, len(self.data))[self.start]
        out = []
        for length in (None, *prefixes):
            end = self.end if length is None else np.minimum(self.end, self.start + length)
            value = (sums[end] - sums[self.start]) * back
            out.append(mix64(value + (end - self.start).astype(U64) * U64(0x9E3779B97F4A7C15)))
        return out if prefixes else out[0]

    def owner(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.n)), self.n)


def windows(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``size`` words inside one text, and the number of each one's first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(n, U64)
    for k in range(size):
        out = out * U64(0xD6E8FEB86659FD93) + words[k : k + n]
    whole = np.ones(n, bool)
    for back in range(1, size):  # a window may not run over the first word of a later text
        cut = doc[1:-1] - back
        whole[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(whole)
    return mix64(out[at]), at
