"""Words, hashes and shingles of a batch of texts, computed on its UTF-8 bytes with numpy.

Everything works on slices of about ``SLICE`` or ``WORDS_AT_ONCE`` bytes (a longer text is a slice of its own), so the
memory needed does not depend on the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
#: Bytes whose words are hashed at once: the arrays of 64-bit numbers for them stay in the processor's cache.
WORDS_AT_ONCE = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)

#: A-Z to a-z; all other bytes stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of the bytes that separate words; ``ranges`` are inclusive."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Fixed value: separators of the pattern [^\x20\x09-\x0D]+.
SPACE = separators((9, 13), (32, 32))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base or of its inverse modulo 2**64; a table that grows by need."""
    if len(_powers[kind]) < n:
        factors = np.full(max(n, SLICE), _BASE if kind == "up" else _INVERSE, np.uint64)
        factors[0] = 1
        _powers[kind] = np.cumprod(factors, dtype=np.uint64)
    return _powers[kind][:n]


@dataclass
class Words:
    """Words of some texts, in order. ``doc`` counts from 0 in the slice, ``first[d]`` is the
    index of the first word of text d, ``start`` and ``end`` are bytes of ``body``, ``base`` is
    the byte where each text begins."""

    body: np.ndarray
    base: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    rows: slice

    @property
    def n_docs(self) -> int:
        return len(self.base) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        return span_hashes(self.body, self.start, self.end)


def _sums_between(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power("up", n), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power("down", n + 1)[start] + (end - start).astype(np.uint64))


def span_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``body[start:end]``; equal content gives an equal hash wherever it is."""
    return _sums_between(_TABLE[body], start, end)


def run_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of words ``start:end`` from the hashes of the words."""
    return _sums_between(hashes, start, end)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, a null being empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, bytes and offsets of consecutive texts of about ``size`` bytes together."""
    data, offsets = text_buffers(column)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield slice(row, end), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(column: pa.Array, separator: np.ndarray = SPACE, fold: np.ndarray = FOLD, size: int = WORDS_AT_ONCE) -> Iterator[Words]:
    """Maximal runs of bytes that are no separators, after folding; one ``Words`` for each slice."""
    for rows, data, base in slices(column, size):
        body = fold[data]
        gap = np.ones(len(body) + 1, bool)
        gap[:-1] = separator[body]
        begins = ~gap[:-1]
        ends = begins.copy()
        inner = base[1:-1]
        inside = begins[1:] & ~gap[:-2]
        cut = np.zeros(len(body) + 1, bool)
        cut[inner] = True
        begins[1:] &= ~inside | cut[1:-1]
        ends[:-1] &= gap[1:-1] | cut[1:-1]
        start = np.flatnonzero(begins)
        end = np.flatnonzero(ends) + 1
        doc = np.searchsorted(base, start, "right") - 1
        first = np.searchsorted(start, base, "left")
        yield Words(body, base, start, end, doc, first, rows)


def shingles(hashes: np.ndarray, doc: np.ndarray, counts: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of every run of ``size`` words; a text of fewer words, but not
    none, is one run. In text order."""
    n = len(hashes)
    whole = max(0, n - size + 1)
    code = np.zeros(whole, np.uint64)
    factor = 1
    for j in range(size):
        code += hashes[j : j + whole] * np.uint64(factor)
        factor = factor * _BASE % (1 << 64)
    inside = doc[:whole] == doc[size - 1 :] if whole else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    code = mix(code[at])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        factor = 1
        for j in range(size - 1):
            has = counts[short] > j
            extra[has] += hashes[first[short[has]] + j] * np.uint64(factor)
            factor = factor * _BASE % (1 << 64)
        at = np.concatenate([at, first[short]])
        code = np.concatenate([code, mix(extra + counts[short].astype(np.uint64) * _ODD)])
        order = np.argsort(at, kind="stable")
        at, code = at[order], code[order]
    return code, doc[at], at
