"""Vectorised words, shingles and hashes over Arrow batches of text.

Everything here works on one block of whole texts at a time. A block holds about ``BLOCK_BYTES``
bytes, or a single longer text, so memory follows the block and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 800_000
BLOCK_ROWS = 2048
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = x + np.uint64((seed * _BASE + _BASE) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept per worker up to twice the block size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 2 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


class PrefixHash:
    """Hash of any slice of a sequence in constant time: one wrapping prefix sum."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers(_BASE, len(values)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = powers(_INVERSE, len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * back[start] + (end - start).astype(np.uint64))


_BYTE = mix(np.arange(256, dtype=np.uint64), 11)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]

#: Bytes of folded words: digits, letters and everything outside ASCII.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
#: Bytes of raw words: everything but blanks.
INK_BYTES = np.ones(256, dtype=bool)
INK_BYTES[9:14] = INK_BYTES[32] = False


@dataclass
class Block:
    """Bytes of some texts, their offsets, and where their rows begin in the batch."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES, rows: int | None = BLOCK_ROWS) -> Iterator[Block]:
    """The texts of a string column, null as empty, in blocks of whole texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for begin in range(0, len(column), rows or max(len(column), 1)):
        part = pc.fill_null(column.slice(begin, rows).cast(pa.large_string()), "")
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        first = 0
        while first < len(part):
            last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
            last = min(max(last, first + 1), len(part))
            yield Block(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], begin + first)
            first = last


@dataclass
class Words:
    """Word i spans bytes start[i]:end[i] and belongs to row[i]; row r has words first[r]:first[r + 1]."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def words(block: Block, kind: np.ndarray = WORD_BYTES, folded: bool = True, sums: PrefixHash | None = None) -> Words:
    """Words of every row: runs of the bytes in ``kind``; A-Z count as a-z if folded."""
    inside = kind[block.data]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    edges = block.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    begin[edges] = inside[edges]
    finish[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    first = np.searchsorted(start, block.offsets)
    row = np.repeat(np.arange(block.rows), np.diff(first))
    if sums is None:
        sums = PrefixHash((_FOLDED if folded else _BYTE)[block.data])
    return Words(start, end, row, first, sums.of(start, end))


def raw_sums(block: Block) -> PrefixHash:
    return PrefixHash(_BYTE[block.data])


def grams(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all runs of k words inside one row, and their hashes."""
    n = len(found.row) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = found.hash[:n].copy()
    for j in range(1, k):
        h = h * np.uint64(_BASE) + found.hash[j : n + j]
    at = np.flatnonzero(found.row[:n] == found.row[k - 1 : n + k - 1])
    return at, mix(h[at], k)


def shingles(found: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, times) of the distinct k-word shingles; fewer than k words make one shingle."""
    at, h = grams(found, k)
    row = found.row[at]
    counts = np.diff(found.first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        sums = PrefixHash(found.hash)
        whole = mix(sums.of(found.first[short], found.first[short + 1]), 99)
        row, h = np.concatenate([row, short]), np.concatenate([h, whole])
    if not len(row):
        return row.astype(np.int64), h, np.zeros(0, dtype=np.int64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(row)))


def row_hash(found: Words) -> np.ndarray:
    """Hash of the word sequence of each row; rows without words get 0."""
    out = mix(PrefixHash(found.hash).of(found.first[:-1], found.first[1:]), 7)
    out[np.diff(found.first) == 0] = 0
    return out


def repeated(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (row, hash) pairs: how often each occurs, and whether it occurred before."""
    key = mix(h ^ mix(row.astype(np.uint64), 23), 29)
    codes, uniques = pd.factorize(key)
    counts = np.bincount(codes, minlength=len(uniques))
    again = np.ones(len(codes), dtype=bool)
    first = np.full(len(uniques), len(codes), dtype=np.int64)
    np.minimum.at(first, codes, np.arange(len(codes)))
    again[first[first < len(codes)]] = False
    return counts[codes] if len(codes) else np.zeros(0, dtype=np.int64), again


def largest(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest value of each row, 0 for rows without any."""
    out = np.zeros(len(first) - 1)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(values, first[full])
    return out


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive bounds."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)


class Bitmap:
    """A set of hashes in a fixed number of bits: may hold more than was put in, never less."""

    def __init__(self, bits: int = 24, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(1 << (bits - 3), dtype=np.uint8) if data is None else data

    def _at(self, h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        at = self._at(h)
        np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self._at(h)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
