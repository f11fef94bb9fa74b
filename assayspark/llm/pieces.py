"""Tokenizer pieces found by array operations, so that each distinct piece is encoded once.

A byte-pair tokenizer first cuts a text into pieces by a pattern and then encodes each piece alone.
The cuts depend only on the classes of neighbouring characters, so they are found for a block of
texts at once; pieces are told apart by a 64-bit hash, and only new ones go to the encoder.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd

from assayspark.llm.textblocks import PrefixHash, mix

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3

#: The characters of Unicode's White_Space property, and the clitics of the patterns.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CLITICS = ["s", "t", "re", "ve", "m", "ll", "d"]


@cache
def classes() -> np.ndarray:
    """Class of every code point, from the character database."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    first = np.fromiter((ord(unicodedata.category(chr(i))[0]) for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    out[first == ord("L")], out[first == ord("N")] = LETTER, NUMBER
    out[WHITE] = SPACE
    return out


@cache
def scrambled() -> np.ndarray:
    """A hash of every code point."""
    return mix(np.arange(0x110000, dtype=np.uint64), 31)


@dataclass
class Cut:
    """Pieces of a block: piece i is joined[start[i]:end[i]] and belongs to text row[i]."""

    joined: str
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def text(self, i: int) -> str:
        return self.joined[self.start[i] : self.end[i]]


def cut(texts: list[str], spaces: bool) -> Cut:
    """Pieces of the texts.

    With ``spaces``: runs of letters, of numbers or of other signs, each with one space before it
    if there is one, and what white space is left. Without: runs of letters, single numbers and
    runs of other signs; white space is dropped. In both a clitic after an apostrophe that opens a
    piece is a piece of its own.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    n = len(codes)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Cut(joined, none, none, none, none.view(np.uint64))
    kind = classes()[codes]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    if not spaces:
        start[:n] |= kind == NUMBER
    blank = kind == SPACE
    if spaces:
        last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~edge[1:n])  # last blank before ink of the same text
        plain = codes[last] == 32
        start[last] = True
        start[last[plain] + 1] = False
    quote = np.flatnonzero((codes[:-1] == 39) & start[: n - 1] & (kind[1:] == LETTER) & ~edge[1:n]) if n > 1 else np.zeros(0, dtype=np.int64)
    if len(quote):
        follow = codes[np.minimum(quote + 1, n - 1)]
        after = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], codes[np.minimum(quote + 2, n - 1)], 0)
        for clitic in CLITICS:
            hit = follow == ord(clitic[0])
            if len(clitic) == 2:
                hit &= after == ord(clitic[1])
            at = quote[hit]
            start[at + 1] = False
            start[at + 1 + len(clitic)] = True
    first = np.flatnonzero(start[:n])
    end = np.append(first[1:], n)
    if not spaces:
        ink = ~blank[first]
        first, end = first[ink], end[ink]
    row = np.searchsorted(bounds, first, side="right") - 1
    return Cut(joined, first, end, row, PrefixHash(scrambled()[codes]).of(first, end))


class PieceBook:
    """Values of the pieces met so far, one after the other in one array; forgotten when there are many.

    The value of piece i is ``flat[bounds[i] : bounds[i + 1]]``; ``places`` has the i of each of the sorted
    ``keys``. A worker keeps its book between tasks, so it holds arrays, and new pieces are encoded ``AT_ONCE``.
    """

    AT_ONCE = 8192

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 400_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.places = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.bounds = np.zeros(1, dtype=np.int64)

    def _add(self, values: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
        used, more = int(self.bounds[-1]), int(sizes.sum())
        if used + more > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(max(used, more), dtype=np.uint32)])
        self.flat[used : used + more] = np.fromiter(chain.from_iterable(values), dtype=np.uint32, count=more)
        self.bounds = np.concatenate([self.bounds, used + np.cumsum(sizes)])

    def look_up(self, found: Cut) -> np.ndarray:
        """For each piece the number of its value."""
        if len(self.keys) > self.most:
            self.clear()
        codes, uniques = pd.factorize(found.hash)
        place = np.full(len(uniques), -1, dtype=np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, uniques), len(self.keys) - 1)
            place = np.where(self.keys[at] == uniques, self.places[at], -1)
        new = np.flatnonzero(place < 0)
        if len(new):
            first = np.zeros(len(uniques), dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            at = first[new]
            place[new] = len(self.bounds) - 1 + np.arange(len(new))
            for i in range(0, len(new), self.AT_ONCE):
                some = at[i : i + self.AT_ONCE]
                cuts = zip(found.start[some].tolist(), found.end[some].tolist(), strict=True)
                self._add(self.encode([found.joined[a:b] for a, b in cuts]))
            new = new[np.argsort(uniques[new])]
            into = np.searchsorted(self.keys, uniques[new])
            self.keys, self.places = np.insert(self.keys, into, uniques[new]), np.insert(self.places, into, place[new])
        return place[codes]

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the numbers one after the other, and the length of each."""
        begin = self.bounds[index]
        lengths = self.bounds[index + 1] - begin
        shift = begin - (np.cumsum(lengths) - lengths)
        return self.flat[np.arange(int(lengths.sum())) + np.repeat(shift, lengths)], lengths

    def last(self, index: np.ndarray) -> np.ndarray:
        """The last number of each value."""
        return self.flat[self.bounds[index + 1] - 1]


def split_specials(text: str, specials: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(text, -1) and ("", id) in order, where special strings stand in the text."""
    while text:
        at, name = min(((i, s) for s in specials if (i := text.find(s)) >= 0), default=(len(text), ""))
        if at:
            yield text[:at], -1
        if name:
            yield "", specials[name]
        text = text[at + len(name) :]


def runs(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``most`` characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)
