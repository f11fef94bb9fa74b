"""Statistics of whole documents, computed for a block of texts at once."""

from __future__ import annotations

import numpy as np

from assayspark.llm import textblocks as tb

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".?")] = True
_BANG = np.zeros(256, dtype=bool)
_BANG[33] = True
_COMMA = np.zeros(256, dtype=bool)
_COMMA[list(b",;:")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]


def line_table(block: tb.Block, sums: tb.PrefixHash, ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, again, first) of the lines that hold a word; bounds of the rows' lines."""
    breaks = block.data == 10
    start = np.union1d(np.flatnonzero(breaks) + 1, block.offsets[:-1])
    start = start[start < len(block.data)]
    end = np.append(start[1:], len(block.data))[: len(start)]
    end = end - breaks[end - 1]
    has_word = tb.per_row(ink, np.append(start, len(block.data))) > 0 if len(start) else np.zeros(0, bool)
    start, end = start[has_word], end[has_word]
    row = np.searchsorted(block.offsets, start, side="right") - 1
    h = sums.of(start, end)
    _, again = tb.repeated(row, h)
    return row, h, again, np.searchsorted(row, np.arange(block.rows + 1))


def base_counts(block: tb.Block) -> dict[str, np.ndarray]:
    """Counts per text: raw words, their characters, symbols, repeated lines and repeated words."""
    data, bounds = block.data, block.offsets
    sums = tb.raw_sums(block)
    found = tb.words(block, tb.INK_BYTES, sums=sums)
    ink = tb.INK_BYTES[data]
    at, h = tb.grams(found, 5)
    times, _ = tb.repeated(found.row[at], h)
    hot = np.zeros(len(found.row) + 5, dtype=np.int64)
    where = at[times > 1]
    np.add.at(hot, where, 1)
    np.add.at(hot, where + 5, -1)
    covered = np.cumsum(hot)[: len(found.row)] > 0
    _, _, again, lines = line_table(block, sums, ink)
    lead = (data & 0xC0) != 0x80
    return {
        "n_words": np.diff(found.first),
        "word_chars": tb.per_row(ink & lead, bounds),
        "n_symbols": tb.per_row(SYMBOLS[data], bounds),
        "n_dup_lines": tb.per_row(again, lines),
        "n_repeat_words": tb.per_row(covered, found.first),
        "n_lines": np.diff(lines),
        "n_upper": tb.per_row(_UPPER[data], bounds),
        "n_letters": tb.per_row((_UPPER | _LOWER)[data] | (data >= 0xC0), bounds),
    }


FEATURES = [
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "words_per_line", "upper_share",
    "digit_share", "stop_share", "bang_share", "comma_share", "ink_share", "distinct_share", "word_spread",
    "longest_word", "top_word_share", "non_ascii_share", "pipe_share", "symbol_ends", "dup_gram_share",
]


def features(block: tb.Block) -> np.ndarray:
    """One row of ``FEATURES`` per text: shares and logarithms, all finite; an empty text is all zero."""
    data, bounds = block.data, block.offsets
    n = base_counts(block)
    chars = np.maximum(tb.per_row((data & 0xC0) != 0x80, bounds), 1)
    words = np.maximum(n["n_words"], 1)
    letters = np.maximum(n["n_letters"], 1)
    found = tb.words(block)
    length = (found.end - found.start).astype(np.float64)
    count = np.maximum(np.diff(found.first), 1)
    mean = tb.per_row(found.end - found.start, found.first) / count
    square = np.zeros(len(length) + 1)
    np.cumsum(length * length, out=square[1:])
    spread = np.sqrt(np.maximum((square[found.first[1:]] - square[found.first[:-1]]) / count - mean * mean, 0))
    longest = tb.largest(length, found.first)
    times, again = tb.repeated(found.row, found.hash)
    top = tb.largest(times, found.first)
    at, h = tb.grams(found, 3)
    grams, _ = tb.repeated(found.row[at], h)
    dup = np.bincount(found.row[at], weights=grams > 1, minlength=block.rows)
    ends = data.copy()
    closing = np.zeros(len(data), dtype=bool)
    if len(data):
        ink = tb.INK_BYTES[data]
        closing[:-1] = ink[:-1] & ~ink[1:]
        closing[-1] = ink[-1]
        closing &= SYMBOLS[ends]
    return np.column_stack([
        np.log1p(n["n_words"]), n["word_chars"] / words, n["n_symbols"] / chars,
        n["n_dup_lines"] / np.maximum(n["n_lines"], 1), n["n_repeat_words"] / words,
        np.log1p(words / np.maximum(n["n_lines"], 1)), n["n_upper"] / letters,
        tb.per_row(_DIGIT[data], bounds) / chars, tb.per_row(_STOP[data], bounds) / words,
        tb.per_row(_BANG[data], bounds) / words, tb.per_row(_COMMA[data], bounds) / words,
        n["word_chars"] / chars, 1 - tb.per_row(again, found.first) / count, spread,
        np.log1p(longest), top / count, tb.per_row(data >= 0xC0, bounds) / chars,
        tb.per_row(data == 124, bounds) / words, tb.per_row(closing, bounds) / words, dup / count,
    ]).astype(np.float32)
