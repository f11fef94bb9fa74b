"""Exact token counts of a byte-pair tokenizer at every prefix, by dynamic programming.

A sequence of tokens is what the tokenizer would give if every two neighbours are what it gives
for their own characters. So the encoding of each prefix follows from that of a shorter one and
one more token whose pair with the last token is valid:

    count[p] = count[q] + 1   for the only token s[q:p] that is valid after last[q]

A word's last token carries an end mark. Every prefix is therefore also closed once: with tokens
that carry the mark, after the open prefix before them. The closed counts of a piece, put on top
of the counts of the pieces before it, give the count at every prefix of the text, so truncation
and budgets need no further encoding.

Counts are those of the library: composed and lower-cased text, white space dropped, special
strings in a text one token each. Defined cases: null texts are empty and have no tokens; a prefix
is one of the normalised text; repeated rows are counted alike; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.llm import pieces as pc
from assayspark.llm.shared import append_columns, query, table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
BLOCK_CHARS = 1_200_000
PIECES = 300_000


def byte_letters() -> str:
    """The printable letter that stands for each byte: its own where it has one, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return "".join(chr(b) if b in own else chr(256 + others.index(b)) for b in range(256))


def normalised(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
    return text.lower()


class PrefixCounter:
    """Counts for pieces and texts; what has been learnt stays for the next texts of the worker."""

    def __init__(self, path: str, mark: str = "</w>"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        self.mark = mark
        self.ranks = {tuple(m) if not isinstance(m, str) else tuple(m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in vocabulary.items()}
        self.open = {t: i for t, i in vocabulary.items() if not t.endswith(mark) and t not in self.specials}
        self.closed = {t[: -len(mark)]: i for t, i in vocabulary.items() if t.endswith(mark)}
        self.longest = max(map(len, [*self.open, *self.closed]))
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.valid: dict[tuple[int, int], bool] = {}
        self.book = pc.PieceBook(lambda texts: [self.piece(t) for t in texts], PIECES)

    def _symbols(self, token: int) -> list[str]:
        name = self.names[token]
        if name.endswith(self.mark):
            body = name[: -len(self.mark)]
            return [*body[:-1], body[-1] + self.mark]
        return list(name)

    def _merge(self, symbols: list[str]) -> list[str]:
        """The tokenizer's merges on a short list of symbols, lowest rank first."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.ranks.get((symbols[i], symbols[i + 1]), 1 << 30))
            pair = (symbols[best], symbols[best + 1])
            if pair not in self.ranks:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may stand after ``last``; -1 is the start of a word."""
        known = self.valid.get((last, token))
        if known is None:
            before = [] if last < 0 else [self.names[last]]
            symbols = ([] if last < 0 else self._symbols(last)) + self._symbols(token)
            known = self._merge(symbols) == [*before, self.names[token]]
            self.valid[(last, token)] = known
        return known

    def piece(self, piece: str) -> list[int]:
        """Tokens of each prefix of one piece, by code points."""
        raw = piece.encode("utf-8", "surrogatepass")
        s = raw.decode("latin-1").translate(self.letters)
        n = len(s)
        count, last, out = [0] * (n + 1), [-1] * (n + 1), []
        valid, open_get, closed_get = self.valid, self.open.get, self.closed.get
        for p in range(1, n + 1):
            low = p - self.longest if p > self.longest else 0
            for q in range(low, p):
                t = open_get(s[q:p])
                if t is not None:
                    ok = valid.get((last[q], t))
                    if self.follows(last[q], t) if ok is None else ok:
                        count[p], last[p] = count[q] + 1, t
                        break
            if p == n or raw[p] & 0xC0 != 0x80:
                for q in range(low, p):
                    t = closed_get(s[q:p])
                    if t is not None:
                        ok = valid.get((last[q], t))
                        if self.follows(last[q], t) if ok is None else ok:
                            out.append(count[q] + 1)
                            break
        if len(piece) == 3 and piece[0] == "'" and piece[1:] in pc.CLITICS:
            out[1] = out[0] + self.piece(piece[1])[-1]  # half a clitic is an apostrophe and a letter
        return out

    def _cut(self, texts: list[str]) -> tuple[pc.Cut, np.ndarray, np.ndarray, list[str]]:
        """Pieces of the texts between special strings, their numbers, owner and special of each part, and the parts."""
        if any(s in t for t in texts for s in self.specials):
            parts = [(i, p, special) for i, t in enumerate(texts) for p, special in pc.split_specials(t, self.specials)]
        else:
            parts = [(i, t, -1) for i, t in enumerate(texts)]
        own = [normalised(p) for _, p, _ in parts]
        found = pc.cut(own, spaces=False)
        index = self.book.look_up(found)
        return found, index, np.array([[i, s] for i, _, s in parts], dtype=np.int64).reshape(-1, 2), own

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each whole text."""
        found, index, parts, _ = self._cut(texts)
        out = np.bincount(parts[found.row, 0], weights=self.book.last(index), minlength=len(texts)) if len(index) else np.zeros(len(texts))
        return (out + np.bincount(parts[:, 0], weights=parts[:, 1] >= 0, minlength=len(texts))).astype(np.int64)

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of the first 0, 1, 2 ... code points of the normalised text; a special string counts at its end."""
        found, index, parts, own = self._cut([text])
        out, base = [np.zeros(1, dtype=np.int64)], 0
        for k, (part, special) in enumerate(zip(own, parts[:, 1].tolist(), strict=True)):
            if special >= 0:
                name = next(s for s, i in self.specials.items() if i == special)
                steps = np.full(len(name), base)
                steps[-1] = base + 1
            else:
                steps = np.zeros(len(part) + 1, dtype=np.int64)
                set_at = np.zeros(len(part) + 1, dtype=np.int64)
                offset = sum(len(x) for x in own[:k])
                before = 0
                for i in np.flatnonzero(found.row == k).tolist():
                    a, b = found.start[i] - offset + 1, found.end[i] - offset + 1
                    steps[a:b] = before + self.book.gather(index[i : i + 1])[0].astype(np.int64)
                    set_at[a:b] = np.arange(a, b)
                    before = steps[b - 1]
                steps = base + steps[np.maximum.accumulate(set_at)][1:]  # white space repeats the last count; a longer piece may have fewer tokens
            if len(steps):
                base = int(steps[-1])
            out.append(steps)
        return np.concatenate(out)


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def longest_prefix(prefix_counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix within the budget."""
    return int(np.flatnonzero(prefix_counts <= budget)[-1])


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None) -> tuple[DataFrame, str]:
    """The documents with the exact token count of every whole text, and the name of that column."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(texts: pa.Array) -> list[pa.Array]:
        own, values = counter(path), [t or "" for t in texts.to_pylist()]
        return [pa.array(np.concatenate([own.counts(values[a:b]) for a, b in pc.runs(values, BLOCK_CHARS)]), pa.int64())]

    out, names = append_columns(docs, text, {"n_tokens": "bigint"}, run)
    return out, names[0]


def prefix_table(docs: DataFrame, text: str = "text", path: str | None = None) -> tuple[DataFrame, str]:
    """The documents with the token count at every prefix of the normalised text, as an array."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(texts: pa.Array) -> list[pa.Array]:
        own = counter(path)
        return [pa.array([own.prefixes(t or "").astype(np.int32) for t in texts.to_pylist()], pa.list_(pa.int32()))]

    out, names = append_columns(docs, text, {"prefix_tokens": "array<int>"}, run)
    return out, names[0]


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted, n = count_tokens(docs)
    return counted.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col(n).alias("n_tokens"),
        (F.col(n) > LIMIT).alias("over_limit"))
