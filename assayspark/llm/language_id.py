"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of some labelled text knows every string in it. A text is cut
greedily into the longest phrases that the automaton knows; a sign that it does not know is a
phrase of its own. The language that needs the fewest phrases for the length of the text wins.

Learning takes about ``SAMPLE`` signs of labelled texts per language, fewer if there are very many
languages, whole texts in the order of a hash. Texts longer than ``EASY`` code points are only
used, then their beginning, where a language has no shorter one: that is a limit on learning alone.
Parsing covers whole texts: a block of texts is cut into rows of ``STRIP`` signs, and all rows and
all languages take one step at a time, so a long text costs no more than many short ones. Parsing
starts anew with each strip.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any labels
every text is ``und``; ties go to the first language in alphabetical order; repeated rows get
equal results; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.llm import pieces as pc
from assayspark.llm.shared import append_columns, crc_mod, query, table

SAMPLE = 20_000
STATES = 400_000
EASY = 8_000
STRIP = 256
BLOCK_CHARS = 400_000
NONE = "und"


def signs(text: str) -> np.ndarray:
    """Code points of the lower-cased text; every run of anything but letters is one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = pc.classes()[codes] == pc.LETTER
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, codes, 32)[keep] if len(codes) else codes


class Automaton:
    """Suffix automaton of a string of small integers."""

    def __init__(self, sequence: list[int]):
        self.next: list[dict[int, int]] = [{}]
        length, link, last = [0], [-1], 0
        for c in sequence:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new


@dataclass
class Parser:
    """All automata in one transition table; roots[i] is where language i begins."""

    languages: list[str]
    alphabet: np.ndarray
    table: np.ndarray
    roots: np.ndarray

    @classmethod
    def learn(cls, samples: dict[str, list[str]], size: int = SAMPLE) -> Parser:
        languages = sorted(samples)
        texts = {k: np.concatenate([signs(t + "\n") for t in v])[:size] for k, v in samples.items()}
        alphabet = np.unique(np.concatenate([[32], *texts.values()]).astype(np.uint32))
        blocks, roots, first = [], [], 0
        for language in languages:
            own = Automaton(np.searchsorted(alphabet, texts[language]).tolist()).next
            rows = np.full((len(own), len(alphabet) + 1), -1, dtype=np.int32)  # the last column: unknown signs
            for i, follow in enumerate(own):
                for c, to in follow.items():
                    rows[i, c] = first + to
            blocks.append(rows)
            roots.append(first)
            first += len(own)
        return cls(languages, alphabet, np.concatenate(blocks), np.array(roots, dtype=np.int32))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each text (rows) for each language (columns)."""
        count = np.array([-(-len(t) // STRIP) for t in texts], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), count)
        grid = np.full((len(owner), STRIP), -1, dtype=np.int64)
        if len(owner):
            flat = np.concatenate(texts)
            at = np.searchsorted(self.alphabet, flat)
            at[at == len(self.alphabet)] = 0
            code = np.where(self.alphabet[at] == flat, at, len(self.alphabet))
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            inside = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            strip = np.repeat(np.cumsum(count) - count, lengths) + inside // STRIP
            grid[strip, inside % STRIP] = code
        order = np.argsort(-(grid >= 0).sum(axis=1), kind="stable")
        steps = np.ascontiguousarray(grid[order].T)
        active = (steps >= 0).sum(axis=1)
        roots = self.roots[:, None]
        state = np.repeat(roots, len(owner), axis=1)
        total = np.zeros(state.shape, dtype=np.int64)
        for c, n in zip(steps, active.tolist(), strict=True):
            if not n:
                break
            c, now = c[:n], state[:, :n]
            to = self.table[now, c]
            fresh = self.table[roots, c]
            failed = to < 0
            unknown = failed & (fresh < 0)
            total[:, :n] += (failed & (now != roots)).astype(np.int64) + unknown
            state[:, :n] = np.where(failed, np.where(unknown, roots, fresh), to)
        total += state != roots
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        np.add.at(out, owner[order], total.T)
        return out


def fit_languages(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text", sample: int = SAMPLE) -> Parser | None:
    """A parser from the labelled rows for which ``learn`` holds; no labels, no parser.

    Rows are counted per language first, so that about enough of them for the sample are read.
    """
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    short = F.char_length(text) <= EASY
    counts = known.groupBy(lang).agg(F.count("*").alias("n"), F.count_if(short).alias("n_short"), F.sum(
        F.when(short, F.char_length(text))).alias("size")).collect()
    if not counts:
        return None
    sample = max(200, min(sample, STATES // (2 * len(counts))))
    place = F.pmod(F.xxhash64(text), F.lit(1_000_000))
    wanted = F.lit(False)
    for r in counts:
        need = 3 * sample / max(r["size"] or 1, 1) if r["n_short"] else 3 / r["n"]
        here = F.col(lang) == r[lang]
        wanted = wanted | (here & (place < max(1, int(min(1.0, need + 20 / r["n"]) * 1_000_000))) & (short if r["n_short"] else F.lit(True)))
    rows = known.where(wanted).select(lang, F.substring(text, 1, EASY).alias("t"), F.xxhash64(text).alias("h")).distinct().collect()
    samples: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r["h"], r["t"])):
        if sizes.get(r[lang], 0) < sample:
            samples.setdefault(r[lang], []).append(r["t"])
            sizes[r[lang]] = sizes.get(r[lang], 0) + len(r["t"])
    return Parser.learn(samples, sample) if samples else None


def identify(docs: DataFrame, parser: Parser | None, text: str = "text") -> tuple[DataFrame, list[str]]:
    """The documents with language and score, and the names of the two columns.

    The score is the winner's share when every phrase more than the best halves a language's weight.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(column: pa.Array) -> list[pa.Array]:
        own = shared.value
        texts = [t or "" for t in column.to_pylist()]
        names, scores = [], []
        for a, b in pc.runs(texts, BLOCK_CHARS):
            found = [signs(t) for t in texts[a:b]]
            if own is None:
                names += [NONE] * (b - a)
                scores.append(np.zeros(b - a))
                continue
            n = own.phrases(found)
            best = n.argmin(axis=1)
            weight = 0.5 ** np.minimum(n - n.min(axis=1, keepdims=True), 60)
            empty = np.array([len(t) == 0 for t in found])
            names += [NONE if e else own.languages[i] for e, i in zip(empty.tolist(), best.tolist(), strict=True)]
            scores.append(np.where(empty, 0.0, 1 / weight.sum(axis=1)))
        return [pa.array(names, pa.string()), pa.array(np.concatenate(scores))]

    return append_columns(docs, text, {"lang_pred": "string", "score": "double"}, run)


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    parser = fit_languages(docs, crc_mod("doc_id", 4) != 2)
    out, (name, score) = identify(docs.select("doc_id", "text"), parser)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col(name).alias("lang_pred"), F.col(score).alias("score"))
