"""Licence scan with a positional index of rare tokens.

Licence templates are short notices with mandatory key phrases. The index has one posting per phrase:
its word of highest IDF, its place in the phrase and in the template, and the word of next highest IDF
as a check at a fixed distance. A scan finds a file's licence words, looks up those that are some
phrase's rarest, and intersects by relative position: the second word must stand at its distance, then
the whole phrase, then the other mandatory phrases of the template at their places (``SLACK`` words
apart from them at most, for inserted names). Every phrase that stands in a file holds its rarest word
there, so the look-up misses none and long files are scanned as whole texts.

IDF = ln((N + 1) / (df + 0.5)) over all documents; only template words are counted, summed per task
first. Index and IDF follow the templates in size, not the corpus, and are all that is broadcast.

A matched template scores the IDF share of its words that stand in place around its first phrase; a
document has the score of its best match, 0 without one. Defined cases: null and empty texts, and
texts without words, have no labels; overlapping phrases count each; repeated rows get equal results;
a label in both lists counts once; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.llm import textblocks as tb
from assayspark.llm.shared import query, table

SLACK = 8


@dataclass(frozen=True)
class Template:
    """A notice in folded words and its mandatory phrases, each a part of the notice."""

    label: str
    words: str
    phrases: tuple[str, ...]
    base: bool = False


#: Phrases and labels that every scan reports with their places.
BASE = (
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
)
#: The usual notices of public licences.
NOTICES = (
    Template("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("artistic", "under the terms of the artistic license", ("artistic license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("bsd", "released under the bsd license", ("bsd license",)),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "creative commons attribution noncommercial", ("creative commons attribution noncommercial",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "creative commons attribution sharealike", ("creative commons attribution sharealike",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("public domain dedication",)),
    Template("epl", "eclipse public license v 2 0", ("eclipse public license",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("proprietary", "this file is proprietary and confidential", ("proprietary and confidential",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("provided as is without any express or implied warranty", "in no event will the authors be held liable")),
)
TEMPLATES = BASE + NOTICES


def _hashes(words: str) -> np.ndarray:
    """Hashes of the words of one text."""
    return tb.words(next(tb.blocks(pa.array([words])))).hash


class Index:
    """Templates as numbers into a sorted vocabulary, and postings by rarest word."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = tuple(templates)
        split = [_hashes(t.words) for t in self.templates]
        self.vocabulary = np.unique(np.concatenate(split)) if split else np.zeros(0, np.uint64)
        self.words = [np.searchsorted(self.vocabulary, s) for s in split]
        self.idf = np.zeros(len(self.vocabulary))
        self.offsets: list[list[int]] = []
        self.lengths: list[list[int]] = []
        for t, words in zip(self.templates, self.words, strict=True):
            found = []
            for phrase in t.phrases:
                own = np.searchsorted(self.vocabulary, _hashes(phrase))
                places = [i for i in range(len(words) - len(own) + 1) if (words[i : i + len(own)] == own).all()]
                if not places:
                    raise ValueError(f"the notice of {t.label} does not hold its phrase {phrase!r}")
                found.append((places[0], len(own)))
            self.offsets.append([o for o, _ in found])
            self.lengths.append([n for _, n in found])

    def weigh(self, n_documents: int, df: np.ndarray) -> Index:
        """Postings by the corpus's IDF: word -> (template, phrase, its place in the phrase, second word's place)."""
        self.idf = np.log((n_documents + 1) / (df + 0.5))
        self.postings: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            for p, (offset, length) in enumerate(zip(self.offsets[t], self.lengths[t], strict=True)):
                rare = np.argsort(-self.idf[words[offset : offset + length]], kind="stable")
                self.postings[int(words[offset + rare[0]])].append((t, p, int(rare[0]), int(rare[min(1, length - 1)])))
        return self

    def of(self, found: tb.Words) -> np.ndarray:
        """Vocabulary number of every word, -1 for others."""
        if not len(self.vocabulary):
            return np.full(len(found.hash), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, found.hash), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == found.hash, at, -1)


def phrase_places(index: Index, number: np.ndarray, found: tb.Words) -> dict[tuple[int, int], np.ndarray]:
    """(template, phrase) -> sorted word positions where the whole phrase begins, by rare words first."""
    out = {}
    licence = np.flatnonzero(number >= 0)
    order = licence[np.argsort(number[licence], kind="stable")]
    bounds = np.searchsorted(number[order], np.arange(len(index.vocabulary) + 1))
    for word, postings in index.postings.items():
        at = order[bounds[word] : bounds[word + 1]]
        if not len(at):
            continue
        row = found.row[at]
        for t, p, rare, second in postings:
            offset, length = index.offsets[t][p], index.lengths[t][p]
            words = index.words[t][offset : offset + length]
            start = at - rare
            fits = (start >= found.first[row]) & (start + length <= found.first[row + 1])
            start = start[fits]
            start = start[number[start + second] == words[second]]
            for k in range(length):
                start = start[number[start + k] == words[k]]
            if len(start):
                out[t, p] = np.sort(start)
    return out


def alignments(index: Index, t: int, places: dict[tuple[int, int], np.ndarray], found: tb.Words) -> np.ndarray:
    """Where a template begins (its first phrase's place in the text less its place in the template) with all phrases there."""
    apart = 4 * SLACK + 2 * len(index.words[t])
    # rows get room between them, so that phrases of two texts are never near each other
    key = lambda start, offset: start + found.row[start] * apart - offset
    first = places.get((t, 0), np.zeros(0, np.int64))
    begin = first - index.offsets[t][0]
    for p in range(1, len(index.offsets[t])):
        other = places.get((t, p), np.zeros(0, np.int64))
        where, there = key(first, index.offsets[t][0]), key(other, index.offsets[t][p])
        near = np.searchsorted(there, where + SLACK, side="right") > np.searchsorted(there, where - SLACK)
        first, begin = first[near], begin[near]
    return np.stack([begin, found.row[first]])


def coverage(index: Index, t: int, begin: np.ndarray, row: np.ndarray, number: np.ndarray, found: tb.Words) -> np.ndarray:
    """IDF share of the template's words that stand in place."""
    words = index.words[t]
    idf = index.idf[words]
    got = np.zeros(len(begin))
    for k, word in enumerate(words):
        at = begin + k
        inside = (at >= found.first[row]) & (at < found.first[row + 1])
        got += idf[k] * (inside & (number[np.clip(at, 0, max(len(number) - 1, 0))] == word))
    return got / idf.sum()


def document_frequencies(docs: DataFrame, text: str, index: Index) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each word of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = 0, len(index.vocabulary)
        df = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for block in tb.blocks(batch.column(0)):
                found = tb.words(block)
                number = index.of(found)
                has = number >= 0
                seen = np.unique(found.row[has] * size + number[has])
                df += np.bincount(seen % size, minlength=size)
                rows += block.rows
        yield pa.record_batch({"word": pa.array([*range(size), -1], pa.int32()), "n": np.append(df, rows)})

    total = docs.select(text).mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    df = np.zeros(len(index.vocabulary) + 1, dtype=np.int64)
    for row in total.collect():  # one row per template word
        df[row["word"]] = row["n"]
    return int(df[-1]), df[:-1]


SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double,"
    " spans array<struct<label:string,start:bigint,length:int>>")


def scan_block(index: Index, block: tb.Block) -> list[pa.Array]:
    found = tb.words(block)
    number = index.of(found)
    places = phrase_places(index, number, found)
    n_base, score = np.zeros(block.rows, np.int64), np.zeros(block.rows)
    low, high = np.full(block.rows, np.iinfo(np.int64).max), np.full(block.rows, -1)
    base, labels, spans = defaultdict(set), defaultdict(set), defaultdict(list)
    for t, template in enumerate(index.templates):
        begin, row = alignments(index, t, places, found)
        if not len(row):
            continue
        if template.base:
            n_base += np.bincount(row, minlength=block.rows)
            np.minimum.at(low, row, begin - found.first[row])
            np.maximum.at(high, row, begin - found.first[row])
        np.maximum.at(score, row, coverage(index, t, begin, row, number, found))
        for r in np.unique(row).tolist():
            labels[r].add(template.label)
            if template.base:
                base[r].add(template.label)
        starts = begin - found.first[row]
        for r, s in zip(row.tolist(), starts.tolist(), strict=True):
            spans[r].append({"label": template.label, "start": s, "length": len(index.words[t])})
    none = high < 0
    listed = lambda of: pa.array([",".join(sorted(of[r])) if r in of else "" for r in range(block.rows)], pa.string())
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int32())]))
    every = pa.array([sorted(spans[r], key=lambda s: (s["start"], s["label"], s["length"])) if r in spans else [] for r in range(block.rows)], kind)
    return [
        pa.array(np.diff(found.first), pa.int64()), pa.array(n_base), pa.array(np.where(none, 0, low), pa.int64(), mask=none), pa.array(high, pa.int64(), mask=none),
        listed(base), listed(labels), pa.array(score), every]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans
    (matched templates by place, in words from 0; a notice's place is where its first word would stand)."""
    index = Index(templates)
    index.weigh(*document_frequencies(docs, text, index))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.rows), *scan_block(shared.value, block)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def _phrases_sql() -> str:
    rows = []
    for i, t in enumerate(TEMPLATES):
        for p, phrase in enumerate(t.phrases):
            offset = f" {t.words} ".index(f" {phrase} ")
            rows.append(f"({i}, {p}, {t.words[:offset].count(' ')}, '{phrase}')")
    return ", ".join(rows)


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query("op11_license_scan", f"""
WITH tpl AS (SELECT t, label, base, string_split(words, ' ') AS tw FROM (VALUES
  {", ".join(f"({i}, '{t.label}', {t.base}, '{t.words}')" for i, t in enumerate(TEMPLATES))}) AS v(t, label, base, words)),
ph AS (SELECT t, p, o, string_split(phrase, ' ') AS pw FROM (VALUES {_phrases_sql()}) AS v(t, p, o, phrase)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
voc AS (SELECT DISTINCT unnest(tw) AS x FROM tpl),
df AS (SELECT x, count(r) AS df FROM voc LEFT JOIN (SELECT DISTINCT r, unnest(w) AS x FROM d) USING (x) GROUP BY x),
idf AS (SELECT x, ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (df + 0.5::DOUBLE)) AS idf FROM df),
pos AS (SELECT r, x, i FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE x IN (SELECT pw[1] FROM ph)),
hit AS (SELECT r, t, p, i, i - o AS delta FROM pos JOIN ph ON pos.x = ph.pw[1] JOIN d USING (r) WHERE w[i:i + len(pw) - 1] = pw),
need AS (SELECT t, max(p) AS last FROM ph GROUP BY t),
ok AS (SELECT a.r, a.t, a.delta FROM hit a JOIN need n ON n.t = a.t LEFT JOIN hit b ON b.r = a.r AND b.t = a.t AND b.p > 0 AND abs(b.delta - a.delta) <= {SLACK}
  WHERE a.p = 0 GROUP BY a.r, a.t, a.delta, n.last HAVING count(DISTINCT b.p) = n.last),
words AS (SELECT t, unnest(tw) AS x, unnest(range(0, len(tw))) AS q FROM tpl),
total AS (SELECT t, sum(idf) AS total FROM words JOIN idf USING (x) GROUP BY t),
cover AS (SELECT ok.r, ok.t, ok.delta, coalesce(sum(idf) FILTER (delta + q >= 1 AND w[delta + q] = x), 0) / any_value(total) AS share
  FROM ok JOIN d USING (r) JOIN words USING (t) JOIN idf USING (x) JOIN total USING (t) GROUP BY ok.r, ok.t, ok.delta),
doc AS (SELECT r, count(*) FILTER (base) AS n_base, min(delta - 1) FILTER (base) AS first_word, max(delta - 1) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM cover JOIN tpl USING (t) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score FROM d LEFT JOIN doc USING (r)""")
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"))
