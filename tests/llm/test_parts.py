"""The array code of the operators against the libraries and against definitions."""

import random
import re
import tracemalloc

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assayspark.llm import boosting, docstats, language_id, near_duplicates, packing, pieces, token_counts
from assayspark.llm import textblocks as tb

CHARS = st.text(alphabet=st.sampled_from(list("aabstrevmld'  \n\t!?.,:12 ÀéßΣσİ日本٣½  　<|>endof")), max_size=60)
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(CHARS, min_size=1, max_size=5))
def test_ids_equal_the_library(texts):
    texts = [*texts, "x<|endoftext|> y", ""]
    ids, bounds = packing.document_encoder(public_tokenizers.path("byte_bpe_50k.json")).ids(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == BYTES.encode(t, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(CHARS, min_size=1, max_size=5))
def test_counts_equal_the_library(texts):
    texts = [*texts, "a <|startoftext|>b<|endoftext|>", ""]
    own = token_counts.counter(public_tokenizers.path("word_bpe_49k.json"))
    assert own.counts(texts).tolist() == [len(WORDS.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abstrevmld'  \n!.12éß日½")), max_size=40))
def test_every_prefix_count_equals_the_library(text):
    own = token_counts.counter(public_tokenizers.path("word_bpe_49k.json"))
    got = own.prefixes(text)
    plain = token_counts.normalised(text)
    assert got.tolist() == [len(WORDS.encode(plain[:i], add_special_tokens=False).ids) for i in range(len(plain) + 1)]
    for budget in (0, 1, 5):
        n = token_counts.longest_prefix(got, budget)
        assert got[n] <= budget and (n == len(plain) or got[n + 1 :].min(initial=budget + 1) > budget)


def test_a_longer_prefix_may_have_fewer_tokens():
    own = token_counts.counter(public_tokenizers.path("word_bpe_49k.json"))
    assert own.prefixes("label").tolist() == [0, 1, 1, 1, 2, 1]  # la be, but label
    for text in ("a label  b", " label\n", "label label", "labe", "label's"):
        assert own.prefixes(text).tolist() == [len(WORDS.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert own.prefixes("label<|endoftext|> label")[-1] == 3


def test_prefixes_with_special_strings():
    own = token_counts.counter(public_tokenizers.path("word_bpe_49k.json"))
    assert own.prefixes("ab<|endoftext|>c")[-1] == 3 and len(own.prefixes("ab<|endoftext|>c")) == 17


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab c\n\t#*é.Z9")), max_size=80), min_size=1, max_size=6))
def test_counts_and_shingles_of_a_block(texts):
    column = pa.array([*texts, None])
    parts = [docstats.base_counts(b) for b in tb.blocks(column, 50)]
    got = list(zip(*[np.concatenate([p[c] for p in parts]).tolist() for c in docstats.COUNTS[:5]], strict=True))
    assert got == [brute.base_counts(t) for t in [*texts, None]]
    at = 0
    for b in tb.blocks(column, 50):
        found = tb.words(b)
        row, _, times = tb.shingles(found)
        for r in range(b.rows):
            bag = brute.shingle_bags([[*texts, None][at]])[0]
            assert sorted(times[row == r].tolist()) == sorted(bag.values())
            assert np.diff(found.first)[r] == len(brute.words([*texts, None][at]))
            at += 1
    assert at == len(column)
    for b in tb.blocks(column):
        assert np.isfinite(docstats.features(b)).all()


def test_blocks_keep_slices_and_long_texts():
    column = pa.array(["x", None, "ä" * 500, "", "yy"]).slice(1)
    seen = [(b.first, b.rows, bytes(b.data)) for b in tb.blocks(column, 10)]
    assert [s[0] for s in seen] == [0, 1, 2] or sum(s[1] for s in seen) == 4
    assert b"".join(s[2] for s in seen) == ("ä" * 500 + "yy").encode()


def test_bitmap_never_misses():
    own, h = tb.Bitmap(12), tb.mix(np.arange(500, dtype=np.uint64))
    own.add(h)
    assert own.has(h).all() and own.has(tb.mix(np.arange(500, 9000, dtype=np.uint64))).mean() < 0.3


def test_samples_agree_as_often_as_weights_overlap():
    h = tb.mix(np.arange(400, dtype=np.uint64))
    w = np.random.default_rng(1).uniform(1, 4, 400)
    a, b = np.arange(0, 330), np.arange(70, 400)
    wb = w[b] * np.where(b % 2, 1.0, 1.5)
    full_a, full_b = np.zeros(400), np.zeros(400)
    full_a[a], full_b[b] = w[a], wb
    jaccard = np.minimum(full_a, full_b).sum() / np.maximum(full_a, full_b).sum()
    drawn = near_duplicates.sample(np.concatenate([h[a], h[b]]), np.concatenate([w[a], wb]), np.array([0, 330, 660]), 3000)
    assert abs((drawn[0] == drawn[1]).mean() - jaccard) < 0.03
    weights = near_duplicates.Weights(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    x, y = "a b c d e f g h", "a b c d e f g x"
    assert near_duplicates.similarity(pa.array([x]), pa.array([y]), weights)[0] == pytest.approx(3 / 5)


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    forest = boosting.fit(x[:3000], y[:3000])
    assert ((forest.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert boosting.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert boosting.fit(x[:9], np.ones(9)).score(x[:3]).min() > 0.99


def test_automaton_parses_like_substring_search():
    rng = random.Random(3)
    samples = {k: ["".join(rng.choice(v) for _ in range(400))] for k, v in {"aa": "ab c", "bb": "bcd e", "cc": "xyz "}.items()}
    parser = language_id.Parser.learn(samples, 300)
    texts = ["".join(rng.choice("abcde xyzq") for _ in range(rng.randint(0, 700))) for _ in range(20)]
    known = {k: "".join(chr(c) for c in language_id.signs(v[0] + "\n")[:300]) for k, v in samples.items()}

    def phrases(text, sample):
        n = 0
        for a in range(0, len(text), language_id.STRIP):
            part, i = text[a : a + language_id.STRIP], 0
            while i < len(part):
                size = 1
                while i + size < len(part) and part[i : i + size + 1] in sample:
                    size += 1
                i, n = i + size, n + 1
        return n

    cleaned = [language_id.signs(t) for t in texts]
    got = parser.phrases(cleaned)
    for t, row in zip(cleaned, got, strict=True):
        plain = "".join(map(chr, t.tolist()))
        assert row.tolist() == [phrases(plain, known[k]) for k in parser.languages]


def test_best_fit_holds_every_capacity():
    sizes = np.random.default_rng(5).integers(1, 1025, 3000)
    for documents, attention in ((1024, 1024.0**2), (3, 1024.0**2), (1024, 300_000.0)):
        fitting = sizes[sizes.astype(float) ** 2 <= attention]
        bins, offsets = packing.best_fit(fitting, 1024, documents, attention)
        for b in np.unique(bins):
            own = np.flatnonzero(bins == b)
            order = own[np.argsort(offsets[own])]
            assert offsets[order].tolist() == [0, *np.cumsum(fitting[order])[:-1]]
            assert fitting[own].sum() <= 1024 and len(own) <= documents and (fitting[own].astype(float) ** 2).sum() <= attention
    bins, _ = packing.best_fit(sizes)
    assert len(np.unique(bins)) <= 1.02 * -(-sizes.sum() // 1024)


def test_cut_tells_pieces_like_the_pattern():
    import regex

    texts = ["a  b\n\nc 'sx 's''d  ", " 12 3!?'ll\t", "x"]
    found = pieces.cut(texts, spaces=True)
    for r, t in enumerate(texts):
        mine = [found.text(i) for i in np.flatnonzero(found.row == r)]
        assert mine == regex.findall(public_tokenizers.PATTERN, t)
    assert re.match("x", "x")


def test_a_book_of_pieces_stays_small():
    asked = []

    def encode(texts):
        asked.append(len(texts))
        return [[int(t)] for t in texts]

    def found(first, last):
        texts = [str(i) for i in range(first, last)]
        end = np.cumsum([len(t) for t in texts])
        start = end - [len(t) for t in texts]
        return pieces.Cut("".join(texts), start, end, np.zeros(len(texts), np.int64), tb.mix(np.arange(first, last, dtype=np.uint64), 3))

    book = pieces.PieceBook(encode)
    cuts = [found(a, a + 50_000) for a in (0, 30_000, 70_000, 0)]
    tracemalloc.start()
    for cut, first in zip(cuts, (0, 30_000, 70_000, 0), strict=True):
        assert book.last(book.look_up(cut)).tolist() == list(range(first, first + 50_000))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sum(asked) == 120_000 and max(asked) <= pieces.PieceBook.AT_ONCE  # each piece once, some at a time
    assert held < 50 * 120_000
