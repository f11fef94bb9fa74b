"""Near-duplicate groups: improved consistent weighted sampling over TF-IDF shingles.

1. A shingle is five folded words (a shorter text is one shingle); its weight is how often the
   text has it, times ``1 + ln(N / df) / ln(N)``, which lies between 1 and 2. Document frequencies
   are exact for every shingle: hashes are dealt by ranges and counted there (``shingle_counts``),
   and the texts that share a bucket with another get theirs back by blocks (``weigh``).
2. Every text draws ``BANDS * ROWS`` consistent weighted samples; two texts draw the same sample
   with a probability equal to their weighted Jaccard similarity. The gamma variables come from
   quantile tables by hash, so equal shingles get equal draws everywhere. For the draws alone, weights
   must be at hand in every task: the at most ``FREQUENT`` shingles in ``t`` documents or more have
   their own, others that of ``t``. That changes the chance to meet, never the similarity: weights are too
   small by a factor of at most ``c = 2 / (1 + ln(N / t) / ln(N))``, and a pair of similarity 0.8 draws the
   same sample with a probability of at least ``0.8 / (0.8 + 0.2 c)``. The bands are as many as it takes
   to meet with 0.999 at ``c = 1.42`` (15 million texts of 480 shingles), and with 0.99 at ``c = 2``.
3. Equal word sequences are one text. Texts that agree in all samples of a band are candidates.
   The head of a bucket is its text that shares most buckets. Every text is compared with the most central
   of its heads, then with those heads that are still of another class; components of the links
   found so are classes. Buckets that still hold several classes have all their texts of different classes
   compared, ``SLICE`` by ``SLICE``, by products of their shingles' weights (``close_pairs``).
4. A candidate counts if the exact weighted Jaccard similarity is at least ``SIMILAR``.

Defined cases: null, empty and wordless texts are classes of their own; repeated rows are copies;
ties go to the smaller hash; an empty table gives no rows. Texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.llm import textblocks as tb
from assayspark.llm.components import connected_components
from assayspark.llm.shared import fresh, materialize, query, set_bits, table

BANDS, ROWS = 14, 3
SIMILAR = 0.8
FREQUENT = 1 << 18
BLOCK = 400_000
_LEVELS = 1 << 16
#: Bytes of text whose shingles are counted in one range of hashes, and shingles that a task deals at once.
RANGE, HELD = 1 << 24, 1_000_000
#: Bytes of text that get their document frequencies together.
CHUNK = 4_000_000
#: Texts, and weight of their shingles, in one slice of a bucket; shared shingles multiplied at once.
SLICE, HEAVY, COLUMNS = 512, 1 << 20, 2048


def idf(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency among n documents, between 1 and 2."""
    return 1 + np.log(max(n, 1) / np.minimum(df, max(n, 1))) / np.log(max(n, 2))


@dataclass
class Weights:
    """Inverse document frequencies: frequent shingles by value, one weight for all the others."""

    hashes: np.ndarray
    idf: np.ndarray
    rare: float

    def of(self, h: np.ndarray, times: np.ndarray) -> np.ndarray:
        idf = np.full(len(h), self.rare)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            idf = np.where(self.hashes[at] == h, self.idf[at], self.rare)
        return times * idf


@dataclass
class Counts:
    """Document frequencies of all shingles.

    ``ranges`` (part, hashes, times, total, docs) has a row per range of hashes: those in two documents or
    more, sorted, and their frequencies; any other shingle of the corpus is in one document.
    """

    ranges: DataFrame
    bits: int
    total: int
    docs: int


def _bytes(h: np.ndarray) -> bytes:
    """Sorted hashes by planes of bytes; the upper ones hardly change, which compresses."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8).T).tobytes()


def _hashes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _edges(h: np.ndarray, bits: int) -> np.ndarray:
    """Where the ranges of hashes begin among sorted ones."""
    starts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(h, starts), [len(h)]])


def shingle_counts(docs: DataFrame, text: str = "text") -> Counts:
    """Exact document frequencies: every task deals its hashes by range, a range is counted in one task.

    There are as many ranges as the size of the text takes, so a range has a bounded size; a frequent
    shingle comes once from ``HELD`` others, with its number.
    """
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    bits = max(0, int(size) // RANGE).bit_length()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, docs_seen = [], 0, 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(held)
            held.clear()
            h.sort()
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            times, h = np.diff(np.append(first, len(h))).astype(np.uint32), h[first]
            at = _edges(h, bits)
            used = np.flatnonzero(np.diff(at))
            seen = np.zeros(len(used), dtype=np.int64)
            seen[:1] = docs_seen
            return pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array([_bytes(h[at[i] : at[i + 1]]) for i in used], pa.binary()),
                 pa.array([times[at[i] : at[i + 1]].tobytes() for i in used], pa.binary()), pa.array(seen)],
                names=["part", "hashes", "times", "docs"])

        for batch in batches:
            for b in tb.blocks(batch.column(0), BLOCK):
                found = tb.words(b)
                _, h, _ = tb.shingles(found)
                held.append(h)
                n, docs_seen = n + len(h), docs_seen + int((np.diff(found.first) > 0).sum())
                if n >= HELD:
                    yield flush()
                    n, docs_seen = 0, 0
        if n:
            yield flush()

    def add(group: pa.Table) -> pa.Table:
        h = np.concatenate([_hashes(x) for x in group["hashes"].to_pylist()])
        times = np.frombuffer(b"".join(group["times"].to_pylist()), dtype=np.uint32).astype(np.int64)
        order = np.argsort(h)
        h, times = h[order], times[order]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        sums = np.add.reduceat(times, at)
        often = sums > 1
        return pa.table({
            "part": group["part"].slice(0, 1), "hashes": pa.array([_bytes(h[at[often]])], pa.binary()),
            "times": pa.array([sums[often].tobytes()], pa.binary()), "total": pa.array([int(times.sum())], pa.int64()),
            "docs": pa.array([sum(group["docs"].to_pylist())], pa.int64())})

    dealt = docs.select(text).mapInArrow(deal, "part int, hashes binary, times binary, docs bigint")
    ranges = dealt.groupBy("part").applyInArrow(add, "part int, hashes binary, times binary, total bigint, docs bigint")
    ranges = materialize(ranges, "ranges")
    sums = ranges.agg(F.sum("total"), F.sum("docs")).first()
    return Counts(ranges, bits, sums[0] or 0, sums[1] or 0)


def fit_weights(counts: Counts) -> Weights:
    """Weights for the draws: exact for the frequent shingles, of which at most ``FREQUENT`` reach the driver."""
    least = max(1, -(-counts.total // FREQUENT))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, n = _hashes(hashes), np.frombuffer(times, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tb.signed(h[n >= least])), pa.array(n[n >= least])], names=["h", "n"])

    rows = counts.ranges.select("hashes", "times").mapInArrow(pick, "h bigint, n bigint").toPandas()
    h = rows["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return Weights(h[order], idf(rows["n"].to_numpy(dtype=np.float64)[order], counts.docs), float(idf(np.float64(least), counts.docs)))


def weigh(texts: DataFrame, counts: Counts) -> DataFrame:
    """(h, text, dfs, total): each text with the document frequencies of its shingles, in their order, and its weight.

    Blocks of texts ask the ranges for their hashes and get back those in two documents or more.
    """
    bits, n = counts.bits, counts.docs

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ends = size + np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(block + ends // CHUNK), *batch.columns], names=["block", "h", "text"])
            size = int(ends[-1]) if len(ends) else size

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            first = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else []
            for i, j in zip(first, [*first[1:], len(blocks)], strict=True):
                h = np.unique(np.concatenate([tb.shingles(tb.words(b))[1] for b in tb.blocks(batch.column(1).slice(i, j - i), BLOCK)]))
                at = _edges(h, bits)
                used = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), blocks[i])),
                     pa.array([_bytes(h[at[k] : at[k + 1]]) for k in used], pa.binary())], names=["part", "block", "hashes"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        h = np.concatenate([np.zeros(0, np.uint64), *[_hashes(x) for x in known["hashes"].to_pylist()]])
        times = np.frombuffer(b"".join(known["times"].to_pylist()), dtype=np.int64)
        got = []
        for x in asked["hashes"].to_pylist():
            wanted = _hashes(x)
            at = np.minimum(np.searchsorted(h, wanted), max(len(h) - 1, 0))
            at = at[h[at] == wanted] if len(h) else at[:0]
            got.append((h[at].tobytes(), times[at].tobytes()))
        return pa.table({"block": asked["block"], "hashes": pa.array([x for x, _ in got], pa.binary()), "times": pa.array([x for _, x in got], pa.binary())})

    def fill(own: pa.Table, answers: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(answers["hashes"].to_pylist()), dtype=np.uint64)
        times = np.frombuffer(b"".join(answers["times"].to_pylist()), dtype=np.int64)
        order = np.argsort(h)
        h, times = h[order], times[order]
        dfs, totals = [], []
        for b in tb.blocks(own["text"], BLOCK):
            row, found, often = tb.shingles(tb.words(b))
            df = np.ones(len(found), dtype=np.int64)
            if len(h):
                at = np.minimum(np.searchsorted(h, found), len(h) - 1)
                df = np.where(h[at] == found, times[at], 1)
            totals.append(np.bincount(row, weights=often * idf(df, n), minlength=b.rows))
            bounds, small = np.searchsorted(row, np.arange(b.rows + 1)), df.astype(np.uint32)
            dfs += [zlib.compress(small[i:j].tobytes(), 1) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table({"h": own["h"], "text": own["text"], "dfs": pa.array(dfs, pa.binary()), "total": pa.array(np.concatenate([np.zeros(0), *totals]))})

    texts = materialize(texts.select("h", "text").mapInArrow(cut, "block bigint, h bigint, text string"), "bodies")
    asked = texts.select("block", "text").mapInArrow(ask, "part int, block bigint, hashes binary")
    answers = asked.groupBy("part").cogroup(counts.ranges.select("part", "hashes", "times").groupBy("part")).applyInArrow(
        answer, "block bigint, hashes binary, times binary")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(fill, "h bigint, text string, dfs binary, total double")


def _gamma_levels() -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2, at the middle of 2^16 equal shares."""
    want = (np.arange(_LEVELS) + 0.5) / _LEVELS
    x = np.full(_LEVELS, 1.7)
    low, high = np.zeros(_LEVELS), np.full(_LEVELS, 60.0)
    for _ in range(60):
        below = 1 - np.exp(-x) * (1 + x) < want
        low, high = np.where(below, x, low), np.where(below, high, x)
        x = (low + high) / 2
    return x.astype(np.float32)


_GAMMA = _gamma_levels()
_LOG_GAMMA = np.log(_GAMMA)


def sample(h: np.ndarray, weight: np.ndarray, bounds: np.ndarray, samples: int = BANDS * ROWS, first: int = 0) -> np.ndarray:
    """For each text (shingles bounds[i]:bounds[i + 1]) its consistent weighted samples, as 32-bit names."""
    texts = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, samples), dtype=np.uint64)
    log_weight = np.log(weight).astype(np.float32)
    for k in range(samples if len(texts) else 0):
        u = tb.mix(h, 1000 + first + k)
        r = _GAMMA[(u & np.uint64(0xFFFF)).astype(np.int64)]
        log_c = _LOG_GAMMA[((u >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
        beta = (u >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_weight / r + beta)
        cost = log_c - r * (t - beta) - r + np.float32(256)
        name = (u ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) & np.uint64(0xFFFFFFFF)
        both = (cost.view(np.uint32).astype(np.uint64) << np.uint64(32)) | name
        out[texts, k] = np.minimum.reduceat(both, bounds[texts]) & np.uint64(0xFFFFFFFF)
    return out


def signatures(docs: DataFrame, weights: Weights, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: row key, hash of its words and one key per band; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for b in tb.blocks(batch.column(2), BLOCK):
                found = tb.words(b)
                row, h, times = tb.shingles(found)
                w = known.of(h, times)
                bounds = np.searchsorted(row, np.arange(b.rows + 1))
                drawn = sample(h, w, bounds)
                keys = np.zeros((b.rows, BANDS), dtype=np.uint64)
                for band in range(BANDS):
                    for j in range(ROWS):
                        keys[:, band] = tb.mix(keys[:, band] ^ drawn[:, band * ROWS + j], band * ROWS + j)
                lists = pa.ListArray.from_arrays(pa.array((np.arange(b.rows + 1) * BANDS).astype(np.int32)), pa.array(tb.signed(keys.ravel())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first, b.rows), batch.column(1).slice(b.first, b.rows),
                     pa.array(tb.signed(tb.row_hash(found))), pa.array(np.diff(found.first) > 0), lists],
                    names=["doc_id", "key", "h", "has_words", "bands"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.xxhash64(doc_id, text), text).mapInArrow(
        run, f"doc_id {kind}, key bigint, h bigint, has_words boolean, bands array<bigint>")


def texts_of(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(h, text), once each, of the word hashes in ``wanted``; a bitmap keeps the others out of the shuffle."""
    bits = set_bits(wanted, "h")
    shared, width = docs.sparkSession.sparkContext.broadcast(bits.data), bits.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tb.Bitmap(width, shared.value)
        for batch in batches:
            for b in tb.blocks(batch.column(0)):
                h = tb.row_hash(tb.words(b))
                keep = np.flatnonzero(known.has(h) & (h != 0))
                if len(keep):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tb.signed(h[keep])), batch.column(0).take(pa.array(keep + b.first))], names=["h", "text"])

    return docs.select(text).mapInArrow(run, "h bigint, text string").groupBy("h").agg(F.min("text").alias("text")).join(wanted.select("h").distinct(), "h", "left_semi")


def close_pairs(rows: DataFrame, weighted: DataFrame, n: int, least: float = SIMILAR) -> DataFrame:
    """Pairs (a, b) of texts of different roots in a bucket (rows: bucket, h, total, root) that can be similar.

    A bucket's texts are dealt into slices, and each two slices are compared in a group of their own. The
    shared weight is the product of the texts' shingles, which travel as 32 bits each and only if another
    document has them too. Shingles that fall together add to it, so no similar pair is lost.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.blocks(batch.column(1), BLOCK):
                row, h, times = tb.shingles(tb.words(b))
                df = _frequencies(batch.column(2).slice(b.first, b.rows))
                shared = df > 1
                row, h, times, df = row[shared], h[shared], times[shared], df[shared]
                at = np.repeat(np.arange(len(h)), times)  # the k-th of a repeated shingle is one of its own
                copy = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                names = (tb.mix(h[at] + tb.mix(copy.astype(np.uint64), 3), 31) >> np.uint64(32)).astype(np.uint32)
                bounds, often = np.searchsorted(row[at], np.arange(b.rows + 1)), df[at].astype(np.uint32)
                parts = list(zip(bounds[:-1], bounds[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first, b.rows), pa.array([names[i:j].tobytes() for i, j in parts], pa.binary()),
                     pa.array([zlib.compress(often[i:j].tobytes(), 1) for i, j in parts], pa.binary())], names=["h", "names", "dfs"])

    def compare(group: pa.Table) -> pa.Table:
        h, root, total, side = (group[c].to_numpy() for c in ("h", "root", "total", "side"))
        both = shared_weight(group["names"].to_pylist(), _frequencies(group["dfs"]), n)
        i, j = np.nonzero(both >= (least - 1e-4) * (total[:, None] + total[None, :] - both))
        apart = (root[i] != root[j]) & (h[i] < h[j]) & ((side[i] != side[j]) | bool(group["i"][0].as_py() == group["j"][0].as_py()))
        return pa.table({"a": h[i[apart]], "b": h[j[apart]]})

    slices = rows.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / SLICE), F.ceil(F.sum("total") / HEAVY)).cast("int").alias("slices"))
    dealt = rows.join(slices, "bucket").withColumn("side", F.pmod(F.xxhash64("h"), "slices").cast("int"))
    dealt = dealt.select("bucket", "h", "total", "root", "side", F.explode(F.expr("sequence(0, slices - 1)")).alias("other"))
    dealt = dealt.select("bucket", "h", "total", "root", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    packed = weighted.join(rows.select("h").distinct(), "h", "left_semi").select("h", "text", "dfs").mapInArrow(pack, "h bigint, names binary, dfs binary")
    packed = materialize(packed, "packed")
    return dealt.join(packed, "h").groupBy("bucket", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def _frequencies(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The packed document frequencies of some texts, one after the other."""
    return np.frombuffer(b"".join(zlib.decompress(x) for x in column.to_pylist()), dtype=np.uint32).astype(np.int64)


def shared_weight(names: list[bytes], df: np.ndarray, n: int) -> np.ndarray:
    """For each two texts the weight of the shingles they share, to single precision.

    A shingle is a column of a matrix that is multiplied with itself, some columns at a time.
    """
    texts = len(names)
    row = np.repeat(np.arange(texts), [len(x) // 4 for x in names])
    _, column, times = np.unique(np.frombuffer(b"".join(names), dtype=np.uint32), return_inverse=True, return_counts=True)
    out = np.zeros((texts, texts), dtype=np.float32)
    weight = np.sqrt(idf(df, n))
    new = np.cumsum(times > 1) - 1  # what one text alone has is not shared
    kept = times[column] > 1
    row, column, weight = row[kept], new[column[kept]], weight[kept]
    order = np.argsort(column, kind="stable")
    row, column, weight = row[order], column[order], weight[order]
    last = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, last, COLUMNS):
        i, j = np.searchsorted(column, [first, first + COLUMNS])
        flat = np.bincount(row[i:j] * COLUMNS + column[i:j] - first, weights=weight[i:j], minlength=texts * COLUMNS)
        part = flat.astype(np.float32).reshape(texts, COLUMNS)
        out += part @ part.T
    return out


def similarity(a: pa.Array, b: pa.Array, weights: Weights | Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of two columns, row by row; weights come from hashes and times."""
    n = len(a)
    block = next(tb.blocks(pa.concat_arrays([a.cast(pa.large_string()), b.cast(pa.large_string())]), 1 << 62, None))
    row, h, times = tb.shingles(tb.words(block))
    w = weights.of(h, times) if isinstance(weights, Weights) else weights(h, times)
    total = np.bincount(row % n, weights=w, minlength=n)
    order = np.lexsort((h, row % n))
    row, h, w = row[order] % n, h[order], w[order]
    both = np.flatnonzero((row[1:] == row[:-1]) & (h[1:] == h[:-1]))
    shared = np.bincount(row[both], weights=np.minimum(w[both], w[both + 1]), minlength=n)
    return shared / np.maximum(total - shared, 1e-300)


def verify(pairs: DataFrame, weighted: DataFrame, n: int, least: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose similarity among n documents is at least ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum([len(x) + len(y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])
            first = 0
            while first < batch.num_rows:
                done = size[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(size, done + BLOCK)))
                part = batch.slice(first, last - first)
                df = np.concatenate([_frequencies(part.column(4)), _frequencies(part.column(5))])
                s = similarity(part.column(2), part.column(3), lambda h, times, df=df: times * idf(df, n))
                good = np.flatnonzero(s >= least - 1e-9)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(good)), part.column(1).take(pa.array(good)), pa.array(s[good])], names=["a", "b", "similarity"])
                first = last

    left = weighted.select(F.col("h").alias("a"), F.col("text").alias("text_a"), F.col("dfs").alias("dfs_a"))
    right = weighted.select(F.col("h").alias("b"), F.col("text").alias("text_b"), F.col("dfs").alias("dfs_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b", "dfs_a", "dfs_b")
    return joined.mapInArrow(run, "a bigint, b bigint, similarity double")


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, key, h, class_id, class_size, is_first) and the links between texts (a, b, similarity).

    ``class_id`` is the smallest id in the class, ``is_first`` marks the rows of that document.
    """
    counts = shingle_counts(docs, text)
    n = counts.docs
    signed = materialize(signatures(docs, fit_weights(counts), doc_id, text), "signatures")
    texts = signed.where("has_words").groupBy("h").agg(F.first("bands").alias("bands"))
    members = texts.select("h", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(members.join(sizes, "bucket"), "members")
    central = members.groupBy("h").agg(F.sum("n").alias("central"))
    weighted = materialize(weigh(texts_of(docs, central, text), counts), "weighted")
    members = materialize(members.join(central, "h").join(weighted.select("h", "total"), "h"), "central")
    heads = members.groupBy("bucket").agg(F.max(F.struct("central", "h", "total")).alias("head"))
    fits = lambda x, y: F.least(x, y) >= (SIMILAR - 1e-9) * F.greatest(x, y)

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    def placed_by(links: DataFrame) -> DataFrame:
        """The members with the class that the links so far give them."""
        roots = materialize(connected_components(links), "roots").withColumnRenamed("node", "h")
        return materialize(members.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h")), "placed")

    heads = materialize(heads.select("bucket", "head"), "heads")
    offered = members.join(heads, "bucket").where((F.col("h") != F.col("head.h")) & fits(F.col("total"), F.col("head.total")))
    first = offered.groupBy("h").agg(F.max("head").alias("head")).select(*pair("h", "head.h")).distinct()
    first = materialize(first, "pairs")
    links = materialize(verify(first, weighted, n), "links")

    # only where a text and a head are still of different classes
    placed = placed_by(links)
    known = placed.select(F.col("h").alias("of"), F.col("root").alias("head_root")).distinct()
    rooted = heads.join(known, F.col("head.h") == F.col("of")).select("bucket", "head", "head_root")
    again = placed.join(rooted, "bucket").where((F.col("root") != F.col("head_root")) & fits(F.col("total"), F.col("head.total")))
    again = materialize(again.select(*pair("h", "head.h")).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(materialize(verify(again, weighted, n), "links"))
    compared = first.unionByName(again)

    placed = placed_by(links).select("bucket", "h", "total", "root")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    rest = materialize(placed.join(mixed, "bucket", "left_semi"), "mixed")
    more = close_pairs(rest, weighted, n).join(compared, ["a", "b"], "left_anti")
    links = links.unionByName(materialize(verify(materialize(more, "pairs"), weighted, n), "links"))
    roots = materialize(connected_components(links), "roots").withColumnRenamed("node", "h")

    rows = signed.select("doc_id", "key", "h", "has_words").join(roots, "h", "left")
    rows = rows.withColumn("class", F.when(F.col("has_words"), F.coalesce("root", "h")).otherwise(F.col("key")))
    rows = materialize(rows.select("doc_id", "key", "h", "has_words", "class"), "classes")
    least = rows.groupBy("has_words", "class").agg(
        F.min(F.struct("doc_id", "key")).alias("least"), F.count("*").alias("class_size"))
    out = rows.join(least, ["has_words", "class"]).select(
        "doc_id", "key", "h", F.when(F.col("has_words"), F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("has_words"), F.col("class_size")).otherwise(F.lit(1)).cast("long").alias("class_size"),
        (~F.col("has_words") | (F.col("key") == F.col("least.key"))).alias("is_first"))
    return out, links


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with its own columns; wordless documents all stay.

    Rows equal in id and text share a key; of those one stays. The text is not shuffled unless the
    table of keys to drop is too large for Spark to broadcast.
    """
    classes, _ = near_duplicate_classes(docs, doc_id, text)
    classes = materialize(classes.select("key", "is_first", "h"), "verdicts")
    key = fresh(docs, "key")
    drop = materialize(classes.where("not is_first").select(F.col("key").alias(key)).distinct(), "dropped")
    twice = classes.where("is_first and h != 0").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias(key))
    twice = materialize(twice, "repeated")
    kept = docs.withColumn(key, F.xxhash64(doc_id, text)).join(drop, key, "left_anti")
    if twice.head(1):
        kept = kept.join(twice, key, "left_anti").unionByName(kept.join(twice, key, "left_semi").dropDuplicates([key]))
    return kept.select(*docs.columns)


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "class_size", "is_first")
