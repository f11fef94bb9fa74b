"""Packing of token sequences by vector best fit.

Tokenising is one pass in which every distinct piece of text is encoded once. Documents longer
than a sequence are cut from the end into whole sequences, so the first piece may be shorter.

Packing looks at three capacities at once: tokens, documents and attention cost (the squared
lengths of the pieces). Pieces are placed longest first; of all open bins that have room in every
dimension the one whose residual after placing has the smallest weighted norm is taken. A piece
that fills a sequence is alone. The rest is dealt by hash into shares of about ``SHARE`` pieces,
each packed alone; every share leaves a few bins part empty, which is one in some thousands, and
no task holds more than a share however many pieces there are.

Defined cases: null and empty texts are the end token alone; repeated rows are packed each; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayspark.llm import pieces as pc
from assayspark.llm.shared import materialize, query, small, table

LENGTH = 1024
END = 2
SHARE = 50_000
VOCABULARY = "byte_bpe_50k.json"
BLOCK_CHARS = 400_000
JOINED = 64


class DocumentEncoder:
    """Token ids of whole texts as the library gives them, by way of distinct pieces."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.specials = {t.content: i for i, t in added.items()}
        plain = [t.content for t in added.values() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark = next((m for m in plain if not any(m[:k] == m[-k:] for k in range(1, len(m)))), None)
        self.book = pc.PieceBook(self._encode)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each piece; many go to the library as one text, with a special string after each, which never is a part of a piece."""
        if self.mark is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        joined = ["".join(t + self.mark for t in texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)]
        flat = list(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)))
        at = np.flatnonzero(np.array(flat) == self.specials[self.mark])
        return [flat[a:b] for a, b in zip([0, *(at[:-1] + 1).tolist()], at.tolist(), strict=True)]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the bounds of each text."""
        parts, owner = texts, None
        if any(s in t for t in texts for s in self.specials):
            cut = [(i, p, special) for i, t in enumerate(texts) for p, special in pc.split_specials(t, self.specials)]
            owner = np.array([c[0] for c in cut])
            special = np.array([c[2] for c in cut])
            parts = [c[1] for c in cut]
        found = pc.cut(parts, spaces=True)
        ids, lengths = self.book.gather(self.book.look_up(found))
        row = np.repeat(found.row, lengths)
        if owner is not None:
            at = np.flatnonzero(special >= 0)
            order = np.argsort(np.concatenate([row, at]), kind="stable")
            ids = np.concatenate([ids, special[at].astype(np.uint32)])[order]
            row = owner[np.concatenate([row, at])[order]]
        return ids, np.searchsorted(row, np.arange(len(texts) + 1))


@cache
def document_encoder(path: str) -> DocumentEncoder:
    """One per worker, so that pieces met in one task are known in the next."""
    return DocumentEncoder(path)


def tokenize_pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if wanted, the ids."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = document_encoder(path)
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, last in pc.runs(texts, BLOCK_CHARS):
                ids, bounds = own.ids(texts[first:last])
                n = last - first
                full = np.zeros(len(ids) + n, dtype=np.uint32)
                full[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
                bounds = bounds + np.arange(n + 1)
                full[bounds[1:] - 1] = end
                sizes = np.diff(bounds)
                count = -(-sizes // length)
                doc = np.repeat(np.arange(n), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                head = sizes - (count - 1) * length
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * length)
                size = np.where(piece == 0, head[doc], length)
                begin = bounds[doc] + start
                raw = full.astype("<u4", copy=False)
                held = memoryview(raw).cast("B")
                last_byte = 4 * (begin + size)
                columns = [
                    batch.column(0).take(pa.array(first + doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size),
                    pa.array([zlib.crc32(held[a:b]) for a, b in zip((4 * begin).tolist(), last_byte.tolist(), strict=True)], pa.int64()),
                ]
                if with_ids:
                    cuts = [raw[a : a + s].astype(np.int32) for a, s in zip(begin.tolist(), size.tolist(), strict=True)]
                    columns.append(pa.array(cuts, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(doc_id, text).mapInArrow(run, schema)


def best_fit(
    sizes: np.ndarray, tokens: int = LENGTH, documents: int = LENGTH, attention: float = float(LENGTH) ** 2,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece under all three capacities.

    Open bins with the same room for tokens stand together; the newest of each such group is the
    candidate, and a candidate must have room for one more document and for the squared length.
    The smallest weighted norm of what would be left decides, the fuller bin at a tie.
    """
    order = np.argsort(-sizes, kind="stable")
    bins = np.zeros(len(sizes), dtype=np.int64)
    offsets = np.zeros(len(sizes), dtype=np.int64)
    groups: list[list[tuple[int, int, float]]] = [[] for _ in range(tokens + 1)]
    docs_left = np.full(tokens + 1, -1.0)
    cost_left = np.full(tokens + 1, -1.0)
    room = np.arange(tokens + 1)
    opened = 0
    wt, wd, wa = weights[0] / tokens**2, weights[1] / documents**2, weights[2] / attention**2
    for i in order.tolist():
        size = int(sizes[i])
        cost = float(size) ** 2
        d, a = docs_left[size:], cost_left[size:]
        able = np.flatnonzero((d >= 1) & (a >= cost))
        if len(able):
            left = room[able]
            norm = wt * left * left + wd * (d[able] - 1) ** 2 + wa * (a[able] - cost) ** 2
            at = size + int(able[np.argmin(norm)])
            number, free_docs, free_cost = groups[at].pop()
            if groups[at]:
                docs_left[at], cost_left[at] = groups[at][-1][1:]
            else:
                docs_left[at] = cost_left[at] = -1.0
        else:
            number, at, free_docs, free_cost = opened, tokens, documents, attention
            opened += 1
        bins[i], offsets[i] = number, tokens - at
        after = at - size
        if after > 0 and free_docs > 1:
            groups[after].append((number, free_docs - 1, free_cost - cost))
            docs_left[after], cost_left[after] = free_docs - 1, free_cost - cost
    return bins, offsets


def pack(pieces: DataFrame, length: int = LENGTH, share: int = SHARE, documents: int = LENGTH, attention: float = float(LENGTH) ** 2) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. The pieces should be a written table: it is read twice."""
    short = pieces.where(F.col("length") < length)
    shares = max(1, -(-short.count() // share))
    names, kinds = pieces.columns, pieces.schema
    size_at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        all_rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        bins, offsets = best_fit(np.asarray(all_rows.column(size_at)), length, documents, attention)
        ids = (np.int64(TaskContext.get().partitionId() + 1) << np.int64(36)) + bins
        yield pa.RecordBatch.from_arrays([*all_rows.columns, pa.array(ids), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", sequence_id bigint, offset bigint"
    dealt = short.repartition(shares, F.xxhash64("doc_id", "piece", "ids_crc32")).mapInArrow(run, kinds)
    full = pieces.where(F.col("length") >= length)
    alone = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
    return dealt.unionByName(alone)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(materialize(tokenize_pieces(docs, doc_id, text), "pieces"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
