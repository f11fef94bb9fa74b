"""Benchmark decontamination by winnowing.

Both sides keep the smallest hash of ``GRAM`` words in every window of ``SPAN`` words, so any
shared passage of ``SPAN`` words shares a kept hash. Items with fewer words are looked for as a
whole: for each such length, all runs of that length are kept. A kept hash carries its word hashes
and those around it, as far as a window can reach; after the join on the hash these are compared,
which extends a hit to both sides and makes it exact without reading the text again.

A bitmap of fixed size of the benchmark's hashes lets most document hashes go before the shuffle;
it only ever lets too many through. Documents without a word, null texts included, have no hits;
items without a word never occur. Repeated rows are judged alike; an empty benchmark hits nothing.
Items with a null id are not listed or counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayspark.llm import textblocks as tb
from assayspark.llm.shared import fresh, materialize, query, set_bits, table

SPAN, GRAM = 10, 5
SIDE = SPAN - GRAM
REACH = GRAM + 2 * SIDE
BITS = 24
MARKS = "array<struct<mark:bigint,size:int,at:int,around:binary>>"


def winnow(found: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the kept hashes, and the hashes; the last smallest of every window."""
    at, h = tb.grams(found, GRAM)
    n = len(at) - SIDE
    if n <= 0:
        return at[:0], h[:0]
    least, where = h[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, SIDE + 1):
        other = h[j : n + j]
        better = other <= least
        least[better], where[better] = other[better], j
    full = found.row[at[:n]] == found.row[at[SIDE:]]
    full &= at[SIDE:] - at[:n] == SIDE
    kept = np.unique(np.flatnonzero(full) + where[full])
    return at[kept], h[kept]


def _around(found: tb.Words, at: np.ndarray, sizes: np.ndarray, pad: int) -> pa.Array:
    """The word hashes next to each mark, ``REACH`` of them; ``pad`` where the row has no word."""
    left = np.where(sizes == 0, SIDE, 0)
    index = (at - left)[:, None] + np.arange(REACH)[None, :]
    row = found.row[at][:, None]
    inside = (index >= 0) & (index < len(found.row))
    index = np.clip(index, 0, max(len(found.row) - 1, 0))
    inside &= found.row[index] == row
    inside &= (sizes == 0)[:, None] | (np.arange(REACH)[None, :] < sizes[:, None])
    out = np.where(inside, found.hash[index], np.uint64(pad))
    flat = np.ascontiguousarray(out).tobytes()
    return pa.array([flat[i : i + 8 * REACH] for i in range(0, len(flat), 8 * REACH)], pa.binary())


def _marks(found: tb.Words, lengths: list[int], pad: int, bits: tb.Bitmap | None, rows: int) -> pa.Array:
    """For each row the kept hashes with position and surroundings; size 0 stands for winnowed ones."""
    at, h = winnow(found)
    size = np.zeros(len(at), dtype=np.int64)
    for k in lengths:
        more, g = tb.grams(found, k)
        at, h, size = np.append(at, more), np.append(h, g), np.append(size, np.full(len(more), k))
    if bits is not None:
        hit = bits.has(h)
        at, h, size = at[hit], h[hit], size[hit]
    order = np.argsort(found.row[at], kind="stable")
    at, h, size = at[order], h[order], size[order]
    bounds = np.searchsorted(found.row[at], np.arange(rows + 1)).astype(np.int32)
    inner = pa.StructArray.from_arrays(
        [pa.array(tb.signed(h)), pa.array(size.astype(np.int32)), pa.array((at - found.first[found.row[at]]).astype(np.int32)),
         _around(found, at, size, pad)], names=["mark", "size", "at", "around"],
    )
    return pa.ListArray.from_arrays(pa.array(bounds), inner)


def fingerprint_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per item: hash of its words, their number, and its marks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.blocks(batch.column(1)):
                found = tb.words(b)
                count = np.diff(found.first)
                marks = _marks(found, [], 1, None, b.rows)
                if ((count > 0) & (count < SPAN)).any():
                    parts = [marks]
                    for k in range(1, SPAN):
                        of = np.flatnonzero(count == k)
                        if len(of):
                            at = found.first[of]
                            gram_at, g = tb.grams(found, k)
                            h = g[np.searchsorted(gram_at, at)]
                            inner = pa.StructArray.from_arrays(
                                [pa.array(tb.signed(h)), pa.array(np.full(len(of), k, np.int32)), pa.array(np.zeros(len(of), np.int32)),
                                 _around(found, at, np.full(len(of), k), 1)], names=["mark", "size", "at", "around"])
                            bounds = np.searchsorted(of, np.arange(b.rows + 1)).astype(np.int32)
                            parts.append(pa.ListArray.from_arrays(pa.array(bounds), inner))
                    lists = [p.to_pylist() for p in parts]
                    marks = pa.array([sum(x, []) for x in zip(*lists, strict=True)], marks.type)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first, b.rows), pa.array(tb.signed(tb.row_hash(found))), pa.array(count.astype(np.int64)), marks],
                    names=["item_id", "item", "n_words", "marks"])

    kind = benchmark.schema[item_id].dataType.simpleString()
    return benchmark.select(item_id, text).mapInArrow(run, f"item_id {kind}, item bigint, n_words bigint, marks {MARKS}")


def fingerprint_documents(docs: DataFrame, lengths: list[int], bits: tb.Bitmap, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: a key of id and text, number of words, and the marks that the benchmark may have."""
    shared = docs.sparkSession.sparkContext.broadcast(bits.data)
    width = bits.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tb.Bitmap(width, shared.value)
        for batch in batches:
            for b in tb.blocks(batch.column(2)):
                found = tb.words(b)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first, b.rows), batch.column(1).slice(b.first, b.rows),
                     pa.array(np.diff(found.first), pa.int64()), _marks(found, lengths, 0, known, b.rows)],
                    names=["doc_id", "key", "n_words", "marks"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, row_key(doc_id, text), text).mapInArrow(run, f"doc_id {kind}, key bigint, n_words bigint, marks {MARKS}")


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        key, size, at, item = (np.asarray(batch.column(i)) for i in (0, 1, 2, 5))
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint64).reshape(-1, REACH) for i in (3, 4))
        same = a == b
        core = same[:, SIDE : SIDE + GRAM].all(axis=1)
        left = np.cumprod(same[:, SIDE - 1 :: -1], axis=1).sum(axis=1)
        right = np.cumprod(same[:, SIDE + GRAM :], axis=1).sum(axis=1)
        whole = np.cumprod(same, axis=1).sum(axis=1)
        short = size > 0
        good = np.where(short, whole >= size, core & (left + right >= SIDE))
        start = np.where(short, at, at - left)
        end = np.where(short, at + size, at + GRAM + right)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[good]), pa.array(item[good]), pa.array(start[good].astype(np.int32)), pa.array(end[good].astype(np.int32))],
            names=["key", "item", "start", "end"])


def find_hits(prints: DataFrame, items: DataFrame) -> DataFrame:
    """Key, item, start and end (words) of every shared passage around a shared mark."""
    seen = prints.select("key", F.explode("marks").alias("m")).select("key", "m.*").dropDuplicates(["key", "mark", "size", "at"])
    known = (
        items.select("item", F.explode("marks").alias("m")).select("item", "m.mark", "m.size", F.col("m.around").alias("other"))
        .dropDuplicates(["item", "mark", "size", "other"])
    )
    pairs = seen.join(known, ["mark", "size"]).select("key", "size", "at", "around", "other", "item")
    return pairs.mapInArrow(_extend, "key bigint, item bigint, start int, end int").distinct()


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(doc_id, text)


def prepare(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """Marks of the documents and of the items that hold a word; the items' are written."""
    items = materialize(fingerprint_items(benchmark, item_id, item_text).where("n_words > 0"), "items")
    lengths = sorted(r[0] for r in items.where(F.col("n_words") < SPAN).select("n_words").distinct().collect())
    known = set_bits(items.select(F.explode("marks.mark").alias("mark")), "mark", bits)
    return fingerprint_documents(docs, lengths, known, doc_id, text), items


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    bits: int = BITS,
) -> DataFrame:
    """The documents without a hit, with their own columns; equal rows go or stay together."""
    prints, items = prepare(docs, benchmark, doc_id, text, item_id, item_text, bits)
    key = fresh(docs, "key")
    bad = materialize(find_hits(prints, items).select(F.col("key").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, row_key(doc_id, text)).join(bad, key, "left_anti").select(*docs.columns)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    bits: int = BITS,
) -> DataFrame:
    """One row per document: doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged, in words)."""
    prints, items = prepare(docs, benchmark, doc_id, text, item_id, item_text, bits)
    prints = materialize(prints, "prints")
    hits = materialize(find_hits(prints, items), "hits")

    spans = hits.select("key", "start", "end").distinct()
    before = W.partitionBy("key").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("until", F.coalesce(F.max("end").over(before), F.lit(0)))
    spans = spans.withColumn("from", F.greatest("start", "until")).where("end > from")
    covered = spans.groupBy("key").agg(
        F.sum(F.col("end") - F.col("from")).cast("long").alias("n_hit"),
        F.sort_array(F.collect_list(F.struct(F.col("from").alias("start"), "end"))).alias("spans"),
    )
    names = items.where(F.col("item_id").isNotNull()).select("item", F.col("item_id").cast("string").alias("name")).distinct()
    listed = (
        hits.select("key", "item").distinct().join(names, "item").groupBy("key")
        .agg(F.array_sort(F.collect_set("name")).alias("items"))
    )
    out = prints.drop("marks").join(covered, "key", "left").join(listed, "key", "left")
    return out.select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "spans", "items",
    )


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query("op5_decontaminate", f"""
WITH w AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least({SPAN}, len(ws)) AS k, array_to_string(ws[i:i + least({SPAN}, len(ws)) - 1], ' ') AS win
  FROM b, unnest(range(1, len(ws) - least({SPAN}, len(ws)) + 2)) AS t(i) WHERE len(ws) > 0),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM w, (SELECT DISTINCT k FROM bw) AS ks, unnest(range(1, len(ws) - k + 2)) AS t(i)),
m AS (SELECT doc_id, i, k, CAST(item_id AS VARCHAR) AS item FROM dw JOIN bw USING (k, win)),
h AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, unnest(range(0, k)) AS t(j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)""")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")

