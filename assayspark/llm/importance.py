"""Target-distribution importance resampling over hashed word n-grams.

Features are all runs of 1 to ``n`` words, joined by one blank; the bucket of a feature is its CRC-32
modulo ``buckets``. Every text is written with one blank after each word and scanned once; the running
CRC at the words' edges gives the CRC of any run by cancelling the prefix before it (``crc``), so no
feature is ever made as a string. Bucket totals of the corpus and of the target text give a gain per
bucket; a document weighs the mean gain of its features, and Gumbel noise of its id on top makes the
highest scores a draw without replacement in proportion to exp(weight / 1000).

Totals are summed per task first: at most ``buckets`` rows of a task are shuffled, and the gains are
the one thing that is broadcast. Ranks come from ranges of (score, id): a written table of ranges
and their sizes, no window over all rows.

Defined cases: null texts and texts without words have no features and weigh 0; rows without an id use the
empty id for their noise and come last among equal scores; repeated rows count each and get ranks of
their own; an empty target gains by the corpus alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.llm import textblocks as tb
from assayspark.llm.crc import RunningCrc, between
from assayspark.llm.shared import fresh, materialize, query, small, table

ORDER = 2
BUCKETS = 10_000
SHARE = 25
LEAST_WORDS = 20
SEED = 7
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PLACE_BITS = 33  # of monotonically_increasing_id


def normalised(block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block in lower case, a blank after each; starts and ends of the words there; first word of each row."""
    inside = tb.WORD_BYTES[block.data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = block.offsets[1:-1]
    edges = edges[edges < len(inside)]
    begin[edges] = inside[edges]
    number = np.cumsum(begin)  # of the word that a byte belongs to, from 1
    ink = np.flatnonzero(inside)
    text = np.full(len(ink) + (int(number[-1]) if len(number) else 0), 32, dtype=np.uint8)
    text[np.arange(len(ink)) + number[ink] - 1] = _FOLD[block.data[ink]]
    sizes = np.bincount(number[ink] - 1, minlength=0) if len(ink) else np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    return text, ends - sizes, ends, np.searchsorted(np.flatnonzero(begin), block.offsets)


def feature_buckets(block: tb.Block, n: int, buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length 1..n the bucket of the run that begins at every word, -1 where the row ends before; first word of each row."""
    text, start, end, first = normalised(block)
    running = RunningCrc(text)
    before, after = running.at(start), running.at(end)
    row = np.repeat(np.arange(block.rows), np.diff(first))
    out = []
    for k in range(1, n + 1):
        found = np.full(len(start), -1, dtype=np.int64)
        m = max(len(start) - k + 1, 0)
        at = np.flatnonzero(row[:m] == row[k - 1 :])
        found[at] = between(start[at], end[at + k - 1], before[at], after[at + k - 1]) % np.uint32(buckets)
        out.append(found)
    return out, first


def bucket_counts(df: DataFrame, text: str, n: int, buckets: int) -> DataFrame:
    """(bucket, times) over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets + 1, dtype=np.int64)
        for batch in batches:
            for block in tb.blocks(batch.column(0)):
                for found in feature_buckets(block, n, buckets)[0]:
                    total += np.bincount(found + 1, minlength=buckets + 1)
        used = np.flatnonzero(total[1:])
        yield pa.record_batch({"bucket": used, "times": total[1:][used]})

    return df.select(text).mapInArrow(run, "bucket bigint, times bigint").groupBy("bucket").agg(F.sum("times").alias("times"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str, target_text: str, n: int, buckets: int) -> np.ndarray:
    """floor(1000 ln) of the target's share of a bucket over the corpus's, one added to every bucket."""
    counts = bucket_counts(docs, text, n, buckets).select("bucket", F.col("times").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        bucket_counts(target, target_text, n, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("times").alias("t")))
    known = counts.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # at most ``buckets`` rows
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in known:
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray, doc_id: str, text: str, n: int) -> DataFrame:
    """(doc_id, key, n_words, n_features, weight) of every row; equal rows have the same key."""
    shared = docs.sparkSession.sparkContext.broadcast(np.append(gains, 0))  # the last is for -1
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in small(batches):
            for block in tb.blocks(batch.column(2)):
                found, first = feature_buckets(block, n, buckets)
                times = sum((tb.per_row(f >= 0, first) for f in found), np.zeros(block.rows, np.int64))
                total = sum((tb.per_row(gain[f], first) for f in found), np.zeros(block.rows, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.rows), batch.column(1).slice(block.first, block.rows), pa.array(np.diff(first), pa.int64()),
                     pa.array(times), pa.array(total // np.maximum(times, 1))], names=["doc_id", "key", "n_words", "n_features", "weight"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.xxhash64(doc_id, text), text).mapInArrow(run, f"doc_id {kind}, key bigint, n_words bigint, n_features bigint, weight bigint")


def ranked(rows: DataFrame) -> DataFrame:
    """The rows with ``rank`` (1, 2, 3, ...) by falling score, then id. ``rows`` is a written table."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("key")]
    place = F.monotonically_increasing_id()
    dealt = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
        "part": F.shiftright(place, _PLACE_BITS).cast("int"), "place": place.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))}), "ranges")
    sizes = sorted(tuple(r) for r in dealt.groupBy("part").count().collect())  # one row per partition
    before = [0, *accumulate(n for _, n in sizes)]
    starts = dict(zip([p for p, _ in sizes], before, strict=False))
    first = F.get(F.lit([starts.get(p, 0) for p in range(max(starts, default=0) + 1)]).cast("array<bigint>"), F.col("part"))
    return dealt.withColumn("rank", first + F.col("place") + 1).drop("part", "place")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", share: int = SHARE,
    n: int = ORDER, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, key, n_words, n_features, weight, score, and the rank of the drawn ones:
    ``share`` per cent of the documents with at least ``least_words`` words."""
    gains = bucket_gains(docs, target, text, target_text, n, buckets)
    found = weights(docs, gains, doc_id, text, n)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = materialize(found.withColumn("score", F.col("weight") + noise), "scores")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * share // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked(scored.where(able)).withColumn("rank", rank).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **given) -> DataFrame:
    """The drawn documents with their own columns; equal rows are drawn together."""
    key = fresh(docs, "key")
    kept = resample(docs, target, doc_id, text, **given).where("rank IS NOT NULL").select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64(doc_id, text)).join(kept, key, "left_semi").select(*docs.columns)


_FEATURES_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query("op13_importance", rf"""
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS step),
d AS (SELECT row_number() OVER () AS r, doc_id, {_FEATURES_SQL} AS w FROM documents),
b AS (SELECT {_FEATURES_SQL} AS w FROM benchmark),
df AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
bf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
dn AS (SELECT r, f, count(*) AS n FROM df GROUP BY ALL),
u AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM dn UNION SELECT f FROM bf)),
c AS (SELECT f, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
  lambda a, v: xor(a // 256, step[xor(a, v) % 256 + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket FROM u, k),
s AS (SELECT bucket, sum(n) AS s FROM dn JOIN c USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN c USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + {BUCKETS})
  / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + {BUCKETS})))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)),
x AS (SELECT r, CAST(sum(n) AS BIGINT) AS n, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight FROM dn JOIN c USING (f) JOIN g USING (bucket) GROUP BY r),
p AS (SELECT r, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
  (CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN x USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM p WHERE words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {SHARE} * n // 100 THEN rank END AS rank FROM p LEFT JOIN o USING (r)""")
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
