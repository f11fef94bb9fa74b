"""Filter interaction audit: what every order of the filters removes at every step.

A document is reduced to the set of filters it fails. ``left[S]``, the number of documents that pass
all filters of S, gives every edge (S, f) of the subset lattice what filter f removes after S. Path
counting from both ends tells in how many orders an edge lies: orders that reach S (forward) times
orders that leave S + f (backward). These counts weight the edges for the Shapley sums; the steps of
single orders are read from the same edges.

The texts are read once, into rows of (id, part, digest, set of failures); only those are shuffled.
A copy is a text whose 128-bit digest a smaller id has: the smallest id per digest is worked out with
map-side combination and joined on digest *and* id, so a large group of copies is no hot key.

Defined cases: a null text is empty, and a null part the empty string; an empty text fails A only
(and E where a smaller id is empty too); rows without an id neither are copies nor make any, and have
no label; repeated rows with one id are no copies of each other and count each; a document has a label
if any of its label rows says so. Tables without rows give none. Distinct words are counted by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayspark.llm import textblocks as tb
from assayspark.llm.shared import materialize, query, small, table

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b"#$%&*|")] = True


def text_counts(block: tb.Block) -> dict[str, np.ndarray]:
    """Per text: words, distinct words, capitals, code points and marks."""
    found = tb.words(block, tb.INK_BYTES, folded=False)
    _, again = tb.repeated(found.row, found.hash)
    return {
        "words": np.diff(found.first),
        "distinct": tb.per_row(~again, found.first),
        "capitals": tb.per_row(_UPPER[block.data], block.offsets),
        "chars": tb.per_row((block.data & 0xC0) != 0x80, block.offsets),
        "marks": tb.per_row(_MARKS[block.data], block.offsets),
    }


#: What a text of its own fails by; the filter after the last of these is that for copies.
TEXT_FILTERS: dict[str, Callable[[dict[str, np.ndarray]], np.ndarray]] = {
    "A": lambda n: n["words"] < 100,
    "B": lambda n: 100 * n["distinct"] < 80 * n["words"],
    "C": lambda n: 100 * n["capitals"] > 10 * n["chars"],
    "D": lambda n: n["marks"] > 0,
}
COPIES = "E"


def failures(docs: DataFrame, doc_id: str, text: str, part: str, filters: dict[str, Callable]) -> DataFrame:
    """(doc_id, part, digest, mask) of every document, without the filter for copies."""
    rules = list(filters.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            masks = []
            for block in tb.blocks(batch.column(3)):
                counts = text_counts(block)
                masks.append(sum((rule(counts).astype(np.int32) << i for i, rule in enumerate(rules)), np.zeros(block.rows, np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.concatenate(masks) if masks else np.zeros(0, np.int32), pa.int32())],
                names=["doc_id", "part", "digest", "mask"])

    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.md5(t.cast("binary"))).alias("digest"), t.alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, part string, digest binary, mask int")


def tally(facts: DataFrame, labels: DataFrame, bit: int) -> DataFrame:
    """(part, mask, n, good, toxic); ``facts`` is a written table, ``bit`` that of the filter for copies."""
    named = facts.where(F.col("doc_id").isNotNull()).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    firsts = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1))).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = named.join(firsts, ["digest", "doc_id"], "left").join(marked, "doc_id", "left")
    count = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), F.col("n")).otherwise(0).cast("long").alias(c)
    mask = F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(bit)))
    rows = rows.select("part", mask.alias("mask"), "n", count("good"), count("toxic"))
    nameless = facts.where(F.col("doc_id").isNull()).select(
        "part", "mask", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return rows.unionByName(nameless).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """Number of orders that reach each set of filters from none, and that lead from it to all."""
    full = (1 << n) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(1, full + 1):
        forward[state] = sum(forward[state ^ 1 << f] for f in range(n) if state >> f & 1)
    for state in range(full - 1, -1, -1):
        backward[state] = sum(backward[state | 1 << f] for f in range(n) if not state >> f & 1)
    return forward, backward


def lattice_steps(counts: DataFrame, letters: str) -> DataFrame:
    """All steps of all orders for every part, from the counts per set of failures."""
    n, size = len(letters), 1 << len(letters)
    # documents that pass all filters of a set, for all sets
    left = {c: F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == 0, F.col(c)).otherwise(0)) for s in range(size)]).alias(c) for c in ("n", "good", "toxic")}
    parts = counts.groupBy("part").agg(*left.values())
    forward, backward = path_counts(n)

    def removed(state: int, f: int) -> Column:
        return F.get("n", F.lit(state)) - F.get("n", F.lit(state | 1 << f))

    edges = [[(s, forward[s] * backward[s | 1 << f]) for s in range(size) if not s >> f & 1] for f in range(n)]
    parts = parts.select("*", F.array(*[sum((removed(s, f) * F.lit(w) for s, w in edges[f]), F.lit(0)) for f in range(n)]).alias("shapley"))
    orders = list(permutations(range(n)))
    before = [[sum(1 << f for f in order[:k]) for k in range(n)] for order in orders]
    # one row per part, order and step
    rows = parts.select("*", F.posexplode(F.lit(["".join(letters[f] for f in order) for order in orders])).alias("at", "filter_order"))
    rows = rows.select("*", F.explode(F.lit(list(range(1, n + 1)))).alias("step"))
    place = F.col("at") * n + F.col("step") - 1
    rows = rows.withColumn("f", F.get(F.lit([f for order in orders for f in order]), place)).withColumn("s", F.get(F.lit([s for row in before for s in row]), place))
    bit = F.expr("shiftleft(1, f)")
    rows = rows.withColumn("after", F.col("s").bitwiseOR(bit)).withColumn("bit", bit)
    gone = lambda c: F.get(c, F.col("s")) - F.get(c, F.col("after"))
    full = size - 1
    return rows.select(
        "part", "filter_order", "step", F.get("n", F.col("after")).alias("kept"), gone("n").alias("removed"),
        (F.get("n", F.lit(0)) - F.get("n", F.col("bit")) - gone("n")).alias("redundant"),
        (F.get("n", F.lit(full) - F.col("bit")) - F.get("n", F.lit(full))).alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("shapley", F.col("f")).cast("long").alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang", filters: dict[str, Callable] | None = None) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley. ``filters`` are up to seven tests of ``text_counts``; that for copies is added."""
    filters = TEXT_FILTERS if filters is None else filters
    facts = materialize(failures(docs, doc_id, text, part, filters), "failures")
    labels = labels.select("doc_id", F.col("quality").cast(T.IntegerType()).alias("quality"), F.col("toxic").cast(T.IntegerType()).alias("toxic"))
    return lattice_steps(tally(facts, labels, 1 << len(filters)), "".join(filters) + COPIES)


@query("op12_filter_audit", r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM t),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN least < w.doc_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, filter_order[step] AS x,
  sum(n) FILTER (translate(fails, filter_order[:step], '') = fails) AS kept,
  sum(n) FILTER (contains(fails, filter_order[step]) AND translate(fails, filter_order[:step - 1], '') = fails) AS removed,
  sum(n) FILTER (contains(fails, filter_order[step]) AND translate(fails, filter_order[:step - 1], '') <> fails) AS redundant,
  sum(n) FILTER (fails = filter_order[step]) AS unique_fails,
  sum(good) FILTER (contains(fails, filter_order[step]) AND translate(fails, filter_order[:step - 1], '') = fails) AS good_lost,
  sum(toxic) FILTER (contains(fails, filter_order[step]) AND translate(fails, filter_order[:step - 1], '') = fails) AS toxic_lost
  FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r""")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
