"""Quality rules whose limits adapt to each language and source.

Counts are taken per document in vectorised batches. A rate is ``(count + 1/2) / (size + 1)``, so a
text without any symbol still says how rare symbols can be in a text of its length, and groups in
which most counts are 0 have a scale of their own. Rates are summarised by mergeable quantile
sketches: logarithmic buckets of relative width ``GAMMA - 1`` with a count each, so that sketches
merge by adding counts, in any order, with the same result. A rate that cannot exceed ``top`` (0.2
for repeats, what the base rule lets through) is put into buckets as ``rate / (top - rate)``, so its
limit stays under ``top`` however wide the quartiles stand. Copies of a text count once in a group. The limit
of a group is the bucket ``SPREADS`` times the distance of the quartile buckets above the third; it
comes from the group's texts alone. A count of 0 never fails. Groups under ``MIN_ROWS`` different texts use
the sketch of their language, small languages that of all documents.

Defined cases: a null or empty text has no words and fails the base rule; null languages and
sources are groups of their own; repeated rows count each time and get equal verdicts; an empty
table gives an empty result; existing columns are kept, new ones step aside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayspark.llm import docstats
from assayspark.llm import textblocks as tb
from assayspark.llm.shared import append_columns, fresh, materialize, query, table

GAMMA = 1.02
SPREADS = 3
MIN_ROWS = 200
END = 10_000
SHARES = ["symbols", "dup_lines", "repeats", "capitals"]
#: What is counted for each share, and in how many.
PARTS = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_upper", "n_letters")}
#: Largest value of a share in rows that pass the base rule; symbols have none.
TOPS = {"dup_lines": 1.0, "repeats": 0.2, "capitals": 1.0}


def _count(texts: pa.Array) -> list[pa.Array]:
    parts = [docstats.base_counts(b) for b in tb.blocks(texts)]
    return [pa.array(np.concatenate([p[c] for p in parts]), pa.int64()) for c in docstats.COUNTS]


def measure(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The documents with their counts; also the name that each count has there."""
    out, names = append_columns(docs, text, dict.fromkeys(docstats.COUNTS, "bigint"), _count)
    return out, dict(zip(docstats.COUNTS, names, strict=True))


def base_failed(names: dict[str, str]) -> Column:
    words, repeats = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    return (words < 10) | (100 * repeats > 20 * words)


def bucket(value: Column) -> Column:
    """Number of the logarithmic bucket of a positive value; ``END`` for what has no bound."""
    return F.coalesce(F.ceil(F.log(value) / float(np.log(GAMMA))), F.lit(END)).cast("int")


def middle(index: Column) -> Column:
    return F.pow(F.lit(GAMMA), index.cast("double")) * (2 / (1 + GAMMA))


def buckets(names: dict[str, str]) -> dict[str, Column]:
    """The bucket of each rate; on the scale of odds where a rate has a top."""
    out = {}
    for share, (count, size) in PARTS.items():
        rate = (F.col(names[count]) + 0.5) / (F.col(names[size]) + 1.0)
        top = TOPS.get(share)
        out[share] = bucket(rate if top is None else F.when(rate < top, rate / (top - rate)))
    return out


def body(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sketches(measured: DataFrame, names: dict[str, str], lang: str, source: str, text: Column) -> DataFrame:
    """Different texts per language, source, share and bucket; documents that pass the base rule only.

    ``text`` is a hash of the text. ``n2`` counts a text once in each source, ``n1`` in each language, ``n0`` in all.
    """
    at = [v.alias(k) for k, v in buckets(names).items()]
    texts = measured.where(~base_failed(names)).select(text.alias("body"), F.col(lang).alias("lang"), F.col(source).alias("source"), *at)
    texts = texts.groupBy("body", "lang", "source").agg(*[F.first(k).alias(k) for k in SHARES])
    first = lambda keys, order: (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1).cast("long")
    texts = texts.withColumns({"n1": first(["body", "lang"], ["source"]), "n0": first(["body"], ["lang", "source"])})
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("share"), F.col(k).alias("bucket")) for k in SHARES]))
    return texts.select("lang", "source", "n0", "n1", cells.alias("cell")).groupBy("lang", "source", "cell.share", "cell.bucket").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("n2"))


def limits(cells: DataFrame) -> DataFrame:
    """One row per language and source: the last bucket allowed for every share, from the smallest large enough group."""
    levels = []
    for level, keys in enumerate([[], ["lang"], ["lang", "source"]]):
        merged = cells.groupBy(*keys, "share", "bucket").agg(F.sum(f"n{level}").alias("n"))
        group = W.partitionBy(*keys, "share")
        running = merged.withColumns({
            "up_to": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group),
        })
        quartile = lambda q: F.min(F.when(F.col("up_to") >= q * F.col("total"), F.col("bucket")))
        fences = running.groupBy(*keys, "share").agg(
            F.max("total").alias("rows"), quartile(0.25).alias("low"), quartile(0.75).alias("high"),
        ).withColumn("limit", F.col("high") + SPREADS * (F.col("high") - F.col("low")))
        levels.append(fences.groupBy(*keys).agg(
            F.max("rows").alias(f"rows{level}"),
            *[F.max(F.when(F.col("share") == s, F.col("limit"))).alias(f"{s}{level}") for s in SHARES],
        ))
    everything, by_lang, by_source = levels
    overall = everything.first().asDict()  # one row: the limits over all documents
    joined = by_source.alias("s").join(by_lang.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")))
    pick = lambda s: (
        F.when(F.col("rows2") >= MIN_ROWS, F.col(f"{s}2")).when(F.col("rows1") >= MIN_ROWS, F.col(f"{s}1"))
        .otherwise(F.lit(overall.get(f"{s}0")).cast("int"))
    )
    return joined.select(F.col("s.lang").alias("lang"), F.col("s.source").alias("source"), *[pick(s).alias(s) for s in SHARES])


def judge(measured: DataFrame, names: dict[str, str], fences: DataFrame, lang: str, source: str) -> DataFrame:
    """Adds ``base_failed`` and ``kept``; the limits are a small table written before."""
    failed, kept = fresh(measured, "base_failed"), fresh(measured, "kept")
    fences = fences.select(*[F.col(c).alias(f"__limit_{c}") for c in fences.columns])
    within = [(F.col(names[PARTS[k][0]]) == 0) | (v <= F.coalesce(F.col(f"__limit_{k}"), v)) for k, v in buckets(names).items()]
    good = ~base_failed(names)
    for test in within:
        good = good & test
    joined = measured.join(
        fences, F.col(lang).eqNullSafe(F.col("__limit_lang")) & F.col(source).eqNullSafe(F.col("__limit_source")), "left",
    )
    return joined.withColumns({failed: base_failed(names), kept: good}).drop(*fences.columns)


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """All documents with counts, ``base_failed`` and ``kept``; the text is read twice, never shuffled for the limits."""
    measured, names = measure(docs, text)
    fences = materialize(limits(materialize(sketches(measured, names, lang, source, body(text)), "sketch")), "limits")
    return judge(measured, names, fences, lang, source)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    judged = quality_rules(docs)
    return judged.where(F.col(judged.columns[-1])).select(*docs.columns)


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured, names = measure(docs)
    measured = materialize(measured.withColumn("body", body()).drop("text"), "counts")
    fences = materialize(limits(materialize(sketches(measured, names, "lang", "source", F.col("body")), "sketch")), "limits")
    return judge(measured, names, fences, "lang", "source").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source",
    )
