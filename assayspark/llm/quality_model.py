"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Learning takes at most ``ROWS`` labelled documents, those with the smallest hash of their id, so
the driver sees a matrix of ``ROWS`` by the number of statistics however many labels there are.
Scoring is one pass without a shuffle: statistics of a block of texts, then every tree at once.

Defined cases: a null text is empty, and an empty text is scored from its all-zero statistics;
several labels for one id count as the largest; without labels every score is 0.5; rows are scored
one by one, so repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.llm import boosting, docstats
from assayspark.llm import textblocks as tb
from assayspark.llm.shared import append_columns, crc_mod, query, table

ROWS = 20_000
CUT = 0.3
NAMES = [f"stat_{f}" for f in docstats.FEATURES]


def _matrix(texts: pa.Array) -> np.ndarray:
    parts = [docstats.features(b) for b in tb.blocks(texts, 800_000)]
    return np.concatenate(parts) if parts else np.zeros((0, len(docstats.FEATURES)), np.float32)


def fit_quality(
    docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = ROWS,
) -> boosting.Forest:
    """A forest from the labelled documents for which ``learn`` (a condition on the label table) holds."""
    known = labels.where(learn & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("__y"))
    chosen = known.orderBy(F.xxhash64(doc_id), doc_id).limit(rows)
    found = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id).select(F.col(text).alias("text"), "__y")
    measured, names = append_columns(found, "text", dict.fromkeys(NAMES, "float"), lambda t: list(map(pa.array, _matrix(t).T)))
    table_ = measured.select("__y", *names).toPandas()
    return boosting.fit(table_[names].to_numpy(dtype=np.float32), table_["__y"].to_numpy(dtype=np.float64))


def score_quality(docs: DataFrame, forest: boosting.Forest, text: str = "text") -> tuple[DataFrame, str]:
    """The documents with the probability of label 1, and the name of that column."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    out, names = append_columns(docs, text, {"score": "double"}, lambda t: [pa.array(shared.value.score(_matrix(t)))])
    return out, names[0]


@query("op2_quality_model")
def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = fit_quality(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    scored, score = score_quality(docs, forest)
    return scored.select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col(score).alias("score"),
        F.when(F.col(score) >= CUT, 1).otherwise(0).cast("int").alias("predicted"))
