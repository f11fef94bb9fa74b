"""From raw documents to packed training sequences, one operator of ``assayspark.llm`` per stage.

Every stage reads what the one before it wrote, works on all of it, and its decisions take effect.
An empty table passes through all stages; nulls, ties and repeated rows are treated as the
operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayspark.llm import decontaminate, near_duplicates, packing, pii, quality_rules
from assayspark.llm.shared import materialize, table
from assayspark.session import ship_package


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship_package(spark)
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest id."""
    ship_package(spark)
    return near_duplicates.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced by the name of their kind."""
    ship_package(spark)
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces get a sequence and a place in it."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", rules), ("near_duplicates", dedup), ("decontaminate", clean), ("pii", sanitise), ("best_fit_packing", pack),
]

#: Near duplicates and packing have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
