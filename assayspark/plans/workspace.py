"""Shared folder for results that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_private: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder named by the session; a private one only for local masters."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors can reach")
    if not _private:
        _private.append(tempfile.mkdtemp(prefix="assayspark-"))
    return _private[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; paths are never reused."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write and read back: cuts the lineage and survives the loss of executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
