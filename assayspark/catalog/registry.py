"""Where the bindings are collected, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.functions.columns import hash_below, wall_micros
from assayspark.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SEED = 70


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it, its counterpart."""
    def keep(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def round_all(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[rounded(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    """SQL twin of ``rounded``."""
    text = f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0::DOUBLE"
    return f"{text} AS {name}" if name else text


def uniform_sql(seed: object, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return (
        f"((CAST(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE)"
        " / 4503599627370496::DOUBLE)"
    )


def below_sql(share: float, seed: object, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(substr(md5({text}), 1, 8) < '{int(share * 2**32):08x}')"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as run history."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
        F.lit("train").alias("task_type"),
        F.col("event_type").alias("algorithm"),
        F.when(F.col("value") < 50, "real").otherwise("gan").alias("data_source"),
        F.col("props").alias("metrics"),
        F.lit(None).cast("string").alias("params"),
        F.get_json_object("props", "$.k").cast("int").alias("n_samples"),
        F.col("value").alias("duration_sec"),
        F.lit("done").alias("status"),
        F.col("ts").alias("created_at"),
    )


HISTORY_SQL = """(SELECT event_id AS id, user_id, 'user_' || user_id AS username, 'train' AS task_type,
  event_type AS algorithm, CASE WHEN value < 50 THEN 'real' ELSE 'gan' END AS data_source,
  props AS metrics, CAST(NULL AS VARCHAR) AS params,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS n_samples, value AS duration_sec,
  'done' AS status, ts AS created_at FROM events)"""


def micros(column: str, name: str) -> Column:
    """Timestamp as whole microseconds, the same in every engine."""
    return wall_micros(column).alias(name)


def split_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a split and a prediction: quantity times the mean unit price."""
    lines = table(spark, sf_dir, "lineitem")
    unit = lines.agg(F.sum("l_extendedprice") / F.sum("l_quantity")).first()[0]
    return lines.select(
        *LINE_KEY,
        F.when(hash_below(0.2, SEED, *LINE_KEY), "test").otherwise("train").alias("split"),
        F.col("l_extendedprice").alias("y_actual"),
        (F.col("l_quantity") * F.lit(unit)).alias("y_pred"),
    )


PREDICTIONS_SQL = f"""(SELECT {LINE_KEY_SQL},
  CASE WHEN {below_sql(0.2, SEED, *LINE_KEY)} THEN 'test' ELSE 'train' END AS split,
  l_extendedprice AS y_actual,
  l_quantity * (SELECT sum(l_extendedprice) / sum(l_quantity) FROM lineitem) AS y_pred FROM lineitem)"""
