"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.catalog.registry import (
    HISTORY_SQL, LINE_KEY, LINE_KEY_SQL, PREDICTIONS_SQL, history, query, r, round_all, rounded,
    split_predictions, table,
)
from assayspark.operators import evaluate, models
from assayspark.plans.workspace import fresh_path
from assayspark.roles import TableRoles
from assayspark.sources import naming, sinks, tables, vectors


@query("src_read", "SELECT * FROM orders")
def src_read(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_table(spark, f"{sf}/orders.parquet")


@query("src_normalize_columns", """
SELECT c_custkey AS "cust key", c_name AS "name (full)", c_nationkey AS nation, c_acctbal AS balance,
       c_mktsegment AS segment FROM customer""")
def src_normalize_columns(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "customer").toDF(" Cust   Key ", "Name （Full）", "NATION", "Balance ", " segment")
    return tables.normalize_columns(raw)[0]


@query("src_resolve_target", 'SELECT o_orderkey, o_totalprice AS "Vickers Hardness (HV)" FROM orders')
def src_resolve_target(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias(" 硬度（HV） "))
    return tables.resolve_target(raw)


@query("src_unit_convert", f"""
SELECT o_orderkey, {r("CASE WHEN o_orderstatus = 'P' THEN o_totalprice / 102 * 102 ELSE o_totalprice END", "hv", 4)}
FROM orders""")
def src_unit_convert(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("hv"),
        (F.col("o_totalprice") / 102).alias("gpa"),
    )
    return round_all(tables.unit_convert(raw, "hv", "gpa"), "hv", digits=4)


@query("src_schema", """
SELECT v.name, v.kind, v.role, c.n_rows FROM (VALUES
 ('p_partkey', 'number', 'other'), ('p_name', 'text', 'other'), ('p_brand', 'text', 'other'),
 ('p_type', 'text', 'other'), ('p_size', 'number', 'composition'), ('p_retailprice', 'number', 'target')
) AS v(name, kind, role), (SELECT count(*) AS n_rows FROM part) AS c""")
def src_schema(spark: SparkSession, sf: str) -> DataFrame:
    roles = TableRoles(key=("p_partkey",), composition=("p_size",), target="p_retailprice")
    return tables.describe_schema(table(spark, sf, "part"), roles)


@query("src_column_groups", "SELECT event_id, user_id, value FROM events")
def src_column_groups(spark: SparkSession, sf: str) -> DataFrame:
    return tables.select_group(table(spark, sf, "events"), "composition", ("value",))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


@query("src_attach_vectors", """
SELECT d.doc_id, d.lang, d.source, d.n_chars, e.label, CAST(t.i - 1 AS INTEGER) AS place, CAST(e.embedding[t.i] AS DOUBLE) AS value
FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id, unnest(range(1, len(e.embedding) + 1)) AS t(i)""")
def src_attach_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector goes out to a file of its own and comes back through the file source, number by number."""
    folder = fresh_path(spark, "vectors")
    stored = _vectors(spark, sf)
    vectors.write_vectors(stored, "doc_id", "embedding", folder)
    read = vectors.read_vectors(spark, folder).select(F.col("name").cast("bigint").alias("doc_id"), "vector")
    joined = tables.attach_vectors(tables.attach_vectors(_samples(spark, sf), read, "doc_id"), stored.select("doc_id", "label"), "doc_id")
    return joined.select("doc_id", "lang", "source", "n_chars", "label", F.posexplode("vector").alias("place", "value")).withColumn("value", F.col("value").cast("double"))


@query("src_missing_vectors", """
SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def src_missing_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tables.missing_vectors(_samples(spark, sf), _vectors(spark, sf), "doc_id")


@query("src_append_aligned", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def src_append_aligned(spark: SparkSession, sf: str) -> DataFrame:
    batch = table(spark, sf, "supplier").toDF("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return tables.append_aligned(table(spark, sf, "customer"), batch.withColumn("unknown", F.lit(1)))


@query("src_ingest", f"""SELECT o_orderkey, {r("o_totalprice / 100 * 102", '"Vickers Hardness (HV)"', 4)} FROM orders""")
def src_ingest(spark: SparkSession, sf: str) -> DataFrame:
    upload = fresh_path(spark, "upload")
    raw = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("Hardness (GPa)"))
    sinks.export_table(raw, upload + ".csv", "csv")
    schema = "o_orderkey bigint, `Hardness (GPa)` double"
    stored = tables.ingest(spark, upload + ".csv", upload + ".parquet", schema=schema)
    return round_all(stored, naming.TARGET_NAME, digits=4)


@query("snk_export", "SELECT * FROM orders")
def snk_export(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    path = sinks.export_table(orders, fresh_path(spark, "export") + ".csv", "csv")
    return tables.read_table(spark, path, schema=orders.schema)


@query("snk_predictions", f"""
SELECT split, y_actual, {r("y_pred", "y_pred", 4)}, {r("y_actual - y_pred", "residual", 4)} FROM {PREDICTIONS_SQL}""")
def snk_predictions(spark: SparkSession, sf: str) -> DataFrame:
    made = sinks.predictions_table(split_predictions(spark, sf), "y_actual", "y_pred")
    stored = sinks.export_table(made, fresh_path(spark, "predictions"))
    return round_all(spark.read.parquet(stored), "y_pred", "residual", digits=4)


METRICS_BODY = """
  count(*) AS n, sqrt(avg((y_actual - y_pred) ** 2)) AS rmse, avg(abs(y_actual - y_pred)) AS mae,
  1 - sum((y_actual - y_pred) ** 2) / (var_pop(y_actual) * count(*)) AS r2,
  100 * avg(abs((y_actual - y_pred) / y_actual)) AS mape"""


@query("snk_metrics_report", f"""
SELECT split, n, {r("rmse", "rmse", 2)}, {r("mae", "mae", 2)}, {r("r2", "r2", 4)}, {r("mape", "mape", 2)}
FROM (SELECT split, {METRICS_BODY} FROM {PREDICTIONS_SQL} GROUP BY split)""")
def snk_metrics_report(spark: SparkSession, sf: str) -> DataFrame:
    table_ = evaluate.metrics(split_predictions(spark, sf), "y_actual", "y_pred", ["split"])
    stored = sinks.export_table(evaluate.display(table_), fresh_path(spark, "metrics"))
    return spark.read.parquet(stored)


@query("snk_model", f"""
WITH f AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem),
w AS (SELECT regr_slope(l_extendedprice, (l_quantity - m) / s) AS b, regr_intercept(l_extendedprice, (l_quantity - m) / s) AS a FROM lineitem, f)
SELECT {LINE_KEY_SQL}, 'LR' AS model_name, 'l_extendedprice' AS target_col, {r("a + b * (l_quantity - m) / s", "prediction", 3)}
FROM lineitem, f, w""")
def snk_model(spark: SparkSession, sf: str) -> DataFrame:
    """A scaled model, stored, loaded and used."""
    lines = table(spark, sf, "lineitem")
    fitted = models.fit_linear(lines, ["l_quantity"], "l_extendedprice", scale=True)
    path = sinks.save_model(spark, fitted, fresh_path(spark, "model"), "LR", "l_extendedprice", {"scale": True})
    loaded, about = sinks.load_model(spark, path)
    told = about.first()
    return loaded.predict(lines).select(
        *LINE_KEY, F.lit(told["model_name"]).alias("model_name"), F.lit(told["target_col"]).alias("target_col"),
        rounded("prediction", 3).alias("prediction"))


@query("snk_history_export", f"""
SELECT CAST(id AS VARCHAR) AS id, username, task_type, algorithm, data_source, metrics, '' AS params,
  CAST(n_samples AS VARCHAR) AS n_samples, CAST(duration_sec AS VARCHAR) AS duration_sec, status,
  regexp_replace(CAST(created_at AS VARCHAR), '\\.?0+$', '') AS created_at FROM {HISTORY_SQL}""")
def snk_history_export(spark: SparkSession, sf: str) -> DataFrame:
    rows = sinks.history_export(history(spark, sf))
    path = sinks.write_history(rows, fresh_path(spark, "history") + ".csv")
    stored = spark.read.option("header", True).option("escape", "\\").schema(rows.schema).csv(path)
    return stored.na.fill("")
