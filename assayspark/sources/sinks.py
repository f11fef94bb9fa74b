"""Writers and the tables they write."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.operators.models import FittedPipeline, FittedSvr, FourierMap
from assayspark.operators.prepare import Scaler

# Column order of the history export.
HISTORY_COLUMNS = (
    "id", "username", "task_type", "algorithm", "data_source", "metrics", "params",
    "n_samples", "duration_sec", "status", "created_at",
)


def export_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    """Write the whole table in one of Spark's formats, one file per task."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    return path


def predictions_table(rows: DataFrame, actual: str, predicted: str, split: str = "split") -> DataFrame:
    """(split, y_actual, y_pred, residual) for all splits in one pass."""
    return rows.select(
        F.col(split).alias("split"),
        F.col(actual).alias("y_actual"),
        F.col(predicted).alias("y_pred"),
        (F.col(actual) - F.col(predicted)).alias("residual"),
    )


def history_export(history: DataFrame, columns: Sequence[str] = HISTORY_COLUMNS, newest: str = "id") -> DataFrame:
    """History rows in export order, missing values as empty text, newest first."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    return history.orderBy(F.col(newest).desc()).select(*[text(c) for c in columns])


def write_history(history: DataFrame, path: str) -> str:
    """CSV with every field quoted."""
    history.write.option("header", True).option("quoteAll", True).csv(path)
    return path


def save_model(
    spark: SparkSession,
    model: FittedPipeline | FittedSvr,
    path: str,
    name: str,
    target: str,
    params: Mapping[str, object],
    data_source: str = "real",
) -> str:
    """Store a fitted model with its scaler, and a one-row description beside it.

    Pipelines are stored by Spark; a support vector model is its numbers: weights and, for the
    RBF kernel, the map.
    """
    about: dict[str, object] = {"features": list(model.features), "scaler": None}
    if model.scaler is not None:
        about["scaler"] = {"mean": model.scaler.mean, "std": model.scaler.std}
    if isinstance(model, FittedSvr):
        about |= {"kind": "svr", "weights": model.weights.tolist(), "losses": list(model.losses), "converged": model.converged}
        if model.mapping is not None:
            about |= {"frequencies": model.mapping.frequencies.tolist(), "phases": model.mapping.phases.tolist()}
    else:
        about["kind"] = "pipeline"
        model.model.write().overwrite().save(f"{path}/model")
    described = [(name, list(model.features), target, json.dumps(dict(params), sort_keys=True), data_source, spark.version, json.dumps(about))]
    spark.createDataFrame(
        described,
        "model_name string, feature_cols array<string>, target_col string, params string, "
        "data_source string, spark_version string, state string",
    ).write.mode("overwrite").json(f"{path}/about")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[FittedPipeline | FittedSvr, DataFrame]:
    """The fitted model, ready to predict, and its description."""
    about = spark.read.json(f"{path}/about")
    state = json.loads(about.first()["state"])
    scaler = Scaler(**state["scaler"]) if state["scaler"] else None
    features = tuple(state["features"])
    if state["kind"] == "pipeline":
        return FittedPipeline(PipelineModel.load(f"{path}/model"), features, scaler), about.drop("state")
    mapping = FourierMap(np.array(state["frequencies"]), np.array(state["phases"])) if "phases" in state else None
    return FittedSvr(features, scaler, np.array(state["weights"]), mapping, tuple(state["losses"]), state["converged"]), about.drop("state")
