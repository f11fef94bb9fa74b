"""Structured Streaming versions of the status and screening operators.

All jobs read files as a stream and run with ``availableNow``, so the same code serves a
scheduled batch and, with another trigger, a running stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from assayspark.functions.columns import nan_to_null, row_sum
from assayspark.operators.outliers import Bounds
from assayspark.operators.runlog import COMPLETE
from assayspark.plans.workspace import fresh_path
from assayspark.streaming import state


def read_stream(
    spark: SparkSession, folder: str, names: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream; the schema comes from the files that are there."""
    schema = spark.read.option("pathGlobFilter", names).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", names)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def append_to_files(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append-mode Parquet sink (exactly once), run until the input is used up."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    )
    query.awaitTermination()


def latest_status(
    stream: DataFrame, task: Sequence[str], time: str, order: Sequence[str], out: str, checkpoint: str, hours: int = 1,
    partitions: int | None = None,
) -> StreamingQuery:
    """Hold the newest row of every task seen in the last hours before the newest time.

    The state of a task is one row. A timer removes it when the watermark, ``hours`` behind the newest
    event, has passed it; rows that arrive later than that are older than any row still shown. Rows may
    come in any order and again, and a later run goes on from the checkpoint. ``out`` gets one line per
    change or expiry (append only); ``read_latest`` gives the present state.
    """
    # a millisecond more than the hours, so that the watermark never passes a row that still counts
    rows = state.packed(stream, task, time, order, f"{hours * 3_600_000 + 1} milliseconds")
    schema = state.state_schema(rows, order)
    changes = rows.groupBy(*task).transformWithState(
        state.Newest(schema), T.StructType([T.StructField(state.ROW, T.StringType()), T.StructField("expired", T.BooleanType())]), "Append", "EventTime")
    return _run(changes, out, checkpoint, partitions)


def read_latest(
    spark: SparkSession, checkpoint: str, schema: T.StructType, time: str, hours: int = 1,
) -> DataFrame:
    """Newest row per task among those within the last hours before the newest time seen.

    Reads the state after the last batch, whose size follows the live tasks, and no earlier output.
    ``schema`` is that of the stream.
    """
    rows = state.held(spark, checkpoint, "latest", schema)
    last = F.lit(rows.agg(F.max(time)).first()[0]).cast(schema[time].dataType)
    return rows.where(F.col(time) >= last - F.expr(f"INTERVAL {int(hours)} HOURS"))


def complete_once(
    stream: DataFrame, task: Sequence[str], time: str, order: Sequence[str], status: str, out: str, checkpoint: str,
    lateness: str = "1 hour", states: Sequence[str] = COMPLETE, partitions: int | None = None,
) -> StreamingQuery:
    """Write the first completion of every task to ``out``, once for good.

    A completion waits in the state until the watermark, ``lateness`` behind the newest event, has passed
    it: an earlier one that arrives in time takes its place. Then it is written and moves to a second
    state without end, one row per finished task, so repeated and late ones change nothing. What comes
    later than ``lateness`` is dropped, and counted in the query's progress.
    """
    rows = state.packed(stream, task, time, order, lateness, F.col(status).cast("string").isin(*states))
    schema = state.state_schema(rows, order)
    firsts = rows.groupBy(*task).transformWithState(
        state.FirstForGood(schema), T.StructType([T.StructField(state.ROW, T.StringType())]), "Append", "EventTime")
    return _run(firsts, out, checkpoint, partitions)


def read_first(spark: SparkSession, checkpoint: str, schema: T.StructType) -> DataFrame:
    """One completion per task with ``final``: whether it was written, or may still give way to an earlier one."""
    final = state.held(spark, checkpoint, "final", schema).withColumn("final", F.lit(True))
    return final.unionByName(state.held(spark, checkpoint, "waiting", schema).withColumn("final", F.lit(False)))


def read_written(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The rows of an append-only output of ``latest_status`` or ``complete_once``."""
    return state.unpacked(spark.read.parquet(out), F.col(state.ROW), schema)


def _run(rows: DataFrame, out: str, checkpoint: str, partitions: int | None) -> StreamingQuery:
    with state.keyed_state(rows.sparkSession, partitions):
        query = (
            rows.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        )
        query.awaitTermination()
    return query


def screen(
    stream: DataFrame, columns: Sequence[str], bounds: Bounds, band: tuple[float, float],
    band_columns: Sequence[str], complete: Column | None = None,
) -> DataFrame:
    """Normalise, keep rows inside the sum band and clip with bounds fitted beforehand."""
    clean = nan_to_null(stream).dropna(subset=list(columns))
    kept = clean.where(row_sum(band_columns).between(*band))
    return bounds.clip(kept if complete is None else kept.where(complete))


def stream_paths(spark: SparkSession, label: str) -> tuple[str, str]:
    """Output and checkpoint folders in the shared workspace."""
    return fresh_path(spark, f"{label}-out"), fresh_path(spark, f"{label}-state")
