"""Keyed state of the streaming jobs: what is held per task, and how it is read back.

A row travels as its key, its order (one number or string per order column), the event time in
milliseconds and all further columns as one JSON text, so the Python side handles no nulls and no
types of the caller. The state itself lives in RocksDB, by key, in the checkpoint of the query.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
#: A batch then uploads what it changed and not the whole state.
CHANGELOG_SETTING = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
TIME = "state_time"
MILLIS = "state_millis"
ROW = "state_row"  # names of rows must not begin with an underscore
_CLOCKS = (T.TimestampType, T.TimestampNTZType)

# The process that sets a state up beside the driver does not get the shipped package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@contextmanager
def keyed_state(spark: SparkSession, partitions: int | None = None):
    """The session with the state store that timers and several states need; a running query keeps what it started with.

    ``partitions`` is the number of state partitions, which stays as it was at a query's first start: choose
    it for all the tasks to come. Without it the session's shuffle partitions count.
    """
    wanted = {PROVIDER_SETTING: PROVIDER, CHANGELOG_SETTING: "true"} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _micros(column: Column, kind: T.DataType) -> Column:
    """Timestamps as whole microseconds of the session's clock."""
    return F.unix_micros(column.cast("timestamp")) if isinstance(kind, _CLOCKS) else column


def order_names(order: Sequence[str]) -> list[str]:
    return [f"state_order{i}" for i in range(len(order))]


def packed(stream: DataFrame, key: Sequence[str], time: str, order: Sequence[str], lateness: str, only: Column | None = None) -> DataFrame:
    """Key, time with its watermark, milliseconds, order and JSON row. Rows without a key, a time or an order have no place and go.

    ``only`` chooses the rows that are packed; the watermark follows all of them.
    """
    fields = {f.name: f.dataType for f in stream.schema}
    whole = stream.dropna(subset=list(dict.fromkeys([*key, time, *order]))).withColumn(TIME, F.col(time).cast("timestamp")).withWatermark(TIME, lateness)
    if only is not None:  # a condition with the time in it is not pushed below the watermark
        whole = whole.where(F.when(F.unix_micros(TIME) > F.lit(-(1 << 62)), only))
    row = F.to_json(F.struct(*[_micros(F.col(c), fields[c]).alias(c) for c in stream.columns]), {"ignoreNullFields": "false"})
    return whole.select(
        *key, TIME, F.floor(F.unix_micros(TIME) / 1000).cast("bigint").alias(MILLIS),
        *[_micros(F.col(c), fields[c]).alias(n) for c, n in zip(order, order_names(order), strict=True)], row.alias(ROW))


def unpacked(rows: DataFrame, text: Column, schema: T.StructType) -> DataFrame:
    """The original columns out of the JSON rows."""
    plain = T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, _CLOCKS) else f.dataType) for f in schema])
    read = rows.select(F.from_json(text, plain).alias(ROW))
    back = lambda f: F.timestamp_micros(F.col(ROW)[f.name]).cast(f.dataType) if isinstance(f.dataType, _CLOCKS) else F.col(ROW)[f.name]
    return read.select(*[back(f).alias(f.name) for f in schema])


def held(spark: SparkSession, checkpoint: str, name: str, schema: T.StructType) -> DataFrame:
    """The rows that a state variable holds after the last batch, read from the checkpoint."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    return unpacked(rows, F.col("value")[ROW], schema)


def state_schema(packed_rows: DataFrame, order: Sequence[str]) -> T.StructType:
    kinds = {f.name: f.dataType for f in packed_rows.schema}
    return T.StructType([T.StructField(c, kinds[c]) for c in [MILLIS, *order_names(order), ROW]])


def _best(rows: Iterator[Row], names: Sequence[str], pick: Callable) -> tuple:
    """The first or last row by order, as (millis, order.., row)."""
    return pick((tuple(r[c] for c in names) for r in rows), key=lambda r: r[1:])


class Newest(StatefulProcessor):
    """Holds the newest row of a task until the watermark has passed it; what changes or expires goes out.

    A task has one timer: one that fires too early, because the row is newer by now, is set again.
    """

    def __init__(self, schema: T.StructType):
        self.schema, self.names = schema, schema.names

    def init(self, handle) -> None:
        self.handle = handle
        self.row = handle.getValueState("latest", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new, old = _best(rows, self.names, max), self.row.get()
        if old is None:
            self.handle.registerTimer(new[0] + 1)
        elif tuple(old)[1:-1] >= new[1:-1]:
            return
        self.row.update(new)
        yield Row(**{ROW: new[-1], "expired": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        row = tuple(self.row.get())
        if row[0] + 1 > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(row[0] + 1)
        else:
            self.row.clear()
            yield Row(**{ROW: row[-1], "expired": True})

    def close(self) -> None:
        pass


class FirstForGood(StatefulProcessor):
    """Holds a task's first row while an earlier one may still come; then it goes out and is kept for good."""

    def __init__(self, schema: T.StructType):
        self.schema, self.names = schema, schema.names

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", self.schema)
        self.final = handle.getValueState("final", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new, old = _best(rows, self.names, min), self.waiting.get()
        if old is None:
            if not self.final.exists():  # a task has one of the two states, and every question to them is a round trip
                # an earlier row later on keeps this timer, which only makes it wait longer
                self.handle.registerTimer(new[0] + 1)
                self.waiting.update(new)
        elif new[1:-1] < tuple(old)[1:-1]:
            self.waiting.update(new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        row = tuple(self.waiting.get())
        self.waiting.clear()
        self.final.update(row)
        yield Row(**{ROW: row[-1]})

    def close(self) -> None:
        pass
