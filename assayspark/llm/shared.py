"""What the corpus operators share on the Spark side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayspark.llm.textblocks import Bitmap, mix
from assayspark.plans.workspace import materialize
from assayspark.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its counterpart."""
    def keep(function: Callable[[SparkSession, str], DataFrame]):
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


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One Arrow batch in, one out; the function sees only whole rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that copies made of them stay small."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def append_columns(df: DataFrame, text: str, fields: dict[str, str], function: Callable[[pa.Array], list]) -> tuple[DataFrame, list[str]]:
    """The table with further columns made from its text column, batch by batch.

    ``fields`` gives wanted names and types; the names really used come back, changed where the
    table has such a column already.
    """
    names = [fresh(df, f) for f in fields]
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in zip(names, fields.values(), strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *function(batch.column(at))], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema), names


def set_bits(hashes: DataFrame, column: str, bits: int = 24) -> Bitmap:
    """A bitmap of all values of a long column.

    Every task fills a bitmap of its own; their 4 KiB pages are joined by page number, so what
    reaches the driver is one bitmap of 2^bits bits however many rows there are.
    """
    page = 1 << 15

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bitmap(bits)
        for batch in batches:
            own.add(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64))
        pages = own.data.reshape(-1, page // 8)
        used = np.flatnonzero(pages.any(axis=1))
        yield pa.record_batch({"page": used.astype(np.int32), "bits": pa.array([pages[i].tobytes() for i in used], pa.binary())})

    def join(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in frames:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(b, dtype=np.uint8)
                have[i] = have[i] | new if i in have else new
        yield pa.record_batch({"page": pa.array(list(have), pa.int32()), "bits": pa.array([v.tobytes() for v in have.values()], pa.binary())})

    schema = "page int, bits binary"
    parts = hashes.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(fill, schema)
    out = Bitmap(bits)
    pages = out.data.reshape(-1, page // 8)
    for row in parts.repartition(max(1, min(16, 1 << (bits - 18))), "page").mapInArrow(join, schema).collect():
        pages[row["page"]] |= np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def hash_ids(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64), 5)


def crc_mod(column: Column | str, n: int) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % n


__all__ = [
    "ORACLES", "QUERIES", "append_columns", "crc_mod", "fresh", "hash_ids", "map_batches", "materialize", "query", "set_bits", "small", "table",
]
