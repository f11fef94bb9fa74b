"""Ordered computations that never put one key's whole history into one task.

A plain window sends all rows of a key to a single task. Here the ordering column
is cut into chunks at approximate quantiles; the window runs inside (key, chunk), and
what the earlier chunks contribute arrives from a table with one row per (key, chunk).
A value that is so frequent that it fills a chunk alone is cut further by the second
ordering column. Up to ``rows_per_chunk`` rows in total there is one chunk and the plan is
the plain window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayspark.functions.columns import wall_micros

ROWS_PER_CHUNK = 1_000_000
MAX_CHUNKS = 10_000
SAMPLE_PER_CHUNK = 200


def can_be_cut(df: DataFrame, column: str) -> bool:
    kinds = (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)
    return isinstance(df.schema[column].dataType, kinds)


def as_ordinal(df: DataFrame, column: str) -> Column:
    """Numeric image of an ordering column that keeps its order; null sorts first."""
    dtype = df.schema[column].dataType
    if not can_be_cut(df, column):
        raise TypeError(f"{column}: cannot cut an ordering of type {dtype.simpleString()}")
    if isinstance(dtype, T.TimestampNTZType):
        image = wall_micros(column).cast("double")
    elif isinstance(dtype, T.TimestampType):
        image = F.unix_micros(F.col(column)).cast("double")
    elif isinstance(dtype, T.DateType):
        image = F.unix_date(F.col(column)).cast("double")
    else:
        image = F.col(column).cast("double")
    return F.coalesce(image, F.lit(-math.inf))


@dataclass(frozen=True)
class Cuts:
    """Increasing cut points; the frequent ones stand for values that fill a chunk alone."""

    values: tuple[float, ...] = ()
    frequent: tuple[float, ...] = ()

    def splits(self, isolate: Sequence[float] | None = None) -> list[float]:
        """Bucket edges; isolated values get a bucket [v, next double after v)."""
        alone = self.frequent if isolate is None else isolate
        edges = {*self.values, *(math.nextafter(v, math.inf) for v in alone)}
        return [-math.inf, *sorted(edges), math.inf]


def find_cuts(
    df: DataFrame,
    column: str,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    max_chunks: int = MAX_CHUNKS,
    total: int | None = None,
) -> Cuts:
    """Cut points that give about ``rows_per_chunk`` rows between neighbours.

    They come from a sample of a size that depends on the number of chunks only. Where the
    cuts lie changes the balance of the chunks, never a result.
    """
    ordinal = as_ordinal(df, column)
    if total is None:
        total = df.select(ordinal.alias("v")).count()
    chunks = min(math.ceil(total / rows_per_chunk), max_chunks) if total else 1
    if chunks <= 1:
        return Cuts()
    shares = [i / chunks for i in range(1, chunks)]
    sampled = df.select(ordinal.alias("v")).where(F.col("v") > -math.inf)
    fraction = SAMPLE_PER_CHUNK * chunks / total
    if fraction < 1.0:
        sampled = sampled.sample(fraction, seed=chunks)
    row = sampled.agg(F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("cuts")).first()
    seen = Counter(float(v) for v in row["cuts"] or () if math.isfinite(v))
    return Cuts(tuple(sorted(seen)), tuple(sorted(v for v, times in seen.items() if times > 1)))


def bucket(df: DataFrame, value: Column, splits: Sequence[float], name: str) -> DataFrame:
    """Add the number of the half-open interval a value lies in."""
    staged = df.withColumn(f"{name}_v", value)
    found = Bucketizer(
        splits=list(splits), inputCol=f"{name}_v", outputCol=f"{name}_b", handleInvalid="keep"
    ).transform(staged)
    return found.withColumn(name, F.col(f"{name}_b").cast("int")).drop(f"{name}_v", f"{name}_b")


@dataclass(frozen=True)
class Chunking:
    """Where an ordering is cut; the second column is only cut inside frequent values."""

    order: tuple[str, ...]
    first: Cuts = Cuts()
    second: Cuts = Cuts()

    def transform(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """Add chunk columns whose order agrees with the ordering; none when there is one chunk."""
        if not self.first.values:
            return df, []
        ordinal = as_ordinal(df, self.order[0])
        parts = bucket(df, ordinal, self.first.splits(), "__chunk0")
        if not self.second.values:
            return parts, ["__chunk0"]
        parts = bucket(parts, as_ordinal(df, self.order[1]), self.second.splits(), "__within")
        crowded = F.when(ordinal.isin(*self.first.frequent), F.col("__within")).otherwise(0)
        return parts.withColumn("__chunk1", crowded).drop("__within"), ["__chunk0", "__chunk1"]


def fit_chunks(df: DataFrame, order: Sequence[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> Chunking:
    """Find the cuts once; several running values over the same ordering share them."""
    first = find_cuts(df, order[0], rows_per_chunk)
    if not first.frequent or len(order) < 2 or not can_be_cut(df, order[1]):
        return Chunking(tuple(order), first)
    crowded = df.where(as_ordinal(df, order[0]).isin(*first.frequent))
    return Chunking(tuple(order), first, find_cuts(crowded, order[1], rows_per_chunk))


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is count, sum, max, min or last (non-null)."""

    name: str
    kind: str
    column: Column | None = None
    inclusive: bool = True

    @property
    def part(self) -> Column:
        """What a row contributes."""
        return F.lit(1).cast("bigint") if self.kind == "count" else self.column

    def total(self, order: Column, descending: bool) -> Column:
        """What a whole chunk contributes to the chunks after it."""
        if self.kind == "last":
            pick = F.min_by if descending else F.max_by
            return pick(self.column, F.when(self.column.isNotNull(), order))
        return self._gather(self.part)

    def over(self, window, column: str) -> Column:
        """The running value of contributions in a window."""
        end = 0 if self.inclusive else -1
        value = self._gather(F.col(column)).over(window.rowsBetween(Window.unboundedPreceding, end))
        return F.coalesce(value, F.lit(0)) if self.kind == "count" else value

    def before(self, window, column: str) -> Column:
        """The contributions of all earlier rows."""
        return self._gather(F.col(column)).over(window.rowsBetween(Window.unboundedPreceding, -1))

    def _gather(self, column: Column) -> Column:
        if self.kind == "last":
            return F.last(column, ignorenulls=True)
        return {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}[self.kind](column)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Sequence[Running],
    descending: bool = False,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    chunking: Chunking | None = None,
) -> DataFrame:
    """Add running values per key in the given order, split into chunks when long.

    The first order column must be numeric or temporal; the others break ties. Every (key,
    chunk) gets one head row that carries what the earlier chunks add up to; it sorts first,
    so one window and one shuffle of the rows do the whole work, without a join.
    """
    def sort(columns: Sequence[str]) -> list[Column]:
        return [F.col(c).desc() if descending else F.col(c).asc() for c in columns]

    def partition(*columns: str):
        return Window.partitionBy(*columns) if columns else Window.partitionBy(F.lit(0))

    names = [f"__p{i}" for i in range(len(specs))]
    parts, chunk = (chunking or fit_chunks(df, order, rows_per_chunk)).transform(df)
    rows = parts.select("*", F.lit(1).alias("__row"), *[s.part.alias(n) for s, n in zip(specs, names)])
    if chunk:
        ordering = F.struct(*[F.col(c) for c in order])
        totals = parts.groupBy(*keys, *chunk).agg(*[
            s.total(ordering, descending).alias(n) for s, n in zip(specs, names)
        ])
        earlier = partition(*keys).orderBy(*sort(chunk))
        heads = totals.select(
            *keys, *chunk, F.lit(0).alias("__row"), *[s.before(earlier, n).alias(n) for s, n in zip(specs, names)]
        )
        rows = rows.unionByName(heads, allowMissingColumns=True)
    window = partition(*keys, *chunk).orderBy("__row", *sort(order))
    done = rows.select(*df.columns, "__row", *[s.over(window, n).alias(s.name) for s, n in zip(specs, names)])
    return done.where(F.col("__row") == 1).drop("__row")


def row_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    descending: bool = False,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Number the rows of each key from 1 in the given order."""
    return running(df, keys, order, [Running(name, "count")], descending, rows_per_chunk)
