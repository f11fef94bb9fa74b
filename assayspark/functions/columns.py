"""Small expressions that every module needs. All of them run inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_BITS = 52


def number(column: Column | str) -> Column:
    """Double value; unparsable text and NaN both become null."""
    col = F.col(column) if isinstance(column, str) else column
    return F.nanvl(col.try_cast("double"), F.lit(None).cast("double"))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    """Names of the numeric columns in table order."""
    skipped = set(skip)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in skipped]


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace NaN by null once, so that Spark's null rules hold downstream."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    chosen = floating if columns is None else floating & set(columns)
    return df.select(*[
        F.nanvl(F.col(c), F.lit(None)).alias(c) if c in chosen else F.col(c) for c in df.columns
    ])


def wall_micros(column: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp's wall clock; no session time zone is involved."""
    c = F.col(column) if isinstance(column, str) else column
    minutes = (F.unix_date(c.cast("date")).cast("bigint") * 24 + F.hour(c)) * 60 + F.minute(c)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False)) if conditions else F.lit(False)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def row_sum(columns: Sequence[str]) -> Column:
    """Sum across columns where a missing value counts as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(number(c), F.lit(0.0)) for c in columns])


def digest(seed: int | str, *keys: Column | str) -> Column:
    """md5 of the seed and the key columns; the base of every random choice here."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[
        (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys
    ]))


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """Repeatable uniform number in (0, 1) that depends on the key, not on partitions."""
    bits = F.conv(F.substring(digest(seed, *keys), 1, HASH_BITS // 4), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**HASH_BITS))


def hash_below(fraction: float, seed: int | str, *keys: Column | str) -> Column:
    """True for about ``fraction`` of the keys, always the same ones."""
    if fraction >= 1.0:
        return F.lit(True)
    cut = format(int(fraction * 2**32), "08x")
    return F.substring(digest(seed, *keys), 1, 8) < F.lit(cut)


def normal(seed: int | str, *keys: Column | str) -> Column:
    """Repeatable standard normal number (Box-Muller on two hashed uniforms)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(f"{seed}:r", *keys)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(f"{seed}:a", *keys))
