"""Join helpers: a side is broadcast only after its size was checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def has_more_than(df: DataFrame, rows: int) -> bool:
    """Whether a table has more than ``rows`` rows.

    Collecting a limit runs a few tasks at a time and stops as soon as the answer is known;
    counting behind a limit would run them all and move ``rows`` rows of each to one task.
    """
    return len(df.select(F.lit(1).alias("one")).limit(rows + 1).collect()) > rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when at most ``max_rows`` rows are there, else leave the plan to AQE."""
    return df if has_more_than(df, max_rows) else F.broadcast(df)


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]):
    """Equality condition that also matches null with null."""
    condition = None
    for a, b in pairs:
        term = left[a].eqNullSafe(right[b])
        condition = term if condition is None else condition & term
    return condition
