"""Number of partitions in front of Python-heavy or iterative stages."""

from __future__ import annotations

from pyspark.sql import DataFrame

SPREAD_ROWS = 5_000_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Deal a table of a known, small number of rows to all cores; leave a large one alone.

    A small file often is one partition and would keep one core busy for every pass. A large
    table has enough partitions, so it is never shuffled for this.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if rows <= SPREAD_ROWS else df
