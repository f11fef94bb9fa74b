"""Positions in a total order over a whole table of any size and any column types.

The rows are dealt out by ranges of the real ordering columns, sorted and written once with their
place inside the partition. What is stored no longer moves, so counting rows per partition gives
every row one position: no cast, no window over all rows, and no partition larger than its range.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayspark.plans.workspace import materialize

PLACE_BITS = 33  # of monotonically_increasing_id: the lower ones count inside a partition


def present(df: DataFrame, column: str) -> Column:
    """The column with NaN as null, so that missing values are alike."""
    floating = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    return F.nanvl(F.col(column), F.lit(None)) if floating else F.col(column)


def ordering(df: DataFrame, columns: Sequence[str], descending: Sequence[str] = ()) -> list[Column]:
    """Sort expressions; missing values, NaN among them, come last both ways."""
    return [
        present(df, c).desc_nulls_last() if c in descending else present(df, c).asc_nulls_last()
        for c in dict.fromkeys(columns)
    ]


def rows_at(df: DataFrame, order: Sequence[Column], positions: Sequence[int]) -> DataFrame:
    """Rows at the given positions (from 1), in no particular order."""
    wanted = sorted(set(positions))
    if not wanted:
        return df.where(F.lit(False))
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(dealt.withColumns({
        "__part": F.shiftright(place, PLACE_BITS).cast("int"), "__place": place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)),
    }), "positions")
    sizes = sorted(tuple(r) for r in stored.groupBy("__part").count().collect())
    before, hits = 0, []
    for part, size in sizes:
        low, high = bisect.bisect_left(wanted, before + 1), bisect.bisect_right(wanted, before + size)
        hits += [(part, p - before - 1) for p in wanted[low:high]]
        before += size
    chosen = df.sparkSession.createDataFrame(hits, "__part int, __place bigint")
    return stored.join(F.broadcast(chosen), ["__part", "__place"], "left_semi").select(*df.columns)
