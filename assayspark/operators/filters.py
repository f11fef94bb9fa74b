"""Row filters beyond the query builder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayspark.functions.columns import any_of, row_sum


def sum_band(df: DataFrame, columns: Sequence[str], low: float = 85.0, high: float = 115.0) -> DataFrame:
    """Rows whose share columns add up to a value inside the band."""
    return df.where(row_sum(columns).between(low, high))


def sum_band_report(df: DataFrame, columns: Sequence[str], low: float = 85.0, high: float = 115.0) -> DataFrame:
    """Rows before and after the band, and the range of the kept sums."""
    summed = df.select(row_sum(columns).alias("s"))
    inside = F.col("s").between(low, high)
    kept = F.when(inside, F.col("s"))
    return summed.agg(
        F.count(F.lit(1)).alias("n_before"),
        F.count_if(inside).alias("n_after"),
        F.min(kept).alias("min_sum"),
        F.max(kept).alias("max_sum"),
    )


def keyword_any(df: DataFrame, keyword: str, skip: Sequence[str] = ()) -> DataFrame:
    """Rows where any column's text holds the keyword, upper and lower case alike."""
    columns = [c for c in df.columns if c not in skip]
    return keyword_fields(df, keyword, columns)


def keyword_fields(df: DataFrame, keyword: str, fields: Sequence[str]) -> DataFrame:
    """Rows where one of the named columns holds the keyword; blank keyword keeps all."""
    word = keyword.strip().lower()
    if not word:
        return df
    hits = [F.coalesce(F.lower(F.col(c).cast("string")).contains(word), F.lit(False)) for c in fields]
    return df.where(any_of(hits))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value (neither null nor NaN) in every named column."""
    return df.dropna(subset=list(columns))


def history_filter(
    history: DataFrame,
    algorithm: str = "",
    data_source: str = "",
    date_from: str = "",
    date_to: str = "",
    created: str = "created_at",
) -> DataFrame:
    """Runs of one algorithm and source inside a span of whole days."""
    rows = history
    if algorithm.strip():
        rows = rows.where(F.col("algorithm") == algorithm.strip())
    if data_source.strip():
        rows = rows.where(F.col("data_source") == data_source.strip())
    kind = history.schema[created].dataType.simpleString()
    if date_from.strip():
        rows = rows.where(F.col(created) >= F.lit(date_from.strip()).cast(kind))
    if date_to.strip():
        end = F.date_add(F.lit(date_to.strip()).cast("date"), 1).cast(kind)
        rows = rows.where(F.col(created) < end)
    return rows


def owned_by(df: DataFrame, user: int | None, admin: bool = False, owner: str = "user_id") -> DataFrame:
    """Everything for an admin; own rows otherwise, so rows without owner stay hidden."""
    if admin:
        return df
    return df.where(F.col(owner) == F.lit(-1 if user is None else user))


def retain_days(df: DataFrame, anchor: str, days: int = 365, created: str = "created_at") -> DataFrame:
    """Rows not older than ``days`` before the anchor instant."""
    kind = df.schema[created].dataType.simpleString()
    start = F.lit(anchor).cast(kind) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.where(F.col(created) >= start)
