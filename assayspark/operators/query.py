"""Structured query builder: one request dictionary becomes one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayspark.functions.columns import all_of, is_numeric
from assayspark.plans.positions import ordering, present
from assayspark.plans.quantiles import group_quantiles

MAX_LIMIT = 1000
DEFAULT_LIMIT = 100
_RENAMED = {"avg": "mean"}


def project(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Keep the known ones of the named columns; nothing known means all."""
    known = [c for c in columns or () if c in df.columns]
    return df.select(*known) if known else df


def _not_nan(df: DataFrame, column: str) -> Column | None:
    floating = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    return ~F.isnan(column) if floating else None


def compare(df: DataFrame, column: str, op: str, value: float) -> Column | None:
    """Comparison with a number. Missing values fail every test except ``!=``."""
    col, num = F.col(column), F.lit(float(value))
    if not is_numeric(df.schema[column].dataType):
        return {"=": F.lit(False), "!=": F.lit(True)}.get(op)
    if op == "!=":
        return ~col.eqNullSafe(num)
    test = {">": col > num, "<": col < num, ">=": col >= num, "<=": col <= num, "=": col == num}.get(op)
    guard = _not_nan(df, column)
    return test if test is None or guard is None or op in ("<", "<=", "=") else test & guard


def between(df: DataFrame, column: str, bounds: str) -> Column | None:
    """Inclusive ``"low,high"`` range."""
    parts = str(bounds).split(",")
    if len(parts) != 2 or not is_numeric(df.schema[column].dataType):
        return None
    return F.col(column).between(float(parts[0]), float(parts[1]))


def matches(column: str, pattern: str) -> Column:
    """Regular expression anywhere in the text of the column."""
    return F.col(column).cast("string").rlike(str(pattern))


def condition(df: DataFrame, spec: Mapping[str, Any]) -> Column | None:
    """Column expression of one filter, or None when the filter is not usable."""
    column, op, value = spec.get("col"), spec.get("op"), spec.get("val")
    if not column or not op or column not in df.columns:
        return None
    try:
        if op == "between":
            return between(df, column, value)
        if op == "contains":
            return matches(column, value)
        return compare(df, column, op, float(value))
    except (TypeError, ValueError):
        return None


def apply_filters(df: DataFrame, filters: Sequence[Mapping[str, Any]] | None) -> DataFrame:
    """Apply the usable filters together."""
    usable = [c for c in (condition(df, f) for f in filters or ()) if c is not None]
    return df.where(all_of(usable)) if usable else df


def measure(func: str, column: str, order: Sequence[str] = (), value: Column | None = None) -> Column:
    """One aggregate by its name; first and last need an order to be repeatable.

    ``value`` stands in for the column where missing values have been made null.
    """
    col = F.col(column) if value is None else value
    present = F.when(col.isNotNull(), F.struct(*order)) if order else None
    simple = {
        "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp,
        "nunique": F.count_distinct,
        "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
        # pandas corrects both for the size of the sample
        "skew": lambda c: F.when(F.count(c) > 2, F.skewness(c) * F.sqrt(F.count(c) * (F.count(c) - 1)) / (F.count(c) - 2)),
        "kurt": lambda c: F.when(F.count(c) > 3, (F.count(c) - 1) / ((F.count(c) - 2) * (F.count(c) - 3)) * (
            (F.count(c) + 1) * F.kurtosis(c) + 6)),
        "any": lambda c: F.coalesce(F.bool_or(c.cast("boolean")), F.lit(False)),
        "all": lambda c: F.coalesce(F.bool_and(c.cast("boolean")), F.lit(True)),
    }
    if func in simple:
        return simple[func](col)
    if func == "sum":
        return F.coalesce(F.sum(col), F.lit(0))
    if func == "prod":
        return F.coalesce(F.product(col), F.lit(1.0))
    if func in ("first", "last"):
        if present is None:
            raise ValueError(f"{func} needs order columns")
        return (F.min_by if func == "first" else F.max_by)(col, present)
    raise ValueError(f"unknown aggregate {func}")


def aggregate(
    df: DataFrame,
    func: str,
    column: str | None = None,
    group_by: Sequence[str] = (),
    order: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Aggregate all rows or groups; null groups are kept and come last."""
    func = _RENAMED.get(func.lower(), func.lower())
    keys = [c for c in group_by if c in df.columns]
    if group_by and not keys:
        raise ValueError("no known column to group by")
    if func in ("count", "size"):
        result = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(func))
    elif not column or column not in df.columns:
        raise ValueError(f"aggregate column {column} does not exist")
    elif func == "median":
        result = group_quantiles(df.withColumn(column, present(df, column)), keys, column, [0.5], [f"median_{column}"])
    else:
        result = df.groupBy(*keys).agg(measure(func, column, order, present(df, column)).alias(f"{func}_{column}"))
    if keys:
        result = result.orderBy(*[F.col(k).asc_nulls_last() for k in keys])
    return result.limit(limit) if limit is not None else result


def top_k(
    df: DataFrame, column: str, descending: bool = False, limit: int = DEFAULT_LIMIT, ties: Sequence[str] = ()
) -> DataFrame:
    """First rows in the order of one column, missing values last both ways."""
    return df.orderBy(*ordering(df, [column, *ties], [column] if descending else [])).limit(max(0, int(limit)))


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(int(value), high))


def build(
    df: DataFrame, request: Mapping[str, Any], key: Sequence[str] = (), filters_first: bool = True
) -> DataFrame:
    """Filters, order, projection and limit; or an aggregate over the filtered rows.

    ``filters_first=False`` aggregates the unfiltered table.
    """
    chosen = request.get("aggregate") or {}
    if chosen.get("func"):
        rows = apply_filters(df, request.get("filters")) if filters_first else df
        return aggregate(
            rows, chosen["func"], chosen.get("col"), chosen.get("group_by") or (), key,
            int(request.get("limit", DEFAULT_LIMIT)),
        )
    rows = apply_filters(df, request.get("filters"))
    order = request.get("order_by") or {}
    limit = clamp(request.get("limit", DEFAULT_LIMIT), 1, MAX_LIMIT)
    if order.get("col") in df.columns:
        rows = top_k(rows, order["col"], bool(order.get("desc")), limit, key)
    else:
        ties = [F.col(k).asc_nulls_last() for k in key]
        rows = (rows.orderBy(*ties) if ties else rows).limit(limit)
    return project(rows, request.get("columns"))


def presets(target: str, share: str) -> dict[str, dict[str, Any]]:
    """Ready-made requests for a table with a target and a share column."""
    return {
        "top10": {"limit": 10},
        "hard": {"filters": [{"col": target, "op": ">", "val": "400"}], "limit": 100},
        "sorted_target": {"order_by": {"col": target, "desc": True}, "limit": 20},
        "count": {"aggregate": {"func": "count"}, "limit": 10},
        "share_avg": {"aggregate": {"func": "avg", "col": share}, "limit": 50},
        "share_range": {"filters": [{"col": share, "op": "between", "val": "5,10"}], "limit": 50},
    }
