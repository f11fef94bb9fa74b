"""Keyed row edits, key-value settings and paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayspark.operators.filters import keyword_any
from assayspark.operators.query import clamp
from assayspark.plans.positions import ordering, rows_at

DEEP_OFFSET = 50_000


def update_rows(
    df: DataFrame, edits: DataFrame, key: Sequence[str], order: Sequence[str] = (), cleared: str | None = None
) -> DataFrame:
    """Set columns of the rows an edit names; null in an edit leaves the value alone.

    Of several edits of one key the last in ``order`` counts; without an order they are an error.
    ``cleared`` names a column of the edits that lists the columns to empty. Columns the table
    does not have are ignored.
    """
    changed = [c for c in edits.columns if c in df.columns and c not in key and c != cleared]
    new = F.struct(*[F.col(c).alias(f"__new_{c}") for c in changed],
                   (F.col(cleared) if cleared else F.array().cast("array<string>")).alias("__clear"))
    chosen = F.max_by(new, F.struct(*order)) if order else F.when(
        F.count(F.lit(1)) == 1, F.first(new)).otherwise(F.raise_error(F.lit("several edits of one key and no order")))
    side = edits.groupBy(*key).agg(chosen.alias("__edit"))
    joined = df.join(side, list(key), "left")

    def edited(c: str) -> Column:
        value = F.col(c)
        if c in changed:
            value = F.coalesce(F.col("__edit")[f"__new_{c}"].cast(df.schema[c].dataType), value)
        if cleared and c not in key:
            value = F.when(~F.coalesce(F.array_contains(F.col("__edit")["__clear"], c), F.lit(False)), value)
        return value.alias(c)

    return joined.select(*[edited(c) for c in df.columns])


def delete_rows(df: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Remove the rows whose key is listed."""
    return df.join(keys.select(*key), list(key), "left_anti")


def insert_rows(df: DataFrame, new: DataFrame) -> DataFrame:
    """Add rows; absent columns become null and unknown ones are ignored."""
    known = [F.col(c).cast(df.schema[c].dataType) for c in df.columns if c in new.columns]
    return df.unionByName(new.select(*known), allowMissingColumns=True)


def upsert_settings(
    stored: DataFrame,
    changes: DataFrame,
    key: Sequence[str],
    value: str,
    order: Sequence[str],
    defaults: DataFrame | None = None,
) -> DataFrame:
    """Latest value per key over stored and changed rows, laid over the defaults.

    Defaults take part as the oldest rows, so there is one aggregation and no join.
    """
    rows = stored.unionByName(changes).withColumn("__tier", F.lit(1))
    if defaults is not None:
        oldest = defaults.select(*key, value, F.lit(0).alias("__tier"))
        rows = rows.unionByName(oldest, allowMissingColumns=True)
    rest = [c for c in stored.columns if c not in key]
    age = F.struct("__tier", *order)
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), age).alias("__row")).select(*key, "__row.*")


def nullify_owner(dependents: DataFrame, owners: DataFrame, owner: str, owner_key: str) -> DataFrame:
    """Keep dependents of deleted owners with an empty owner."""
    alive = owners.select(F.col(owner_key).alias("__alive")).distinct()
    joined = dependents.join(alive, F.col(owner) == F.col("__alive"), "left")
    return joined.select(*[F.col("__alive").alias(c) if c == owner else F.col(c) for c in dependents.columns])


@dataclass(frozen=True)
class Page:
    """One page of rows and the number of rows over all pages."""

    items: DataFrame
    total: int
    page: int
    size: int


def page_rows(
    df: DataFrame,
    key: Sequence[str],
    page: int = 1,
    size: int = 20,
    sort: str | None = None,
    descending: bool = False,
    keyword: str = "",
    max_size: int = 200,
    deep: int = DEEP_OFFSET,
) -> DataFrame:
    """Rows of one page in a total order, missing values last.

    Every page has the same ordering of the real columns. Near the front it is a top-k. A page far
    behind would drag all rows before it into one task; it is found by counting instead.
    """
    size = clamp(size, 1, max_size)
    found = keyword_any(df, keyword)
    columns = [c for c in (sort if sort in df.columns else None, *key) if c]
    order = ordering(df, columns, [sort] if descending else [])
    offset = (max(1, page) - 1) * size
    if offset <= deep:
        return found.orderBy(*order).offset(offset).limit(size)
    return rows_at(found, order, range(offset + 1, offset + size + 1)).orderBy(*order)


def fetch_page(df: DataFrame, key: Sequence[str], keyword: str = "", **choice) -> Page:
    """The page together with the count of all matching rows."""
    size = clamp(choice.get("size", 20), 1, choice.get("max_size", 200))
    items = page_rows(df, key, keyword=keyword, **choice)
    return Page(items, keyword_any(df, keyword).count(), max(1, choice.get("page", 1)), size)


def preview(
    df: DataFrame,
    key: Sequence[str],
    first: Sequence[str] = (),
    n: int = 20,
    others: int = 70,
) -> DataFrame:
    """First rows in key order: the named columns first, then at most ``others`` more."""
    wanted = [c for c in (*key, *first) if c in df.columns]
    wanted = list(dict.fromkeys(wanted))
    rest = [c for c in df.columns if c not in wanted][:others]
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in key]).limit(clamp(n, 1, 500)).select(*wanted, *rest)


def edits_frame(df: DataFrame, rows: Sequence[Mapping[str, object]]) -> DataFrame:
    """A few literal edits as a DataFrame with the table's column types."""
    named = [c for c in df.columns if any(c in r for r in rows)]
    schema = "struct<" + ",".join(f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in named) + ">"
    data = [tuple(r.get(c) for c in named) for r in rows]
    return df.sparkSession.createDataFrame(data, schema)
