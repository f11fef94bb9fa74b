"""Correlation matrices in long form (a, b, r) for all column pairs i < j."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayspark.functions.columns import number
from assayspark.plans.chunks import ROWS_PER_CHUNK, bucket, find_cuts
from assayspark.plans.gram import pairwise_moments
from assayspark.plans.layout import spread

WIDE = 16
STRIP_POINTS = 500_000


def _finite(r: Column) -> Column:
    return F.coalesce(F.nanvl(r, F.lit(None)), F.lit(0.0))


def _corr(a: Column, b: Column) -> Column:
    """Correlation over the complete pairs, null for a constant side (``corr`` raises there)."""
    scale = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), scale)


def _long(row: DataFrame, pairs: Sequence[tuple[str, str]], names: Sequence[str]) -> DataFrame:
    entries = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _finite(F.col(n)).alias("r"))
        for (a, b), n in zip(pairs, names)
    ]
    return row.select(F.inline(F.array(*entries)))


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r over the rows where both columns are present; undefined values become 0.

    A few complete columns need one JVM aggregate. With missing values or many columns the
    cross products are summed per task, because each pair then has its own rows and thousands
    of aggregates in one plan neither compile nor fit a code-generated stage.
    """
    values = df.select(*[number(c).alias(c) for c in columns])
    k = len(columns)
    rows, *seen = values.agg(
        F.count(F.lit(1)), *[F.avg(c) for c in columns], *[F.count_if(F.col(c).isNull()) for c in columns],
        *[F.min(c) < F.max(c) for c in columns],
    ).first()
    centre, holes, varies = seen[:k], seen[k:2 * k], dict(zip(columns, seen[2 * k:]))
    if k <= WIDE and not any(holes):
        pairs = list(combinations(columns, 2))
        names = [f"r{i}" for i in range(len(pairs))]
        row = values.agg(*[
            (F.corr(a, b) if varies[a] and varies[b] else F.max(F.lit(0.0))).alias(n) for (a, b), n in zip(pairs, names)
        ])
        return _long(row, pairs, names)
    m = pairwise_moments(spread(values, rows), columns, [v if v is not None else 0.0 for v in centre])
    scatter = (F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2)
    r = F.when(scatter > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(scatter))
    labels = F.array(*[F.lit(c) for c in columns])
    return m.select(
        F.element_at(labels, F.col("i") + 1).alias("a"), F.element_at(labels, F.col("j") + 1).alias("b"),
        _finite(r).alias("r"),
    )


# ------------------------------------------------------------------------- ranks


def _single_valued(splits: Sequence[float]) -> list[int]:
    return [i for i in range(1, len(splits) - 2) if splits[i + 1] == math.nextafter(splits[i], math.inf)]


@dataclass(frozen=True)
class Ranking:
    """Value buckets of one column: edges, and per bucket the rows before it and in it."""

    column: str
    splits: tuple[float, ...]
    buckets: tuple[tuple[int, int, int, bool], ...]

    def transform(self, df: DataFrame, name: str, salts: int = 64) -> DataFrame:
        """Add the average rank with one shuffle into the value buckets.

        A value that fills a bucket alone gets its rank from the bucket totals; its rows are
        salted, so a value held by a third of all rows is no hot spot.
        """
        if not self.buckets:
            whole = Window.partitionBy(F.lit(0)).orderBy(self.column)
            return df.withColumn(name, _mean_place(whole))
        offsets = df.sparkSession.createDataFrame(
            list(self.buckets), "__b int, __before long, __size long, __alone boolean")
        placed = bucket(df, F.col(self.column), self.splits, "__b").join(F.broadcast(offsets), "__b")
        salt = F.when(F.col("__alone"), F.pmod(F.xxhash64(*df.columns), F.lit(salts))).otherwise(0)
        inner = Window.partitionBy("__b", "__salt").orderBy(self.column)
        local = F.when(F.col("__alone"), (F.col("__size") + 1) / 2.0).otherwise(_mean_place(inner))
        return placed.withColumn("__salt", salt).select(*df.columns, (F.col("__before") + local).alias(name))


def _mean_place(window) -> Column:
    upto = F.count(F.lit(1)).over(window.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return (F.rank().over(window) + upto) / 2.0


def fit_ranking(
    df: DataFrame, column: str, rows_per_chunk: int = ROWS_PER_CHUNK, total: int | None = None
) -> Ranking:
    """Buckets for ranking a column without null values; no buckets when one task can rank it."""
    cuts = find_cuts(df, column, rows_per_chunk, total=total)
    if not cuts.values:
        return Ranking(column, (), ())
    splits = cuts.splits(isolate=cuts.values)
    alone = set(_single_valued(splits))
    found = bucket(df.select(column), F.col(column), splits, "__b").groupBy("__b").count()
    sizes = {row["__b"]: row["count"] for row in found.collect()}
    before, buckets = 0, []
    for b in range(len(splits) - 1):
        buckets.append((b, before, sizes.get(b, 0), b in alone))
        before += sizes.get(b, 0)
    return Ranking(column, tuple(splits), tuple(buckets))


def spearman(df: DataFrame, columns: Sequence[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Pearson r of average ranks, each pair over its own complete rows."""
    values = df.select(*[number(c).alias(c) for c in columns])
    total, *holes = values.agg(F.count(F.lit(1)), *[F.count_if(F.col(c).isNull()) for c in columns]).first()
    if not any(holes):
        return pearson(_ranked(values, columns, rows_per_chunk, total), columns)
    parts = []
    for a, b in combinations(columns, 2):
        both = values.select(a, b).dropna()
        parts.append(pearson(_ranked(both, [a, b], rows_per_chunk, both.count()), [a, b]))
    return reduce(DataFrame.unionByName, parts)


def _ranked(values: DataFrame, columns: Sequence[str], rows_per_chunk: int, total: int) -> DataFrame:
    ranked = values
    for i, c in enumerate(columns):
        ranked = fit_ranking(values, c, rows_per_chunk, total).transform(ranked, f"__rank{i}")
    return ranked.select(*[F.col(f"__rank{i}").alias(c) for i, c in enumerate(columns)])


# ----------------------------------------------------------------------- kendall


def _order_score(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weighted sum of sign(dx) * sign(dy) over all pairs, in n log^2 n steps.

    Two points with different x ranks differ first in one bit; at that bit the smaller one is
    on the left, and the left weights below and above its y are read from cumulative sums.
    """
    xr = np.unique(x, return_inverse=True)[1].astype(np.int64)
    yr = np.unique(y, return_inverse=True)[1].astype(np.int64)
    width = int(yr.max()) + 1 if len(yr) else 1
    score = 0.0
    for level in range(int(xr.max()).bit_length() if len(xr) else 0):
        parent = xr >> (level + 1)
        left = (xr >> level) & 1 == 0
        keys = parent * width + yr
        order = np.argsort(keys[left], kind="stable")
        left_keys = keys[left][order]
        summed = np.concatenate([[0.0], np.cumsum(w[left][order])])
        right, base = keys[~left], parent[~left] * width
        below = summed[np.searchsorted(left_keys, right, "left")] - summed[np.searchsorted(left_keys, base, "left")]
        above = summed[np.searchsorted(left_keys, base + width, "left")] - summed[np.searchsorted(left_keys, right, "right")]
        score += float(np.dot(w[~left], below - above))
    return score


def _group_scores(points: DataFrame, *keys: str | Column) -> float:
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [_order_score(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy(float))]})

    total = points.groupBy(*keys).applyInPandas(score, "s double").agg(F.sum("s")).first()[0]
    return total or 0.0


def _pair_score(points: DataFrame, n: int, strip_points: int) -> float:
    """Order score of (x, y, w) points: the bucket grid, plus strips, minus what both strips saw.

    Pairs in different x and y buckets are decided by the grid, which is again a set of points
    and is scored the same way. Pairs sharing a bucket are counted inside that strip.
    """
    if n <= strip_points:
        return _group_scores(points, F.lit(0).alias("all")) if n else 0.0
    rows = max(strip_points // 2, 1)
    splits = {}
    for c in ("x", "y"):
        cuts = find_cuts(points, c, rows, total=n)
        splits[c] = cuts.splits(isolate=cuts.values)
    cut = bucket(bucket(points, F.col("x"), splits["x"], "bx"), F.col("y"), splits["y"], "by")
    open_x = ~F.col("bx").isin(_single_valued(splits["x"]))
    open_y = ~F.col("by").isin(_single_valued(splits["y"]))
    grid = cut.groupBy("bx", "by").agg(F.sum("w").alias("w")).select(
        F.col("bx").cast("double").alias("x"), F.col("by").cast("double").alias("y"), "w"
    )
    cells = grid.count()
    if cells >= n:
        raise ValueError("more strips than points per strip; raise strip_points")
    across = _pair_score(grid, cells, strip_points)
    in_x = _group_scores(cut.where(open_x), "bx")
    in_y = _group_scores(cut.where(open_y), "by")
    in_both = _group_scores(cut.where(open_x & open_y), "bx", "by")
    return across + in_x + in_y - in_both


def kendall_pair(df: DataFrame, a: str, b: str, strip_points: int = STRIP_POINTS) -> float | None:
    """Kendall tau-b of two columns over their complete rows; None when undefined."""
    points = (
        df.select(number(a).alias("x"), number(b).alias("y")).dropna()
        .groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    ).persist()
    try:
        distinct, n = points.agg(F.count("w"), F.coalesce(F.sum("w"), F.lit(0.0))).first()
        tied = F.sum(F.col("w") * (F.col("w") - 1) / 2)
        ties = [points.groupBy(c).agg(F.sum("w").alias("w")).agg(tied.alias("t")) for c in ("x", "y")]
        tx, ty = [row[0] or 0.0 for row in ties[0].unionAll(ties[1]).collect()]
        pairs = n * (n - 1) / 2
        scale = math.sqrt(max(pairs - tx, 0.0)) * math.sqrt(max(pairs - ty, 0.0))
        return _pair_score(points, distinct, strip_points) / scale if scale > 0 else None
    finally:
        points.unpersist()


def kendall(df: DataFrame, columns: Sequence[str], strip_points: int = STRIP_POINTS) -> DataFrame:
    """Kendall tau-b of all pairs; undefined values become 0."""
    found = [(a, b, kendall_pair(df, a, b, strip_points) or 0.0) for a, b in combinations(columns, 2)]
    return df.sparkSession.createDataFrame(found, "a string, b string, r double")


# --------------------------------------------------------------------- summaries


def matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Long correlation matrix by the named method."""
    methods = {"pearson": pearson, "spearman": spearman, "kendall": kendall}
    if method not in methods:
        raise ValueError(f"unknown correlation {method}")
    return methods[method](df, columns)


def square(long: DataFrame) -> DataFrame:
    """Both triangles and the diagonal of a long matrix."""
    flipped = long.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    names = long.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    return long.unionByName(flipped).unionByName(names.select("a", F.col("a").alias("b"), F.lit(1.0).alias("r")))


def high_pairs(long: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs with a strong correlation, strongest first."""
    return (
        long.where(F.abs("r") >= threshold)
        .select("a", "b", F.round("r", 3).alias("r"))
        .orderBy(F.abs("r").desc(), "a", "b")
    )


def strength(pairs: DataFrame) -> DataFrame:
    """Name the strength of each pair."""
    size = F.abs("r")
    label = F.when(size >= 0.9, "very strong").when(size >= 0.8, "strong").otherwise("medium")
    return pairs.withColumn("strength", label)


def top_with_target(df: DataFrame, columns: Sequence[str], target: str, k: int = 10) -> DataFrame:
    """Columns with the largest absolute correlation with the target."""
    y = number(target)
    names = [f"r{i}" for i in range(len(columns))]
    row = df.agg(*[_corr(number(c), y).alias(n) for c, n in zip(columns, names)])
    entries = [F.struct(F.lit(c).alias("column"), F.abs(_finite(F.col(n))).alias("abs_corr")) for c, n in zip(columns, names)]
    return row.select(F.inline(F.array(*entries))).orderBy(F.col("abs_corr").desc(), "column").limit(k)
