"""Outlier rules: fit bounds on the data, then flag, clip, list and count."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayspark.functions.columns import any_of
from assayspark.plans.layout import spread
from assayspark.plans.quantiles import exact_quantiles
from assayspark.plans.workspace import materialize

FLAG = "is_outlier"


@dataclass(frozen=True)
class Bounds:
    """Accepted range per column; a few numbers that travel as literals."""

    low: dict[str, float]
    high: dict[str, float]

    def outside(self) -> Column:
        return any_of([
            (F.col(c) < F.lit(self.low[c])) | (F.col(c) > F.lit(self.high[c])) for c in self.low
        ])

    def flag(self, df: DataFrame, name: str = FLAG) -> DataFrame:
        """Mark rows where any column is out of range."""
        return df.withColumn(name, self.outside())

    def clip(self, df: DataFrame) -> DataFrame:
        """Pull values to the bounds; missing values stay missing."""
        def clipped(c: str) -> Column:
            pulled = F.least(F.greatest(F.col(c), F.lit(self.low[c])), F.lit(self.high[c]))
            return F.when(F.col(c).isNotNull() & ~F.isnan(c), pulled).alias(c)

        return df.select(*[clipped(c) if c in self.low else F.col(c) for c in df.columns])


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in every screened column."""
    return df.dropna(subset=list(columns))


def quantile_bounds(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> Bounds:
    """Range between two quantiles over the complete rows."""
    found = exact_quantiles(complete(df, columns), columns, [low, high])
    return _bounds({c: tuple(v) for c, v in found.items()})


def iqr_bounds(df: DataFrame, columns: Sequence[str], reach: float = 1.5) -> Bounds:
    """Quartiles extended by ``reach`` times their distance."""
    found = exact_quantiles(complete(df, columns), columns, [0.25, 0.75])
    spans = {}
    for c, (q1, q3) in found.items():
        spans[c] = (None, None) if q1 is None else (q1 - reach * (q3 - q1), q3 + reach * (q3 - q1))
    return _bounds(spans)


def zscore_bounds(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> Bounds:
    """Mean plus and minus ``limit`` population deviations; a constant column accepts all."""
    rows = complete(df, columns)
    stats = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.avg, F.stddev_pop)]).first()
    spans = {}
    for i, c in enumerate(columns):
        mean, std = stats[2 * i], stats[2 * i + 1]
        spans[c] = (None, None) if not std else (mean - limit * std, mean + limit * std)
    return _bounds(spans)


def _bounds(spans: dict[str, tuple[float | None, float | None]]) -> Bounds:
    open_low = {c: -math.inf if lo is None else float(lo) for c, (lo, _) in spans.items()}
    open_high = {c: math.inf if hi is None else float(hi) for c, (_, hi) in spans.items()}
    return Bounds(open_low, open_high)


def flag_outliers(df: DataFrame, columns: Sequence[str], method: str = "quantile_clip", **options) -> DataFrame:
    """Complete rows with an outlier flag, by the named rule."""
    rules = {"quantile_clip": quantile_bounds, "iqr": iqr_bounds, "zscore": zscore_bounds}
    if method not in rules:
        raise ValueError(f"unknown outlier rule {method}")
    return rules[method](df, columns, **options).flag(complete(df, columns))


def outlier_samples(flagged: DataFrame, key: Sequence[str], columns: Sequence[str], limit: int = 50) -> DataFrame:
    """First flagged rows in key order."""
    return flagged.where(FLAG).select(*key, *[c for c in columns if c not in key]).orderBy(*key).limit(limit)


def outlier_summary(flagged: DataFrame) -> DataFrame:
    """Normal and outlier counts and the outlier share in percent."""
    return flagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(FLAG).alias("n_outliers"),
        F.count_if(~F.col(FLAG)).alias("n_normal"),
        F.round(F.try_divide(F.lit(100.0) * F.count_if(FLAG), F.count(F.lit(1))), 1).alias("ratio_pct"),
    )


# ---------------------------------------------------------------- isolation forest


@dataclass(frozen=True)
class IsolationForest:
    """Fitted trees as flat node arrays, at most 2 x sample size nodes per tree."""

    columns: tuple[str, ...]
    trees: tuple[dict[str, np.ndarray], ...]
    sample_size: int
    rows: int

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Add the anomaly score in (0, 1); higher is more isolated."""
        if not self.trees:
            return df.withColumn(name, F.lit(None).cast("double"))
        shared = df.sparkSession.sparkContext.broadcast(_Grove.plant(self.trees))
        scale = max(_expected_depth(self.sample_size), 1e-12) * len(self.trees)

        @F.pandas_udf("double")
        def isolation(*series: pd.Series) -> pd.Series:
            x = np.column_stack([s.to_numpy(float) for s in series])
            return pd.Series(np.power(2.0, -shared.value.depth(x) / scale))

        return df.withColumn(name, isolation(*[F.col(c).cast("double") for c in self.columns]))


def fit_isolation_forest(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    trees: int = 100,
    sample_size: int = 256,
    seed: int = 70,
) -> IsolationForest:
    """Grow trees on hashed samples; only sampled rows are shuffled.

    One rule for every size: a hash decides whether a row is drawn, and another from which tree on
    it takes part in ``copies`` neighbouring trees. There are as many copies as it takes to give
    every tree its sample, one when there are rows enough and all trees when there are few, so
    about ``trees`` times the sample is ever multiplied. ``key`` should identify a row.
    """
    rows = complete(df, columns)
    total = rows.count()
    wanted = sample_size + 8.0 * math.sqrt(sample_size)
    inputs = [F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)]
    copies = min(trees, math.ceil(wanted * trees / max(total, 1)))
    span = 1 << 40
    cut = F.lit(max(int(wanted * trees / (max(total, 1) * copies) * span), 1))
    start = F.pmod(F.xxhash64(F.lit(seed + 2), *key), F.lit(trees))
    turn = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("__turn")
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(span)) < cut).select(*key, *inputs, start.alias("__start"), turn)
    drawn = drawn.withColumn("tree", F.pmod(F.col("__start") + F.col("__turn"), F.lit(trees)).cast("int"))
    order = Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed + 1), "tree", *key), *key)
    sample = drawn.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= sample_size)
    names = [f"__x{i}" for i in range(len(columns))]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        ordered = pdf.sort_values("__rn")
        nodes = _grow_tree(ordered[names].to_numpy(float), sample_size, np.random.default_rng([seed, tree]))
        return pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "size", "depth"]).assign(tree=tree)

    schema = "node int, feature int, cut double, left int, right int, size int, depth int, tree int"
    grown = sample.select("tree", "__rn", *names).groupBy("tree").applyInPandas(grow, schema).toPandas()
    built = tuple(
        {c: part.sort_values("node")[c].to_numpy() for c in ("feature", "cut", "left", "right", "size", "depth")}
        for _, part in grown.groupby("tree")
    )
    return IsolationForest(tuple(columns), built, min(sample_size, max(total, 1)), total)


def _expected_depth(n: float | np.ndarray) -> float | np.ndarray:
    """Mean depth of an unsuccessful search among n values (published normaliser)."""
    n = np.asarray(n, dtype=float)
    inner = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    depth = np.where(n > 2, inner, np.where(n == 2, 1.0, 0.0))
    return depth if depth.ndim else float(depth)


def _grow_tree(x: np.ndarray, sample_size: int, rng: np.random.Generator) -> list[tuple]:
    limit = math.ceil(math.log2(max(sample_size, 2)))
    nodes: list[list] = []

    def place(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(rows), depth])
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(usable):
            f = int(rng.choice(usable))
            cut = float(rng.uniform(low[f], high[f]))
            goes_left = rows[:, f] <= cut
            if 0 < goes_left.sum() < len(rows):
                left = place(rows[goes_left], depth + 1)
                right = place(rows[~goes_left], depth + 1)
                nodes[me][1:5] = [f, cut, left, right]
        return me

    place(x, 0)
    return [tuple(n) for n in nodes]


@dataclass(frozen=True)
class _Grove:
    """All trees in one set of arrays; a leaf points to itself, so every row walks alike."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    steps: int

    @staticmethod
    def plant(trees: Sequence[dict[str, np.ndarray]]) -> _Grove:
        sizes = [len(t["feature"]) for t in trees]
        roots = np.cumsum([0, *sizes[:-1]])
        joined = {c: np.concatenate([t[c] for t in trees]) for c in trees[0]}
        offset = np.repeat(roots, sizes)
        leaf, here = joined["feature"] < 0, np.arange(sum(sizes))
        return _Grove(
            roots, np.where(leaf, 0, joined["feature"]), joined["cut"],
            np.where(leaf, here, joined["left"] + offset), np.where(leaf, here, joined["right"] + offset),
            joined["depth"] + _expected_depth(joined["size"]), int(joined["depth"].max()),
        )

    def depth(self, x: np.ndarray) -> np.ndarray:
        """Sum of the path lengths of each row over all trees."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.steps):
            at = np.where(x[row, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.length[at].sum(axis=1)


def flag_isolated(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    contamination: float = 0.05,
    trees: int = 100,
    sample_size: int = 256,
    seed: int = 70,
) -> DataFrame:
    """Score rows and flag the most isolated share of them."""
    forest = fit_isolation_forest(df, key, columns, trees, sample_size, seed)
    scored = materialize(forest.score(spread(complete(df, columns), forest.rows)), "scores")
    cut = exact_quantiles(scored, ["score"], [1.0 - contamination])["score"][0]
    return scored.withColumn(FLAG, F.col("score") > F.lit(cut))
