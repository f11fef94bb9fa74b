"""Synthetic rows drawn from the joint distribution of the real ones: a Gaussian copula.

Every column keeps its own shape as a quantile function, stored at normal scores in equal steps; what
columns have to do with each other is the correlation of their normal scores. A synthetic row is a
correlated normal vector, sent through the quantile functions, so no value leaves the range of its column
and none piles up at a bound that the real values do not have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.functions.columns import normal
from assayspark.plans.gram import grouped_gram
from assayspark.plans.quantiles import quantile_functions

#: Normal scores at which a quantile function is stored: from -REACH to REACH, DENSITY to a deviation.
REACH, DENSITY = 4, 32
STEPS = 2 * REACH * DENSITY
#: No more than this share of a column lies between two stored quantiles, which bounds the distance between the
#: distribution of synthetic values and that of the real ones (beside the chance of the draw).
LARGEST_GAP = math.erf(0.5 / DENSITY / math.sqrt(2))


def knot_shares() -> list[float]:
    """The share of values below each stored quantile; the outermost are the smallest and the largest value."""
    inner = [0.5 * (1 + math.erf((k / DENSITY - REACH) / math.sqrt(2))) for k in range(1, STEPS)]
    return [0.0, *inner, 1.0]


@dataclass(frozen=True)
class JointShape:
    """Quantile functions, correlation of the normal scores and its lower factor; d x (STEPS + 1) and d x d numbers."""

    columns: tuple[str, ...]
    quantiles: np.ndarray
    correlation: np.ndarray
    factor: np.ndarray
    rows: int


def normal_scores(values: np.ndarray, quantiles: np.ndarray) -> np.ndarray:
    """Normal scores of real values: between two quantiles in proportion, on several equal ones their middle."""
    low, high = np.searchsorted(quantiles, values, "left"), np.searchsorted(quantiles, values, "right")
    before = np.clip(low - 1, 0, STEPS - 1)
    width = quantiles[before + 1] - quantiles[before]
    between = before + (values - quantiles[before]) / np.where(width > 0, width, 1.0)
    return np.where(high > low, (low + high - 1) / 2, between) / DENSITY - REACH


def values_at(scores: np.ndarray, quantiles: np.ndarray) -> np.ndarray:
    """The quantile function at normal scores; beyond the outermost it stays there."""
    place = np.clip((scores + REACH) * DENSITY, 0, STEPS)
    before = np.minimum(np.floor(place).astype(np.int64), STEPS - 1)
    return quantiles[before] + (place - before) * (quantiles[before + 1] - quantiles[before])


def lower_factor(correlation: np.ndarray) -> np.ndarray:
    """Cholesky factor; a column that follows from those before it gets no noise of its own."""
    d = len(correlation)
    factor = np.zeros((d, d))
    for j in range(d):
        left = correlation[j, j] - factor[j, :j] @ factor[j, :j]
        if left > 1e-9:
            factor[j, j] = math.sqrt(left)
            factor[j + 1 :, j] = (correlation[j + 1 :, j] - factor[j + 1 :, :j] @ factor[j, :j]) / factor[j, j]
    return factor


def fit_joint(df: DataFrame, columns: Sequence[str]) -> JointShape:
    """Exact quantiles of the complete rows, then one pass for the sums of their normal scores."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).replace(float("nan"), None).dropna()
    found = quantile_functions(rows, columns, knot_shares())
    if any(found[c][0] is None for c in columns):
        raise ValueError("no complete row to learn from")
    quantiles = np.array([found[c] for c in columns], dtype=float)
    names = list(columns)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame({f"z{j}": normal_scores(pdf[c].to_numpy(float), quantiles[j]) for j, c in enumerate(names)})
            out["__one"] = 0
            yield out

    d = len(names)
    scores = rows.mapInPandas(score, ", ".join(f"z{j} double" for j in range(d)) + ", `__one` int")
    sums = grouped_gram(scores, [f"z{j}" for j in range(d)], "__one")[0]
    n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
    covariance = sums[1:, 1:] / n - np.outer(mean, mean)
    std = np.sqrt(np.clip(np.diag(covariance), 0.0, None))
    safe = np.where(std > 0, std, 1.0)
    correlation = covariance / np.outer(safe, safe)
    np.fill_diagonal(correlation, 1.0)
    return JointShape(tuple(columns), quantiles, correlation, lower_factor(correlation), int(round(n)))


def generate(
    spark: SparkSession, shape: JointShape, rows: int = 10_000, seed: int = 70, noise: DataFrame | None = None,
) -> DataFrame:
    """Correlated rows with the columns' own distributions.

    The noise of a row depends on (seed, row number) only, so the result does not depend on
    partitioning and a lost task draws the same rows again. Its md5 numbers are the same in SQL.
    """
    d = len(shape.columns)
    if noise is None:
        ids = spark.range(1, rows + 1)
        noise = ids.select("id", *[normal(f"{seed}:{j}", "id").alias(f"z{j}") for j in range(d)])
    quantiles, factor = shape.quantiles, shape.factor

    def shaped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = pdf[[f"z{j}" for j in range(d)]].to_numpy(float) @ factor.T
            out = pd.DataFrame({f"v{j}": values_at(z[:, j], quantiles[j]) for j in range(d)})
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    schema = "id bigint, " + ", ".join(f"v{j} double" for j in range(d))
    made = noise.mapInPandas(shaped, schema)
    return made.select("id", *[F.col(f"v{j}").alias(c) for j, c in enumerate(shape.columns)])


def name_rows(df: DataFrame, id_column: str = "id", name: str = "Image_Name", prefix: str = "Generated_") -> DataFrame:
    """Sample names from the running number."""
    return df.withColumn(name, F.concat(F.lit(prefix), F.col(id_column).cast("string")))


def combine(real: DataFrame, synthetic: DataFrame, source: str = "source") -> DataFrame:
    """Real and synthetic rows with their provenance."""
    common = [c for c in real.columns if c in synthetic.columns]
    return (
        real.select(*common).withColumn(source, F.lit("real"))
        .unionByName(synthetic.select(*common).withColumn(source, F.lit("synthetic")))
    )


def fidelity(
    combined: DataFrame, columns: Sequence[str], source: str = "source", band: tuple[float, float] | None = None
) -> DataFrame:
    """Mean, deviation and share of band-valid rows per column and source, one aggregate."""
    measures = [m for i, c in enumerate(columns) for m in (F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"))]
    if band is None:
        valid = F.lit(1.0)
    else:
        total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
        valid = F.avg(F.when(total.between(*band), 1.0).otherwise(0.0))
    row = combined.groupBy(source).agg(F.count(F.lit(1)).alias("n"), valid.alias("valid_share"), *measures)
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
        for i, c in enumerate(columns)
    ]
    return row.select(source, "n", "valid_share", F.inline(F.array(*entries)))
