"""Scaling, PCA, expansion and repeatable splits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayspark.functions.columns import HASH_BITS, digest, hash_below, number
from assayspark.plans.subspace import complete_vectors, matrix, moments, scatter_times, tall_factor

SPLIT = "split"


def assemble(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Features as one vector and the target as label; rows must be complete."""
    ready = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    return ready.withColumn("label", F.col(target).cast("double"))


# ------------------------------------------------------------------------ scaling


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations learnt on the training rows."""

    mean: dict[str, float]
    std: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return self._each(df, lambda c: (F.col(c) - F.lit(self.mean[c])) / F.lit(self.std[c]))

    def inverse(self, df: DataFrame) -> DataFrame:
        return self._each(df, lambda c: F.col(c) * F.lit(self.std[c]) + F.lit(self.mean[c]))

    def _each(self, df: DataFrame, rule) -> DataFrame:
        return df.select(*[rule(c).alias(c) if c in self.mean else F.col(c) for c in df.columns])


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> Scaler:
    """One aggregate over the training rows; a constant column gets scale 1."""
    row = train.agg(*[F.avg(number(c)) for c in columns], *[F.stddev_pop(number(c)) for c in columns]).first()
    k = len(columns)
    mean = {c: row[i] if row[i] is not None else 0.0 for i, c in enumerate(columns)}
    return Scaler(mean, {c: row[k + i] or 1.0 for i, c in enumerate(columns)})


@dataclass(frozen=True)
class RangeScaler:
    """Maps the training range of a column to [-1, 1] and back."""

    column: str
    low: float
    high: float

    def to_unit(self, value: Column) -> Column:
        return F.try_divide(F.lit(2.0) * (value - F.lit(self.low)), F.lit(self.high - self.low)) - 1

    def from_unit(self, value: Column) -> Column:
        return value * F.lit((self.high - self.low) / 2) + F.lit((self.high + self.low) / 2)


def fit_range(train: DataFrame, column: str) -> RangeScaler:
    low, high = train.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    return RangeScaler(column, low, high)


# ---------------------------------------------------------------------------- pca


@dataclass(frozen=True)
class Projection:
    """Principal axes; each axis points to its largest loading."""

    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    explained: tuple[float, ...]
    variances: tuple[float, ...]
    passes: int
    converged: bool

    def transform(self, df: DataFrame, vectors: str, prefix: str = "Micro_") -> DataFrame:
        """Add one column per component, null where there is no vector; rows are projected a batch at a time."""
        mean, axes, d = np.array(self.mean), np.array(self.components).T, len(self.mean)
        names = [f"{prefix}{i + 1}" for i in range(len(self.components))]
        kept = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(batch.num_columns - 1)
                there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                scores = np.full((batch.num_rows, len(names)), np.nan)
                if len(there):
                    scores[there] = (matrix(column.take(pa.array(there)), d) - mean) @ axes
                missing = np.isnan(scores)
                made = [pa.array(scores[:, i], mask=missing[:, i]) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*kept, *names])

        schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
        return df.select("*", F.col(vectors).cast("array<double>").alias("__v")).mapInArrow(run, schema)

    def parameters(self, spark: SparkSession) -> DataFrame:
        """One row per component: variance, its share, and loadings."""
        rows = [
            (i + 1, e, v, list(c), list(self.mean))
            for i, (e, v, c) in enumerate(zip(self.explained, self.variances, self.components, strict=True))
        ]
        return spark.createDataFrame(
            rows, "component int, explained_ratio double, variance double, loadings array<double>, mean array<double>"
        )


def project_with(df: DataFrame, parameters: DataFrame, vectors: str, prefix: str = "Micro_") -> DataFrame:
    """Components of vectors from a stored parameter table, without the fitted model."""
    axes = parameters.orderBy("component").collect()
    centre = [float(v) for v in axes[0]["mean"]] if axes else []
    values = F.zip_with(F.col(vectors).cast("array<double>"), F.lit(centre).cast("array<double>"), lambda v, m: v - m)
    ready = df.withColumn("__v", values)
    sums = [
        F.aggregate(F.zip_with("__v", F.lit([float(x) for x in a["loadings"]]).cast("array<double>"), lambda v, w: v * w),
                    F.lit(0.0), lambda s, x: s + x).alias(f"{prefix}{a['component']}")
        for a in axes
    ]
    return ready.select(*df.columns, *sums)


def fit_pca(
    df: DataFrame, vectors: str, k: int = 70, oversample: int = 10, whole: int = 128, max_passes: int = 60, tolerance: float = 1e-9, seed: int = 70,
) -> Projection:
    """The first k principal axes by a randomised range finder.

    A random subspace of k + ``oversample`` dimensions (all, up to ``whole`` dimensions) is sent through the
    scatter matrix until the variances in it stay within ``tolerance``; they come from the singular values
    of the tall projected matrix, so they are not squared on the way. A full subspace needs no such pass.
    """
    rows = complete_vectors(df, vectors)
    first = rows.first()
    if first is None:
        raise ValueError("no complete vector to learn from")
    d = len(first["v"])
    k = min(k, d)
    size = d if d <= whole else min(d, k + oversample)
    n, mean, scatter = moments(rows, d)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, size)))[0] if size < d else np.eye(d)
    passes, converged, before = 0, size == d, np.zeros(k)
    while True:
        _, singular, turn = np.linalg.svd(tall_factor(rows, mean, basis))
        singular = np.pad(singular, (0, size - len(singular)))
        change = np.abs(singular[:k] ** 2 - before).max(initial=0.0)
        converged = converged or change <= tolerance * max(singular[0] ** 2, 1e-300)
        if converged or passes >= max_passes:
            break
        before = singular[:k] ** 2
        basis = np.linalg.qr(scatter_times(rows, mean, basis))[0]
        passes += 1
    axes = (basis @ turn.T)[:, :k]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    variances = singular[:k] ** 2 / max(n - 1, 1)
    total = scatter / max(n - 1, 1)
    return Projection(
        tuple(mean.tolist()), tuple(tuple(c) for c in axes.T.tolist()),
        tuple((variances / total if total > 0 else np.zeros(k)).tolist()), tuple(variances.tolist()), passes, bool(converged))


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2, output: str = "expanded") -> DataFrame:
    """All products of the columns up to a degree, without a constant term."""
    ready = VectorAssembler(inputCols=list(columns), outputCol="__v").transform(df)
    return PolynomialExpansion(degree=degree, inputCol="__v", outputCol=output).transform(ready).drop("__v")


# ------------------------------------------------------------------------- splits


# The smallest and the largest share of test rows.
TEST_SHARES = (0.05, 0.5)


def _test_share(wanted: float) -> float:
    low, high = TEST_SHARES
    return min(max(float(wanted), low), high)


def train_test(df: DataFrame, key: Sequence[str], test_size: float = 0.2, seed: int = 70) -> DataFrame:
    """Tag rows train or test by a hash of the key; no shuffle, the same on every run."""
    share = _test_share(test_size)
    return df.withColumn(SPLIT, F.when(hash_below(share, seed, *key), "test").otherwise("train"))


def train_val_test(
    df: DataFrame, key: Sequence[str], test_size: float = 0.2, val_size: float = 0.15, seed: int = 70
) -> DataFrame:
    """Cut off the test rows, then the validation rows from what is left."""
    share = _test_share(test_size)
    tag = (
        F.when(hash_below(share, seed, *key), "test")
        .when(hash_below(val_size, f"{seed}:val", *key), "val")
        .otherwise("train")
    )
    return df.withColumn(SPLIT, tag)


def by_source(df: DataFrame, source: str, real: str = "real") -> DataFrame:
    """Real rows test what the other rows train."""
    return df.withColumn(SPLIT, F.when(F.col(source) == real, "test").otherwise("train"))


def source_weights(df: DataFrame, source: str, weight: float = 0.2, real: str = "real") -> DataFrame:
    """-1 for real rows, the given weight for the others."""
    return df.withColumn("weight", F.when(F.col(source) == real, F.lit(-1.0)).otherwise(F.lit(float(weight))))


def folds(df: DataFrame, key: Sequence[str], k: int = 5, seed: int = 70) -> DataFrame:
    """Fold number 0 .. k-1 by a hash of the key."""
    k = max(2, min(int(k), 10))
    bits = F.conv(F.substring(digest(f"{seed}:fold", *key), 1, HASH_BITS // 4), 16, 10).cast("bigint")
    return df.withColumn("fold", F.pmod(bits, F.lit(k)).cast("int"))


# ----------------------------------------------------------------- postprocessing


def postprocess(df: DataFrame, clipped: Sequence[str], features: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Shares and target are cut at zero and rounded; features are only rounded."""
    def shaped(field: T.StructField) -> Column:
        c = F.col(field.name)
        if field.name in clipped:
            c = F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
        return F.round(c, digits).alias(field.name) if field.name in (*clipped, *features) else c

    return df.select(*[shaped(f) for f in df.schema.fields])
