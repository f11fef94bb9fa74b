"""Regression models with one interface: ``fit(train)`` gives something with ``predict(df)``."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayspark.operators.prepare import Scaler, fit_scaler
from assayspark.plans.layout import spread

PREDICTION = "prediction"
NORMAL_SOLVER_LIMIT = 4096


@dataclass(frozen=True)
class FittedPipeline:
    """Spark ML pipeline, optionally behind a scaler; keeps the input columns as they are."""

    model: PipelineModel
    features: tuple[str, ...]
    scaler: Scaler | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        inputs = {c: F.col(c).cast("double") for c in self.features}
        if self.scaler is not None:
            inputs = {c: (v - F.lit(self.scaler.mean[c])) / F.lit(self.scaler.std[c]) for c, v in inputs.items()}
        ready = df.withColumns({f"__f_{c}": v for c, v in inputs.items()})
        return self.model.transform(ready).select(*df.columns, PREDICTION)


def _prepared(train: DataFrame, features: Sequence[str], target: str, scaler: Scaler | None) -> DataFrame:
    scaled = train.select(*[F.col(c).cast("double").alias(c) for c in features],
                          F.col(target).cast("double").alias("__label"))
    if scaler is not None:
        scaled = scaler.transform(scaled)
    return scaled.select(*[F.col(c).alias(f"__f_{c}") for c in features], "__label")


def _assembler(features: Sequence[str], output: str = "__features") -> VectorAssembler:
    return VectorAssembler(inputCols=[f"__f_{c}" for c in features], outputCol=output)


def fit_linear(train: DataFrame, features: Sequence[str], target: str, scale: bool = False) -> FittedPipeline:
    """Ordinary least squares with an intercept."""
    scaler = fit_scaler(train, features) if scale else None
    stage = LinearRegression(featuresCol="__features", labelCol="__label", predictionCol=PREDICTION,
                             regParam=0.0, solver="normal" if len(features) <= NORMAL_SOLVER_LIMIT else "l-bfgs")
    fitted = Pipeline(stages=[_assembler(features), stage]).fit(_prepared(train, features, target, scaler))
    return FittedPipeline(fitted, tuple(features), scaler)


def fit_poly_ridge(
    train: DataFrame, features: Sequence[str], target: str, degree: int = 2, alpha: float = 1.0
) -> FittedPipeline:
    """Scaled polynomial terms with a squared penalty alpha on the coefficients.

    Spark minimises a per-row loss on a scaled label, so its parameter is alpha / n times the
    label's deviation: the population one for the normal equations, the sample one for l-bfgs.
    """
    scaler = fit_scaler(train, features)
    data = _prepared(train, features, target, scaler)
    n, pop, sample = data.agg(F.count("__label"), F.stddev_pop("__label"), F.stddev_samp("__label")).first()
    terms = math.comb(len(features) + degree, degree) - 1
    normal = terms <= NORMAL_SOLVER_LIMIT
    deviation = (pop if normal else sample) or 1.0
    stage = LinearRegression(
        featuresCol="__features", labelCol="__label", predictionCol=PREDICTION, elasticNetParam=0.0,
        regParam=alpha / max(n, 1) * deviation, standardization=False,
        solver="normal" if normal else "l-bfgs", tol=1e-10, maxIter=500,
    )
    expand = PolynomialExpansion(degree=degree, inputCol="__raw", outputCol="__features")
    fitted = Pipeline(stages=[_assembler(features, "__raw"), expand, stage]).fit(data)
    return FittedPipeline(fitted, tuple(features), scaler)


# ------------------------------------------------------------- support vector regression


@dataclass(frozen=True)
class FourierMap:
    """Random cosine features whose inner products approximate the RBF kernel."""

    frequencies: np.ndarray
    phases: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return math.sqrt(2.0 / len(self.phases)) * np.cos(x @ self.frequencies + self.phases)

    @staticmethod
    def draw(width: int, size: int, gamma: float, seed: int) -> FourierMap:
        rng = np.random.default_rng(seed)
        return FourierMap(rng.normal(0.0, math.sqrt(2.0 * gamma), (width, size)), rng.uniform(0, 2 * math.pi, size))


@dataclass(frozen=True)
class FittedSvr:
    """Weights on scaled (and possibly mapped) features, plus an intercept."""

    features: tuple[str, ...]
    scaler: Scaler
    weights: np.ndarray
    mapping: FourierMap | None
    losses: tuple[float, ...] = field(default=())
    converged: bool = True

    @property
    def passes(self) -> int:
        return len(self.losses)

    def predict(self, df: DataFrame) -> DataFrame:
        mean = np.array([self.scaler.mean[c] for c in self.features])
        std = np.array([self.scaler.std[c] for c in self.features])
        weights, mapping = self.weights, self.mapping
        if mapping is None:
            terms = F.lit(float(weights[-1]))
            for j, c in enumerate(self.features):
                terms = terms + F.lit(float(weights[j])) * (F.col(c) - F.lit(float(mean[j]))) / F.lit(float(std[j]))
            return df.withColumn(PREDICTION, terms)

        @F.pandas_udf("double")
        def decide(*series: pd.Series) -> pd.Series:
            x = (np.column_stack([s.to_numpy(float) for s in series]) - mean) / std
            return pd.Series(mapping(x) @ weights[:-1] + weights[-1])

        return df.withColumn(PREDICTION, decide(*[F.col(c).cast("double") for c in self.features]))


def fit_svr(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    C: float = 1.0,
    epsilon: float = 0.1,
    kernel: str = "linear",
    gamma: float | str = "scale",
    map_size: int = 128,
    max_passes: int = 60,
    tolerance: float = 1e-6,
    seed: int = 70,
) -> FittedSvr:
    """Minimise |w|^2 / 2 + C * sum(max(0, |residual| - epsilon)) by reweighted least squares.

    Every pass is one Spark job that adds up d x d partial sums per task; only those sums and
    the weights travel. The RBF kernel is approximated by random cosine features, so that
    variant approaches the kernel solution as ``map_size`` grows. A pass that gains less than
    ``tolerance`` of the objective ends the search; if none does, ``converged`` is false and a
    warning is given.
    """
    scaler = fit_scaler(train, features)
    source = _prepared(train, features, target, scaler).persist()
    count, start, deviation = source.agg(F.count(F.lit(1)), F.avg("__label"), F.stddev_pop("__label")).first()
    data = spread(source, count).persist()
    mapping = None
    if kernel == "rbf":
        scale = 1.0 / len(features) if gamma == "scale" else float(gamma)
        mapping = FourierMap.draw(len(features), map_size, scale, seed)
    width = (map_size if mapping is not None else len(features)) + 1
    weights = np.zeros(width)
    weights[-1] = start or 0.0
    floor = max(1e-3 * (deviation or 1.0), 1e-9)
    losses: list[float] = []
    best, converged = weights, False
    try:
        for _ in range(max_passes):
            normal, right, loss = _svr_pass(data, len(features), weights, mapping, epsilon, floor)
            objective = 0.5 * float(weights[:-1] @ weights[:-1]) + C * loss
            if losses and objective > min(losses) * (1 - tolerance):
                best = weights if objective < min(losses) else best
                losses.append(objective)
                converged = True
                break
            losses.append(objective)
            best = weights
            penalty = np.diag([1.0] * (width - 1) + [0.0])
            weights = np.linalg.lstsq(penalty + C * normal, C * right, rcond=None)[0]
    finally:
        data.unpersist()
        source.unpersist()
    if not converged:
        warnings.warn(f"support vector regression stopped after {max_passes} passes", stacklevel=2)
    return FittedSvr(tuple(features), scaler, best, mapping, tuple(losses), converged)


def _svr_pass(
    data: DataFrame, width: int, weights: np.ndarray, mapping: FourierMap | None, epsilon: float, floor: float
) -> tuple[np.ndarray, np.ndarray, float]:
    """One pass: weighted normal matrix, right side and the loss at the current weights."""
    d = len(weights)

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        normal, right, loss = np.zeros((d, d)), np.zeros(d), 0.0
        for pdf in batches:
            values = pdf.to_numpy(float)
            x, y = values[:, :width], values[:, width]
            z = np.column_stack([x if mapping is None else mapping(x), np.ones(len(x))])
            residual = y - z @ weights
            excess = np.abs(residual) - epsilon
            out = excess > 0
            loss += float(excess[out].sum())
            pull = 1.0 / np.maximum(excess[out], floor)
            zw = z[out] * pull[:, None]
            normal += zw.T @ z[out]
            right += zw.T @ (y[out] - epsilon * np.sign(residual[out]))
        flat = np.concatenate([normal.ravel(), right, [loss]])
        yield pd.DataFrame({"cell": np.arange(len(flat)), "v": flat})

    cells = data.mapInPandas(partials, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(d * d + d + 1)
    for cell, v in cells:
        flat[cell] = v
    return flat[: d * d].reshape(d, d), flat[d * d: -1], float(flat[-1])


# ---------------------------------------------------------------------------- catalogue

Fit = Callable[..., object]


def _rbf(train: DataFrame, features: Sequence[str], target: str, **params) -> FittedSvr:
    return fit_svr(train, features, target, **{"kernel": "rbf", **params})


MODELS: dict[str, Fit] = {
    "LinearRegression": fit_linear,
    "PolynomialRegression": fit_poly_ridge,
    "SVR": _rbf,
    "LR": lambda train, features, target, **p: fit_linear(train, features, target, scale=True, **p),
    "PR": lambda train, features, target, **p: fit_poly_ridge(train, features, target, **{"degree": 1, **p}),
    "LinearSVR": fit_svr,
}


def model_named(name: str) -> Fit:
    """Fitting function by name; unknown names mean linear regression."""
    return MODELS.get(name, fit_linear)


def fit_model(name: str, train: DataFrame, features: Sequence[str], target: str, **params):
    """Fit the named model on the training rows; unset parameters keep their defaults."""
    given = {k: v for k, v in params.items() if v not in (None, "")}
    return model_named(name)(train, features, target, **given)


def with_residual(model, df: DataFrame, target: str) -> DataFrame:
    """Predictions and residuals (actual minus predicted)."""
    return model.predict(df).withColumn("residual", F.col(target) - F.col(PREDICTION))
