"""Regression metrics, model comparison and scatter tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayspark.functions.columns import number
from assayspark.operators.models import PREDICTION, fit_model, with_residual
from assayspark.plans.gram import grouped_gram
from assayspark.plans.layout import spread
from assayspark.plans.positions import ordering, rows_at

# Order of the models and splits in a report.
MODEL_ORDER = ("DDPG", "LR", "PR", "SVR")
SPLIT_ORDER = ("train", "test")
# Models compared when none are named.
COMPARED = ("LinearRegression", "PolynomialRegression", "SVR")
# Digits shown per metric.
DIGITS = {"rmse": 2, "mae": 2, "r2": 4, "mape": 2}


def metrics(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (), zero: float = 0.0
) -> DataFrame:
    """n, RMSE, MAE, R2 and MAPE (percent) per group in one aggregate, over the rows that have both values.

    The total sum of squares comes from the population variance, which Spark computes with
    centred sums. R2 is null for a constant target. MAPE leaves out targets with
    ``abs(y) <= zero`` and is 0 when none is left.
    """
    e = number(actual) - number(predicted)
    y = F.when(e.isNotNull(), number(actual))
    spread = F.var_pop(y) * F.count(y)
    relative = F.when(F.abs(y) > F.lit(zero), F.abs(e / y))
    return df.groupBy(*by).agg(
        F.count(e).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(spread > 0, 1 - F.sum(e * e) / spread).alias("r2"),
        F.coalesce(F.avg(relative) * 100, F.lit(0.0)).alias("mape"),
    )


def display(table: DataFrame) -> DataFrame:
    """Metrics rounded for a report."""
    return table.select(*[F.round(c, DIGITS[c]).alias(c) if c in DIGITS else F.col(c) for c in table.columns])


def _rank_in(column: str, names: Sequence[str]) -> Column:
    rank = F.lit(9)
    for i, name in reversed(list(enumerate(names))):
        rank = F.when(F.col(column) == name, i).otherwise(rank)
    return rank


def report_order(table: DataFrame, model: str = "model", split: str = "split") -> DataFrame:
    """Training rows first, then the fixed model order; unknown models last."""
    return table.orderBy(_rank_in(split, SPLIT_ORDER), _rank_in(model, MODEL_ORDER), model)


def compare_models(
    rows: DataFrame,
    features: Sequence[str],
    target: str,
    models: Sequence[str] = COMPARED,
    params: Mapping[str, Mapping[str, object]] | None = None,
    split: str = "split",
    fold: str | None = None,
) -> DataFrame:
    """Fit the models on the train rows and score both splits; a failing one yields its error.

    With a ``fold`` column the train rows are cross-validated too: mean and deviation of R2 and
    the scores by fold. ``best`` marks the model with the highest R2 on the test rows.
    """
    source = rows.select(*features, target, split, *([fold] if fold else [])).persist()
    held = spread(source, source.count()).persist()
    scored = []
    try:
        for name in models:
            try:
                chosen, train = (params or {}).get(name, {}), held.where(F.col(split) == "train")
                model = fit_model(name, train, features, target, **chosen)
                table = metrics(model.predict(held), target, PREDICTION, [split])
                found = table.select(split, "n", "rmse", "mae", "r2", "mape").collect()
                cv = [None, None, None]
                if fold:
                    folds = sorted(tuple(r) for r in cross_validate(train, features, target, fold, name, **chosen).collect())
                    known = [s for _, s in folds if s is not None]
                    cv = [float(np.mean(known)), float(np.std(known)), [s for _, s in folds]] if known else cv
                scored += [(name, *r, *cv, None) for r in found]
            except Exception as problem:  # one model's failure is part of the report
                scored.append((name, *[None] * 9, str(problem).splitlines()[0]))
    finally:
        held.unpersist()
        source.unpersist()
    tested = [(row[5], row[0]) for row in scored if row[1] == "test" and row[5] is not None]
    best = max(tested)[1] if tested else None
    schema = (
        f"model string, {split} string, n bigint, rmse double, mae double, r2 double, mape double, cv_r2_mean double, "
        "cv_r2_std double, cv_scores array<double>, error string, best boolean"
    )
    return rows.sparkSession.createDataFrame([(*row, row[0] == best) for row in scored], schema)


def cross_validate(
    train: DataFrame, features: Sequence[str], target: str, fold: str = "fold", model: str = "LinearRegression",
    threads: int = 4, **params,
) -> DataFrame:
    """R2 per fold. Linear models need two passes in all; others are fitted fold by fold."""
    held = train.select(*features, target, fold).persist()
    try:
        if model == "LinearRegression":
            rows = _linear_folds(held, features, target, fold)
        else:
            names = sorted(r[0] for r in held.select(fold).distinct().collect())

            def one(f: int) -> tuple[int, float | None]:
                fitted = fit_model(model, held.where(F.col(fold) != f), features, target, **params)
                score = metrics(fitted.predict(held.where(F.col(fold) == f)), target, PREDICTION).first()
                return f, score["r2"]

            with ThreadPoolExecutor(threads) as pool:
                rows = list(pool.map(one, names))
    finally:
        held.unpersist()
    return train.sparkSession.createDataFrame(rows, "fold int, r2 double")


def _linear_folds(held: DataFrame, features: Sequence[str], target: str, fold: str) -> list[tuple[int, float | None]]:
    """Least squares without each fold from per-fold cross products; no row is read per fold."""
    columns = [*features, target]
    centre = held.agg(*[F.avg(c) for c in columns]).first()
    grams = grouped_gram(held.select(fold, *[F.col(c).cast("double").alias(c) for c in columns]), columns, fold, list(centre))
    whole = sum(grams.values())
    rows = []
    for f, own in sorted(grams.items()):
        rest = whole - own
        beta = np.linalg.lstsq(rest[:-1, :-1], rest[:-1, -1], rcond=None)[0]
        squared = own[-1, -1] - 2 * beta @ own[:-1, -1] + beta @ own[:-1, :-1] @ beta
        spread = own[-1, -1] - own[0, -1] ** 2 / own[0, 0]
        rows.append((f, float(1 - squared / spread) if spread > 0 else None))
    return rows


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return scores.agg(
        F.count("r2").alias("folds"), F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std")
    )


def best_models(table: DataFrame, model: str = "model") -> DataFrame:
    """Model with the highest R2 and model with the lowest RMSE among the test rows."""
    return table.where(F.col("split") == "test").agg(
        F.max_by(model, "r2").alias("best_r2_model"),
        F.max("r2").alias("best_r2"),
        F.min_by(model, "rmse").alias("best_rmse_model"),
        F.min("rmse").alias("best_rmse"),
    )


def pivot_metric(table: DataFrame, model: str, values: Sequence[str], metric_names: Sequence[str] = tuple(DIGITS)) -> DataFrame:
    """Metric by model matrix; ``values`` names the models, so no extra job looks for them."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metric_names])
    long = table.select(model, F.inline(entries))
    return long.groupBy("metric").pivot(model, list(values)).agg(F.max("value"))


def scatter_points(df: DataFrame, actual: str, predicted: str, split: str = "split", which: str = "test") -> DataFrame:
    """(x, y) = (actual, predicted) of one split."""
    return df.where(F.col(split) == which).select(F.col(actual).alias("x"), F.col(predicted).alias("y"))


def downsample(df: DataFrame, key: Sequence[str], limit: int = 300) -> DataFrame:
    """Every ceil(n / limit)-th point in key order, all of them when there are few."""
    total = df.count()
    step = max(1, -(-total // limit))
    return rows_at(df, ordering(df, key), range(1, total + 1, step))


def extent(df: DataFrame, x: str, y: str) -> DataFrame:
    """Common axis range of both columns: with a margin of 10, and with 10 percent."""
    low, high = F.least(F.min(x), F.min(y)), F.greatest(F.max(x), F.max(y))
    return df.agg(low.alias("low"), high.alias("high")).select(
        (F.col("low") - 10).alias("axis_min"), (F.col("high") + 10).alias("axis_max"),
        (F.col("low") * 0.9).alias("plot_min"), (F.col("high") * 1.1).alias("plot_max"),
    )


def prediction_table(model, rows: DataFrame, target: str) -> DataFrame:
    """Predictions of all splits in one pass; the rows keep the column that names their split."""
    return with_residual(model, rows, target)
