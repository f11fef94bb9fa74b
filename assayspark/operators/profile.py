"""Column profiles, histograms and two-dimensional density."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayspark.functions.columns import number, numeric_columns, row_sum
from assayspark.plans.quantiles import exact_quantiles

_SIMPLE = {
    "count": F.count, "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp,
}
_QUANTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75}


def _profile(df: DataFrame, columns: Sequence[str], stats: Sequence[str], approx: bool) -> DataFrame:
    """One row per column; all simple statistics come from one aggregate."""
    values = {c: number(c) for c in columns}
    wanted = [s for s in stats if s in _QUANTILES]
    shares = [_QUANTILES[s] for s in wanted]
    simple = ["count", *[s for s in stats if s in _SIMPLE and s != "count"]]
    measures = [_SIMPLE[s](values[c]).alias(f"{s}_{i}") for i, c in enumerate(columns) for s in simple]
    exact: dict[str, list[float | None]] = {}
    if wanted and approx:
        measures += [F.percentile_approx(values[c], shares, 10_000).alias(f"quantiles_{i}") for i, c in enumerate(columns)]
    elif wanted:
        exact = exact_quantiles(df, columns, shares)

    def cell(stat: str, i: int, column: str) -> Column:
        if stat in _SIMPLE:
            return F.col(f"{stat}_{i}")
        if approx:
            return F.col(f"quantiles_{i}")[wanted.index(stat)].cast("double")
        return F.lit(exact[column][wanted.index(stat)]).cast("double")

    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"count_{i}").alias("__n"),
            *[cell(s, i, c).alias(s) for s in stats],
        )
        for i, c in enumerate(columns)
    ]
    rows = df.agg(*measures).select(F.inline(F.array(*entries)))
    return rows.where(F.col("__n") > 0).drop("__n")


def profile_columns(
    df: DataFrame, columns: Sequence[str] | None = None, skip: Sequence[str] = (), approx: bool = False
) -> DataFrame:
    """count, min, max, mean, std, median and quartiles of every numeric column with values."""
    chosen = list(columns) if columns is not None else numeric_columns(df, skip)
    return _profile(df, chosen, ["count", "min", "max", "mean", "std", "median", "q1", "q3"], approx)


def profile_elements(df: DataFrame, composition: Sequence[str], approx: bool = False) -> DataFrame:
    """mean, median, quartiles and range of the share columns; columns without values are left out."""
    present = [c for c in composition if c in df.columns]
    return _profile(df, present, ["mean", "median", "q1", "q3", "min", "max"], approx)


def profile_target(df: DataFrame, target: str, approx: bool = False) -> DataFrame:
    """Number of rows and columns and the main statistics of the target, as one row."""
    y = number(target)
    median = (
        F.percentile_approx(y, 0.5, 10_000).cast("double")
        if approx else F.lit(exact_quantiles(df, [target], [0.5])[target][0]).cast("double")
    )
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        median.alias("median"),
    )


def histogram_edges(df: DataFrame, column: str) -> tuple[float, float] | None:
    """Range of the values; a single value is widened by a half on both sides."""
    low, high = df.agg(F.min(number(column)), F.max(number(column))).first()
    if low is None:
        return None
    return (low - 0.5, high + 0.5) if low == high else (low, high)


def bin_number(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin from 0; the last bin also holds its right edge."""
    raw = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(float(bins)))
    return F.least(raw, F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 16) -> DataFrame:
    """Equal-width histogram with empty bins: bin, low, high, n."""
    edges = histogram_edges(df, column)
    schema_only = df.sparkSession.range(bins if edges else 0).select(F.col("id").cast("int").alias("bin"))
    low, high = edges or (0.0, 1.0)
    counted = (
        df.select(number(column).alias("v")).where(F.col("v").isNotNull())
        .groupBy(bin_number(F.col("v"), low, high, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (high - low) / bins
    return schema_only.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def histogram_labels(hist: DataFrame) -> DataFrame:
    """Add a ``low–high`` label in whole numbers."""
    def whole(name: str) -> Column:
        return F.round(F.col(name)).cast("bigint").cast("string")

    return hist.withColumn("label", F.concat(whole("low"), F.lit("–"), whole("high")))


def density2d(
    df: DataFrame, x: str, y: str, group: str, bins: int = 20, smooth: bool = False
) -> DataFrame:
    """Counts of (x, y) cells per group over a common range, optionally smoothed 3 x 3."""
    (xl, xh), (yl, yh) = (histogram_edges(df, c) or (0.0, 1.0) for c in (x, y))
    cells = (
        df.select(group, number(x).alias("__x"), number(y).alias("__y"))
        .where(F.col("__x").isNotNull() & F.col("__y").isNotNull())
        .groupBy(group, bin_number(F.col("__x"), xl, xh, bins).alias("x_bin"),
                 bin_number(F.col("__y"), yl, yh, bins).alias("y_bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not smooth:
        return cells
    kernel = F.array(*[
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(1.0 / ((1 + abs(dx)) * (1 + abs(dy)) * 4)).alias("w"))
        for dx in (-1, 0, 1) for dy in (-1, 0, 1)
    ])
    spread = cells.select(group, "x_bin", "y_bin", "n", F.inline(kernel))
    return (
        spread.groupBy(group, (F.col("x_bin") + F.col("dx")).alias("x_bin"), (F.col("y_bin") + F.col("dy")).alias("y_bin"))
        .agg(F.sum(F.col("n") * F.col("w")).alias("density"))
        .where(F.col("x_bin").between(0, bins - 1) & F.col("y_bin").between(0, bins - 1))
    )


def source_counts(
    df: DataFrame, source: str, composition: Sequence[str], low: float = 85.0, high: float = 115.0, real: str = "real"
) -> DataFrame:
    """Totals and band-valid rows of real and synthetic samples, and the size of the mix."""
    tagged = df.select((F.col(source) == real).alias("r"), row_sum(composition).between(low, high).alias("ok"))
    is_real = F.coalesce(F.col("r"), F.lit(False))
    return tagged.agg(
        F.count_if(is_real).alias("real_total"),
        F.count_if(is_real & F.col("ok")).alias("real_valid"),
        F.count_if(~is_real).alias("synthetic_total"),
        F.count_if(~is_real & F.col("ok")).alias("synthetic_valid"),
        F.count_if(F.col("ok")).alias("mix"),
    )
