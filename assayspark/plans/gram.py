"""Cross-product sums of wide numeric columns, one small matrix per task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped_gram(
    df: DataFrame, columns: Sequence[str], group: str, shift: Sequence[float] | None = None
) -> dict[int, np.ndarray]:
    """Per integer group the matrix Z'Z of Z = [1, columns - shift]; rows must be complete.

    Every task adds up its own rows, so only (groups x d x d) numbers per task are shuffled.
    """
    d = len(columns) + 1
    origin = np.zeros(d - 1) if shift is None else np.asarray(shift, dtype=float)

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for g, part in pdf.groupby("__g", sort=False):
                z = np.column_stack([np.ones(len(part)), part[list(columns)].to_numpy(float) - origin])
                sums[int(g)] = sums.get(int(g), 0.0) + z.T @ z
        for g, m in sums.items():
            yield pd.DataFrame({"g": g, "cell": np.arange(d * d), "v": m.ravel()})

    rows = (
        df.select(F.col(group).cast("int").alias("__g"), *columns)
        .mapInPandas(partials, "g int, cell int, v double")
        .groupBy("g", "cell").agg(F.sum("v").alias("v"))
        .collect()
    )
    result: dict[int, np.ndarray] = {}
    for g, cell, v in rows:
        result.setdefault(g, np.zeros(d * d))[cell] = v
    return {g: m.reshape(d, d) for g, m in result.items()}


def pairwise_moments(df: DataFrame, columns: Sequence[str], shift: Sequence[float]) -> DataFrame:
    """Per column pair (i < j) the moments over the rows where both are present."""
    k = len(columns)
    origin = np.asarray(shift, dtype=float)
    upper_i, upper_j = np.triu_indices(k, 1)

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sx, sxx, sxy = (np.zeros((k, k)) for _ in range(4))
        for pdf in batches:
            x = pdf.to_numpy(float) - origin
            there = ~np.isnan(x)
            mask = there.astype(float)
            z = np.where(there, x, 0.0)
            n += mask.T @ mask
            sx += z.T @ mask
            sxx += (z * z).T @ mask
            sxy += z.T @ z
        pick = (upper_i, upper_j)
        flip = (upper_j, upper_i)
        yield pd.DataFrame({
            "i": upper_i, "j": upper_j, "n": n[pick], "sx": sx[pick], "sy": sx[flip],
            "sxx": sxx[pick], "syy": sxx[flip], "sxy": sxy[pick],
        })

    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    return (
        df.select(*columns)
        .mapInPandas(partials, "i int, j int, " + ", ".join(f"{c} double" for c in names))
        .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    )
