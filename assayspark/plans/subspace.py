"""Leading subspace of a tall table of vectors, from small matrices per task.

With W an orthonormal d x l matrix that travels to the tasks, one pass gives either the product of the
scatter matrix with W (d x l; block power iteration) or the triangular factor of the tall matrix X W
(l x l; every task factors its rows and the factors are stacked and factored again). Nothing of size d x d
is made, and no row leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 16


def complete_vectors(df: DataFrame, vectors: str) -> DataFrame:
    """The vectors as doubles; rows without one, or with a gap in it, go."""
    v = F.col(vectors).cast("array<double>")
    return df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column; all must have d numbers."""
    if not (np.diff(column.offsets.to_numpy()) == d).all():
        raise ValueError(f"vectors of different lengths, {d} expected")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _reduced(rows: DataFrame, combine: Callable[[list[np.ndarray]], np.ndarray]) -> dict[int, np.ndarray]:
    """(part, data) rows of all tasks put together per part, then collected: one row per part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(data)
                have[part] = combine([have[part], new]) if part in have else new
        yield pa.record_batch({"part": pa.array(list(have), pa.int32()), "data": pa.array([v.tobytes() for v in have.values()], pa.binary())})

    return {r["part"]: np.frombuffer(r["data"]) for r in rows.repartition(FAN, "part").mapInArrow(run, "part int, data binary").collect()}


def _summed(df: DataFrame, start: np.ndarray, step: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """Sum over all rows of a matrix of the shape of ``start``, worked out per batch and shuffled row by row."""
    shape = start.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += step(matrix(batch.column(0), d))
        yield pa.record_batch({"part": pa.array(range(shape[0]), pa.int32()), "data": pa.array([row.tobytes() for row in total], pa.binary())})

    found = _reduced(df.mapInArrow(run, "part int, data binary"), lambda x: x[0] + x[1])
    return np.stack([found[i] for i in range(shape[0])]) if found else np.zeros(shape)


def moments(df: DataFrame, d: int) -> tuple[int, np.ndarray, float]:
    """Number of rows, their mean, and the sum of squared distances from it."""
    first = df.first()
    origin = np.array(first["v"])

    def step(x: np.ndarray) -> np.ndarray:
        z = x - origin
        return np.stack([np.full(d, len(z), dtype=float), z.sum(axis=0), (z * z).sum(axis=0)])

    n, s, q = _summed(df, np.zeros((3, d)), step, d)
    return int(n[0]), origin + s / n[0], float((q - s * s / n[0]).sum())


def scatter_times(df: DataFrame, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """(X - mean)' (X - mean) W."""
    def step(x: np.ndarray) -> np.ndarray:
        z = x - mean
        return z.T @ (z @ basis)

    return _summed(df, basis, step, len(mean))


def tall_factor(df: DataFrame, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Triangular R of the tall matrix (X - mean) W."""
    d, size = basis.shape

    def triangle(parts: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.concatenate([p.reshape(-1, size) for p in parts]), mode="r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros((0, size))
        for batch in batches:
            if batch.num_rows:
                have = triangle([have, (matrix(batch.column(0), d) - mean) @ basis])
        yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId() % FAN], pa.int32()), "data": pa.array([have.tobytes()], pa.binary())})

    parts = _reduced(df.mapInArrow(run, "part int, data binary"), lambda x: triangle(x).ravel())
    return triangle(list(parts.values()))
