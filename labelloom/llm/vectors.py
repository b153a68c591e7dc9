"""Vectors of Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(positions, matrix of float64) of the vectors that are not null or empty and hold finite numbers alone; shorter
    vectors are padded with zeros."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good = (sizes > 0) & (np.bincount(owner[~np.isfinite(flat)], minlength=len(sizes)) == 0)
    kept, width = flat[good[owner]], int(sizes[good].max(initial=0))
    if (sizes[good] == width).all():
        return np.flatnonzero(good), kept.reshape(int(good.sum()), width)
    out = np.zeros((int(good.sum()), width))
    place = np.arange(len(kept)) - np.repeat(np.cumsum(sizes[good]) - sizes[good], sizes[good])
    out[np.repeat(np.arange(len(out)), sizes[good]), place] = kept
    return np.flatnonzero(good), out


def padded(matrix: np.ndarray, width: int) -> np.ndarray:
    """The matrix with zeros on the right up to ``width`` columns."""
    return matrix if matrix.shape[1] >= width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def embeddings(table: DataFrame, *columns: str) -> DataFrame:
    """vec_id, further columns as longs, and the vector; nothing else is read."""
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), *[F.col(c).cast("long").alias(c) for c in columns], F.col("embedding").cast("array<double>").alias("v"))
