"""Whitening of embeddings by a tall-skinny QR.

Rows are centred by exact integer sums, every partition reduces its rows to an R factor, and factors are merged in a
tree. The right singular vectors of the last R are the principal directions, and its singular values give the
eigenvalues: the covariance itself is never formed, so its condition is not squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import cut
from labelloom.llm.vectors import embeddings, padded, usable

FAN_IN = 16  # factors that one task merges
LEAST = 1e-13  # a singular value below this share of the largest is no direction: the rows do not vary there


def integers(values: np.ndarray, scale: int, offset: int) -> np.ndarray:
    return np.floor(scale * values).astype(np.int64) + offset


def _batches(batches: Iterator[pa.RecordBatch], width: int, scale: int, offset: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integers) of the usable rows."""
    for batch in batches:
        at, values = usable(batch.column(1))
        if len(at):
            yield batch.column(0).take(pa.array(at)), integers(padded(values, width), scale, offset)


def exact_sums(rows: DataFrame, scale: int, offset: int) -> tuple[int, np.ndarray]:
    """Number of usable rows and the sums of their integers, dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1, dtype=np.int64)  # rows, then sums without the offset, which shorter vectors need too
        for _, x in _batches(batches, 0, scale, 0):
            sums = np.pad(sums, (0, max(0, x.shape[1] + 1 - len(sums))))
            sums[0] += len(x)
            sums[1 : x.shape[1] + 1] += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["place", "value"])

    total = rows.mapInArrow(run, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place")
    values = [r["value"] for r in total.collect()] or [0]  # one more than dimensions
    return values[0], np.array(values[1:], dtype=np.int64) + offset * values[0]


def _r(stack: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stack, mode="r")


def _as_row(number: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], ["part", "r"])


def r_factor(rows: DataFrame, n: int, sums: np.ndarray, scale: int, offset: int, fan_in: int = FAN_IN) -> np.ndarray:
    """The R factor of all centred rows: one for each partition, then merged ``fan_in`` at a time."""
    width = len(sums)

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, width))
        for _, x in _batches(batches, width, scale, offset):
            r = _r(np.concatenate([r, (n * x - sums) / n]))
        if len(r):
            yield _as_row(TaskContext.get().partitionId(), r)

    def merged(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        factors = [np.frombuffer(x.as_py(), dtype="<f8").reshape(-1, width) for x in table.column("r")]
        return pa.Table.from_batches([_as_row(table.column("group")[0].as_py(), _r(np.concatenate(factors)))])

    factors = cut(rows.mapInArrow(of_rows, "part long, r binary"), "factors")
    last = factors.agg(F.max("part")).first()[0]
    while last:
        grouped = factors.withColumn("group", F.floor(F.col("part") / fan_in).cast("long"))
        factors, last = grouped.groupBy("group").applyInArrow(merged, "part long, r binary"), last // fan_in
    return np.frombuffer(factors.first()["r"], dtype="<f8").reshape(-1, width)


def principal(r: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(directions as rows, eigenvalues, trace) of the covariance with divisor n; at most ``k``, by falling eigenvalue."""
    _, singular, directions = np.linalg.svd(r, full_matrices=r.shape[0] < r.shape[1])
    singular = np.pad(singular, (0, r.shape[1] - len(singular)))
    singular[singular <= LEAST * singular.max(initial=0)] = 0.0
    values = singular**2 / n
    return directions[:k], values[:k], float(values.sum())


def _moments(rows: DataFrame, project, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, scatter around it) of projected rows: each task centres its own, and a few numbers a task are merged."""

    def joined(a, b):
        if a is None or not b[0]:
            return a or b
        n, shift = a[0] + b[0], b[1] - a[1]
        return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for white in project(batches):
            mean = white.mean(axis=0)
            held = joined(held, (len(white), mean, (white - mean).T @ (white - mean)))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1].tolist()]), pa.array([held[2].ravel().tolist()])], ["n", "mean", "scatter"])

    def merged(table: pa.Table) -> pa.Table:
        held = None
        for n, mean, scatter in zip(*[c.to_pylist() for c in table.columns[-3:]], strict=True):
            held = joined(held, (n, np.array(mean), np.array(scatter).reshape(k, k)))
        return pa.table({"n": [held[0]], "mean": [held[1].tolist()], "scatter": [held[2].ravel().tolist()]})

    schema = "n long, mean array<double>, scatter array<double>"
    parts = rows.mapInArrow(run, schema)
    for by in (F.pmod(F.xxhash64("scatter"), F.lit(64)), F.lit(0)):
        parts = parts.select(by.alias("group"), "n", "mean", "scatter").groupBy("group").applyInArrow(merged, schema)
    n, mean, scatter = parts.first()
    return n, np.array(mean), np.array(scatter).reshape(k, k)


def whitened(table: DataFrame, k: int = 8, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and each of the first
    ``k`` components (of all, if there are fewer).

    table: (vec_id, embedding), of which other columns are ignored. A component c becomes floor(scale * c) + offset, which
    must stay below 2^53. Covariances have the divisor n and cover all usable rows; components are numbered from 1 by
    falling eigenvalue. deviation is a decimal: the sum over dimensions of (n * x - sum)^2, exact. identity_error is the
    largest absolute entry of the whitened rows' measured covariance minus the identity.

    Rows whose vector is null, empty, or holds a null or non-finite entry are left out; shorter vectors count as padded
    with zeros. A null vec_id stays and repeated rows stay, and both count. Where the rows do not vary in a component
    (a single row, equal rows), whitened is null, explained is 0 (null if they vary in none) and identity_error leaves it
    out. An empty table gives an empty result.
    """
    spark, rows = table.sparkSession, embeddings(table)
    n, sums = exact_sums(rows, scale, offset)
    if not n:
        return spark.createDataFrame([], RESULT)
    width = len(sums)
    directions, values, trace = principal(r_factor(rows, n, sums, scale, offset), n, k)
    k, varying = len(directions), int((values > 0).sum())
    weights = directions[:varying] / np.sqrt(values[:varying])[:, None]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for ids, x in _batches(batches, width, scale, offset):
            away = n * x - sums
            yield ids, away, (away / n) @ weights.T

    error = None
    if varying:
        _, _, scatter = _moments(rows, lambda batches: (white for _, _, white in projected(batches)), varying)
        error = float(np.abs(scatter / n - np.eye(varying)).max())
    explained = [float(v / trace) if trace else None for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, away, white in projected(batches):
            if np.abs(away).max().astype(float) ** 2 * width < 2**62:
                deviation = pa.array((away * away).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([sum(int(v) ** 2 for v in line) for line in away], pa.decimal128(38, 0))
            m = len(ids)
            flat = np.full((m, k), np.nan)
            flat[:, :varying] = white
            columns = [
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(flat.ravel(), from_pandas=True), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(m), k))), *columns], NAMES)

    return rows.mapInArrow(run, RESULT)


RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
