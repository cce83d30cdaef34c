"""Embedding whitening by a two-pass covariance.

Components of the vectors become whole numbers, floor(SCALE * c) + SHIFT, and each distinct vector of them counts once: the
fit list, written to the shared folder. A first pass sums its columns exactly, which gives the mean without rounding. A
second takes n * x - S, still exact, divides once and sums the outer products of a task as one matrix product; the tasks'
matrices are merged by treeAggregate, so the driver gets one. LAPACK's symmetric solver gives eigenvalues and components,
the projection is broadcast, and a third pass measures the covariance of what it makes of the fit list. All that leaves
a task is a matrix or a row of sums; memory grows with the square of the vectors' length, never with their number.

Cases: rows whose vector is null or holds null or non-finite components go, as do components that have no long; vectors of
different lengths are fitted apart, each length with its own list; equal vectors under one or several ids are fitted once
and each row is returned; a null id is returned as null; vectors of fewer than 16 components have as many components as
they are long; a component without variance (one distinct vector, say) has a null whitened, and explained is null where
nothing varies; a deviation over the largest long is null; empty tables and empty vectors give no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
FITS = float(1 << 62)  # scaled components beyond it have no long
SURE = float(1 << 62)  # integer arithmetic that stays under it is done in 64 bits, and in Python's whole numbers beyond
NO_VARIANCE = 1e-13  # eigenvalues under so much of the largest are rounding


@dataclass
class Fit:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, largest first
    axes: np.ndarray  # unit eigenvectors as columns
    trace: float
    error: float = 0.0  # of the whitened covariance against the identity

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S without rounding."""
        if self.n * float(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) < SURE:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """NaN along components without variance."""
        root = np.sqrt(np.where(self.values > 0, self.values, np.nan))
        return self.centred(x) @ self.axes / root

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of squares of n * x - S; none where it has no long."""
        d = self.deviations(x)
        if (np.square(d.astype(float)).sum(axis=1) < SURE).all():
            return np.square(d.astype(np.int64)).sum(axis=1).tolist()
        exact = [sum(int(y) ** 2 for y in row) for row in d]
        return [y if y < 1 << 63 else None for y in exact]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def whole_numbers(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x) of the rows whose vector can be used."""
    rows = vectors.select(F.col(key).alias("id"), F.transform(vector, lambda c: c.cast("double")).alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) * SCALE < FITS))  # NaN is larger than any number
    return rows.filter(F.col("v").isNotNull() & good & (F.size("v") > 0)).select("id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT)).alias("x"))


def column_sums(fit_list: DataFrame, dim: int) -> tuple[int, list[int]]:
    """How many rows, and the exact sum of each column: halves of 32 bits are summed, so no sum leaves 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for b in batches:
            x = matrix(b.column(0), dim)
            n += len(x)
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + w for t, h, w in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array([*total, n], pa.decimal128(38, 0))], names=["k", "s"])

    sums = {r["k"]: int(r["s"]) for r in fit_list.mapInArrow(run, "k int, s decimal(38,0)").groupBy("k").agg(F.sum("s").alias("s")).collect()}
    return sums.get(dim, 0), [sums.get(k, 0) for k in range(dim)]


def moments(fit_list: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The summed outer products (size x size) of what of() makes of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            y = of(matrix(b.column(0), dim))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = fit_list.mapInArrow(run, "m binary").rdd.map(lambda r: np.frombuffer(r["m"]).reshape(size, size))
    return parts.treeAggregate(np.zeros((size, size)), lambda a, b: a + b, lambda a, b: a + b)


def fit(fit_list: DataFrame, dim: int, components: int = COMPONENTS) -> Fit:
    """The whitening of the distinct vectors (x) of one length."""
    n, sums = column_sums(fit_list, dim)
    k = min(components, dim)
    found = Fit(n, sums, np.zeros(k), np.eye(dim)[:, :k], 0.0)
    covariance = moments(fit_list, dim, found.centred, dim) / n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:k]
    found.values, found.axes, found.trace = np.where(values[order] > NO_VARIANCE * values.max(), values[order], 0), axes[:, order], float(np.trace(covariance))
    some = found.values > 0
    if some.any():
        measured = moments(fit_list, dim, lambda x: found.whitened(x)[:, some], int(some.sum())) / n
        found.error = float(np.abs(measured - np.eye(len(measured))).max())
    return found


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, key, vector)
    fit_list = stored(rows.select("x").distinct(), "whitening-fit")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = spark.createDataFrame([], schema)
    for dim in sorted(r["dim"] for r in fit_list.select(F.size("x").alias("dim")).distinct().collect()):  # lengths: one in most tables
        out = out.unionByName(_applied(rows.filter(F.size("x") == dim), spark.sparkContext.broadcast(fit(fit_list.filter(F.size("x") == dim), dim, components)), dim, schema))
    return out.withColumnRenamed("id", key)


def _applied(rows: DataFrame, shared, dim: int, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Fit = shared.value
        k = len(found.values)
        explained = pa.array(found.values / found.trace if found.trace > 0 else [None] * k, pa.float64())
        for b in batches:
            x = matrix(b.column("x"), dim)
            y = found.whitened(x).ravel()
            row, each = pa.array(np.repeat(np.arange(len(x)), k)), pa.array(np.tile(np.arange(k), len(x)))
            columns = [b.column("id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)))]
            columns += [pa.array(np.full(len(y), found.n)), pa.array(found.deviation(x), pa.int64()).take(row), pa.array(y, mask=np.isnan(y))]
            yield pa.RecordBatch.from_arrays([*columns, explained.take(each), pa.array(np.full(len(y), found.error))], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
