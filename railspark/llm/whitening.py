"""Whitening of embeddings from a covariance found by polarisation (operator 13).

2 cov(i, j) = var(i + j) - var(i) - var(j): only squares of single dimensions and of sums of two
are ever added up, as exact integers, and the differences give every cross-covariance.

Entries are whole steps x = floor(scale * c).  With m = floor(S / n) per dimension and z = x - m,
sum (n x - S)^2 = n (n sum z^2 - R^2) where R = S - n m, so the sums stay small and exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship, written

#: Steps beyond this count as not finite, so that every sum fits 38 decimal digits.
LIMIT = 1 << 40
OUT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def matrix(batch: pa.RecordBatch, column: int, dims: int) -> np.ndarray:
    """The batch's vectors (all of ``dims`` entries) as rows of integers."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def usable(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """Rows with ``_x``, the vector in whole steps; null where the vector is no use.

    No use: null, empty, or with an entry that is null, not finite, or beyond ``LIMIT`` steps.
    """
    entries = F.col(vector).cast("array<double>")
    step = lambda c: F.floor(c * scale)
    fine = (F.size(entries) > 0) & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(LIMIT) / scale))
    return rows.withColumn("_x", F.when(F.coalesce(fine, F.lit(False)), F.transform(entries, step)))


def totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """n and the sum of every dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, object)
        for b in batches:
            x = matrix(b, 0, dims)
            n, sums = n + len(x), sums + x.sum(0).astype(object)  # a batch of steps below LIMIT cannot overflow
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([str(v) for v in (n, *sums)])], ["i", "s"])

    rows = fit.select("_x").mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    got = {r["i"]: int(r["s"]) for r in rows}
    return got.get(-1, 0), [got.get(i, 0) for i in range(dims)]


def squares(fit: DataFrame, middle: list[int]) -> dict[tuple[int, int], int]:
    """Exact sum of z_i^2 under (i, i) and of (z_i + z_j)^2 under (i, j), i < j; z = x - middle.

    Each task adds up its own rows; Spark adds the tasks' rows up by pair.  The driver gets one
    row per pair of dimensions, however many vectors there are.
    """
    dims = len(middle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = [np.zeros(dims - i, object) for i in range(dims)]
        for b in batches:
            x = matrix(b, 0, dims)
            for at in range(0, len(x), 256):
                z = x[at:at + 256] - np.array(middle)
                if np.abs(z).max(initial=0) >= 1 << 26:
                    z = z.astype(object)  # 256 squares of larger sums would pass 63 bits
                for i in range(dims):
                    pair = z[:, i:i + 1] + z[:, i:]
                    pair[:, 0] = z[:, i]
                    upper[i] = upper[i] + (pair * pair).sum(0).astype(object)
        keys = [(i, j) for i in range(dims) for j in range(i, dims)]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                                          pa.array([str(v) for row in upper for v in row])], ["i", "j", "s"])

    rows = fit.select("_x").mapInArrow(run, "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return {(r["i"], r["j"]): int(r["s"]) for r in rows.collect()}


def covariance(n: int, rest: list[int], sums: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariance matrix, divisor n, every entry the exact rational rounded once to double.

    ``rest``: S - n floor(S / n) of every dimension, the sum of its z.
    """
    def variance(square: int, total: int) -> int:  # n^2 times the variance
        return n * square - total * total

    dims = len(rest)
    out = np.empty((dims, dims))
    single = [variance(sums[i, i], rest[i]) for i in range(dims)]
    for i in range(dims):
        out[i, i] = float(Fraction(single[i], n * n))
        for j in range(i + 1, dims):
            both = variance(sums[i, j], rest[i] + rest[j])
            out[i, j] = out[j, i] = float(Fraction(both - single[i] - single[j], 2 * n * n))
    return out


class Whitener:
    """The fitted transformation: a few numbers per dimension and component."""

    def __init__(self, n: int, sums: list[int], middle: list[int], cov: np.ndarray, components: int):
        self.n, self.sums, self.middle = n, sums, np.array(middle)
        self.rest = [s - n * m for s, m in zip(sums, middle)]
        values, vectors = np.linalg.eigh(cov)
        pick = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = values[pick], vectors[:, pick]
        trace = float(np.trace(cov))
        # directions without spread (up to rounding) have no whitened value
        self.live = self.values > max(trace, 0.0) * len(cov) * np.finfo(float).eps
        self.explained = [float(v) / trace if trace > 0 else None for v in self.values]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Rows x components: (x - S/n) on each unit component over the root of its eigenvalue."""
        centred = (x - self.middle) - np.array([r / self.n for r in self.rest])
        return centred @ self.vectors / np.sqrt(np.where(self.live, self.values, np.nan))

    def deviation(self, x: np.ndarray) -> list[int]:
        """sum over dimensions of (n x - S)^2, exactly."""
        z = x - self.middle
        if np.abs(z).max(initial=0) * self.n * max(1, len(self.sums)) >= 1 << 62 or np.abs(z).max(initial=0) >= 1 << 26:
            z = z.astype(object)
        a, b = (z * z).sum(1), (z * np.array(self.rest)).sum(1)
        c = sum(r * r for r in self.rest)
        return [self.n * self.n * int(p) - 2 * self.n * int(q) + c for p, q in zip(a, b)]


def identity_error(fit: DataFrame, model: Whitener, dims: int) -> float | None:
    """Largest absolute entry of (covariance of the whitened fit list - identity)."""
    live = np.flatnonzero(model.live)
    if not len(live):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(live), len(live)))
        for b in batches:
            w = model(matrix(b, 0, dims))[:, live]  # centred already: its mean is nil
            total += w.T @ w
        keys = [(i, j) for i in range(len(live)) for j in range(len(live))]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                                          pa.array(total.ravel())], ["i", "j", "s"])

    rows = fit.select("_x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max(abs(r["s"] / model.n - (r["i"] == r["j"])) for r in rows)


def whiten(rows: DataFrame, components: int = 4, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row per vector and component.

    The fit uses each distinct step vector once; all usable rows are transformed, repeated ones
    and null ids too.  Rows whose vector is null, empty, or holds a null or non-finite entry (or
    one of 2^40 steps or more) are left out; so are rows of another length than most usable rows
    have (ties: the longest).  A component without spread has a null ``whitened``; without any
    spread ``explained`` and ``identity_error`` are null; fewer dimensions give fewer components;
    an empty table gives an empty table.  ``deviation`` is a decimal of 38 digits; other columns
    are not read.  Many copies of a vector are reduced in each task before the shuffle.
    """
    spark = rows.sparkSession
    ship(spark)
    steps = written(usable(rows.select(rows[vec_id].alias("_id"), rows[vector].alias("_v")), "_v", scale).filter("_x is not null").select("_id", "_x"))
    lengths = steps.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    dims = lengths["d"] if lengths else 1
    steps = steps.filter(F.size("_x") == dims)
    kind = rows.schema[vec_id].dataType
    if not lengths:
        return spark.createDataFrame([], f"{vec_id} {kind.simpleString()}, {OUT}")
    fit = written(steps.select("_x").distinct())
    n, sums = totals(fit, dims)
    middle = [s // n for s in sums]
    model = Whitener(n, sums, middle, covariance(n, [s - n * m for s, m in zip(sums, middle)], squares(fit, middle)), components)
    error = identity_error(fit, model, dims)
    count = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b, 1, dims)
            white = model(x)
            times = len(x) * count
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(np.arange(len(x)), count))),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(times, n, np.int64)),
                pa.array([str(v) for v in model.deviation(x) for _ in range(count)]),
                pa.array(white.ravel(), mask=np.isnan(white.ravel())), pa.array(model.explained * len(x), pa.float64()),
                pa.array([error] * times, pa.float64())],
                [vec_id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = steps.mapInArrow(run, f"`{vec_id}` {kind.simpleString()}, component int, n long, deviation string, whitened double, explained double, identity_error double")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
