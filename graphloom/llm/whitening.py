"""Whitening of embeddings by a one-sided Jacobi SVD of what blockwise TSQR leaves.

Vectors are taken in fixed point, ``floor(1024 * c) + 100000``, so that sums are
whole numbers and means the same in any order.  Each task reduces its centred
rows block by block to one triangular R, and Rs are stacked and reduced again,
``FAN`` at a time, until one is left, whose size is that of a vector squared
whatever the number of rows.  Plane rotations then make R's columns orthogonal:
their norms are the standard deviations, to full relative accuracy since no
product of R with itself is made, and the accumulated rotations the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, arrow_map, materialise

COMPONENTS = 8
#: Rs that one task stacks, and entries of a block of rows that a task reduces at once.
FAN, BLOCK_ENTRIES = 16, 1 << 18
SCALE, SHIFT = 1024, 100_000
#: Entries from which fixed point is no longer exact in a double.
LIMIT = float(1 << 42)
_HALF = 26


@dataclass
class Whitening:
    """What was fitted: rows, exact sums, unit components as rows, and each one's eigenvalue and share of the variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers less the mean."""
        whole, rest = np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.variances)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per row, the exact sum over dimensions of (n * x - S) ** 2; None where it is no long."""
        whole, rest = np.array([s // self.n for s in self.sums], np.int64), [s % self.n for s in self.sums]
        y = x - whole
        most = (float(np.abs(y).max(initial=0)) + 1) * self.n
        if most * most * max(1, x.shape[1]) < 2.0**62:
            return ((y * self.n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((v * self.n - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def usable(vector: Column) -> Column:
    """Whether a vector is there, and its entries are numbers that fixed point can hold."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LIMIT, F.lit(False))), F.lit(False))


def fixed_point(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    step = max(1, BLOCK_ENTRIES // size)
    for batch in batches:
        x = _matrix(batch.column("x"), size)
        for at in range(0, len(x), step):
            yield x[at : at + step]


def _sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """Rows and exact sums: each task gives one row for a dimension, of high and low parts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
        for x in _blocks(batches, size):
            high += (x >> _HALF).sum(axis=0)
            low += (x & ((1 << _HALF) - 1)).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(high), pa.array(low), pa.array(np.full(size, n))], names=["k", "high", "low", "n"])

    parts = arrow_map(rows.select("x"), add, "k long, high long, low long, n long")
    found = parts.groupBy("k").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]).collect()  # a row for each dimension
    by = {r.k: r for r in found}
    return int(by[0].n), [(int(by[k].high) << _HALF) + int(by[k].low) for k in range(size)]


def triangle(rows: DataFrame, size: int, n: int, sums: list[int]) -> np.ndarray:
    """R of all centred rows."""
    empty = Whitening(n, sums, np.zeros((0, size)), np.zeros(0), np.zeros(0))

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for x in _blocks(batches, size):
            r = np.linalg.qr(np.vstack([r, empty.centred(x)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.reshape(-1)], pa.list_(pa.float64()))], names=["part", "r"])

    def stack(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("part").to_numpy())
        r = np.zeros((0, size))
        for k in order.tolist():
            r = np.linalg.qr(np.vstack([r, np.array(group.column("r")[k].as_py()).reshape(-1, size)]), mode="r")
        return pa.table({"part": pa.array([int(group.column("part")[0].as_py()) // FAN], pa.int64()), "r": pa.array([r.reshape(-1)], pa.list_(pa.float64()))})

    left = materialise(arrow_map(rows.select("x"), reduce_, "part long, r array<double>"))
    last = left.agg(F.max("part")).first()[0]
    while last:
        left, last = left.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(stack, "part long, r array<double>"), last // FAN
    return np.array(left.first().r).reshape(-1, size)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of ``r``, falling, and its right singular vectors as rows, by rotating pairs of columns until all are orthogonal.

    The pairs of a step have no column in common (a tournament's rounds), so
    they turn at once.  A column that is nothing but rounding stays as it is.
    """
    size = r.shape[1]
    a, v = np.ascontiguousarray(r.T, dtype=np.float64), np.eye(size)
    if size % 2:  # a player without a game
        a, v = np.vstack([a, np.zeros((1, a.shape[1]))]), np.vstack([v, np.zeros((1, size))])
    order, half = np.arange(len(a)), len(a) // 2
    small = max(r.shape) * np.finfo(float).eps
    nothing = (small * np.linalg.norm(r)) ** 2
    turned = size > 1
    while turned:
        turned = False
        for _ in range(len(a) - 1):
            p, q = order[:half], order[::-1][:half]
            x, y = a[p], a[q]
            xx, yy, xy = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
            rows = np.flatnonzero((np.abs(xy) > small * np.sqrt(xx) * np.sqrt(yy)) & (np.minimum(xx, yy) > nothing))
            if len(rows):
                turned = True
                p, q, x, y = p[rows], q[rows], x[rows], y[rows]
                zeta = (yy[rows] - xx[rows]) / (2 * xy[rows])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = (1 / np.hypot(1.0, t))[:, None]
                s = c * t[:, None]
                a[p], a[q] = c * x - s * y, s * x + c * y
                x, y = v[p], v[q]
                v[p], v[q] = c * x - s * y, s * x + c * y
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
    a, v = a[:size], v[:size]
    norms = np.sqrt((a * a).sum(axis=1))
    by = np.argsort(-norms, kind="stable")
    return norms[by], v[by]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The model of ``rows(x)``, all of one length; None if there are none."""
    size = rows.select(F.max(F.size("x"))).first()[0]
    if not size:
        return None
    n, sums = _sums(rows, size)
    r = triangle(rows, size, n, sums)
    deviation, axes = jacobi(r)
    # Directions without variance, but for rounding, have no whitened values.
    k = min(components, int((deviation > 16 * max(r.shape) * np.finfo(float).eps * deviation[0]).sum()))
    axes = axes[:k] * np.where(np.take_along_axis(axes[:k], np.abs(axes[:k]).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0)
    total = float((deviation**2).sum())
    return Whitening(n, sums, axes, deviation[:k] ** 2 / n, deviation[:k] ** 2 / total if total else np.zeros(0))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""
    k, size = len(model.variances), len(model.sums)
    first, second = np.triu_indices(k)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, product = np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches, size):
            z = model.whitened(x)
            mean += z.sum(axis=0)
            product += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.append(first, np.full(k, -1))), pa.array(np.append(second, np.arange(k))), pa.array(np.append(product[first, second], mean))], names=["i", "j", "v"])

    found = arrow_map(rows.select("x"), add, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # of k components
    of = {(r.i, r.j): r.v / model.n for r in found}
    return max(abs(of[i, j] - of[-1, i] * of[-1, j] - (i == j)) for i, j in zip(first.tolist(), second.tolist(), strict=True))


def whiten(embeddings: DataFrame, carry: list[str], vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The columns ``carry`` of each vector, once for each of its first components: ``component`` (from 1 by falling variance), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows are left out whose vector is null, holds a null, a NaN, an infinity or
    an entry from 2**42 on, or has not the length that most others have (of
    equally frequent lengths the larger): those cannot be on one fit list.  All
    others are fitted and returned, repeated ones each time, whatever their ids.
    Directions without variance are no components, so equal vectors, vectors
    without entries and an empty table give an empty result.  A component's
    entry of largest magnitude is positive.  ``deviation`` is null where it does
    not fit a long.  Rows come from a written copy in fixed point.
    """
    kinds = dict(embeddings.dtypes)
    names = [f"c{k}" for k in range(len(carry))]
    vector = F.col("v")
    rows = embeddings.select(*[embeddings[c].alias(k) for c, k in zip(carry, names, strict=True)], embeddings[vector_col].alias("v"))
    rows = materialise(rows.filter(usable(vector)).select(*names, fixed_point(vector).alias("x")))
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.filter(F.size("x") == (lengths.size if lengths else -1))
    model = fit(rows, components)
    k, size = (len(model.variances), len(model.sums)) if model else (0, 0)
    error = identity_error(rows, model) if k else 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_ENTRIES // max(1, size))
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, step):
                part = batch.slice(at, step)
                x = _matrix(part.column("x"), size)
                m = len(x)
                take = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(take),
                    pa.array(model.whitened(x).reshape(-1)),
                    pa.array(np.tile(model.explained, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays([part.column(c).take(take) for c in names] + columns, names=[*names, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    arrow_limits(embeddings.sparkSession)
    fields = [f"{k} {kinds[c]}" for c, k in zip(carry, names, strict=True)]
    out = arrow_map(rows, project, ", ".join([*fields, "component int, n long, deviation long, whitened double, explained double, identity_error double"]))
    return out.toDF(*carry, "component", "n", "deviation", "whitened", "explained", "identity_error")
