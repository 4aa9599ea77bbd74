"""Whitening of embeddings: a distributed centred scatter, cyclic Jacobi rotations on the driver, one projection.

The driver holds a d x d matrix and never a row of the table.  Each task folds its rows into sums and a centred scatter
matrix, and Spark adds these up entry by entry.  Rotations go round robin: a sweep has rounds of disjoint pairs, each
round one vectorised step, until every off-diagonal entry is negligible beside its two diagonal entries, which is what
gives small eigenvalues their relative accuracy.

Defined results: a row whose vector is null or empty or holds a null, NaN or infinite entry is left out; where lengths differ, the
vectors of the commonest length stay (of equally common ones the shorter).  A null vec_id and repeated rows stay; repeated
vectors count once in the fit.  Entries beyond +-2**40 / 64 count as that bound.  A direction without variance (up to 1e-13 of the largest) is no component, so a
table of a single vector has none and gives no rows, as does an empty table.  Equal eigenvalues have some orthonormal basis, the same
for all rows.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import materialise, tidy, tune

#: Entries are counted in steps of 1 / STEPS and moved by OFFSET.
STEPS, OFFSET, LARGEST = 64, 1_000_000, 2.0**40
#: Eigenvalues up to this share of the largest are rounding.
NOTHING = 1e-13
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Model:
    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    trace: float
    weights: np.ndarray  # d x k: components divided by the roots of their eigenvalues
    identity_error: float = 0.0


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the entries as whole steps, of the rows that take part."""
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select("vec_id", "embedding").where(sound)
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("embedding") == (length[0]["d"] if length else 0))
    step = lambda e: F.floor(F.greatest(F.least(F.lit(float(STEPS)) * e.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(OFFSET).cast("long")
    return rows.select("vec_id", F.transform("embedding", step).alias("x"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n in double, whole parts first."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([(s % n) / n for s in sums])


def _totals(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each entry."""

    def run(batches):
        n, total = 0, None
        for batch in batches:
            if len(batch):
                part = _matrix(batch.column(0)).sum(axis=0).tolist()
                total = part if total is None else [a + b for a, b in zip(total, part)]
                n += len(batch)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["i", "n", "s"])

    rows = fit.select("x").mapInArrow(tidy(run), "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def _scatter(fit: DataFrame, project) -> np.ndarray:
    """Sum over the vectors of y y', y = project(x); a task sends its upper triangle, entries are added by Spark."""

    def run(batches):
        total = None
        for batch in batches:
            if len(batch):
                y = project(_matrix(batch.column(0)))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    rows = fit.select("x").mapInArrow(tidy(run), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    d = 1 + max((r["j"] for r in rows), default=-1)
    out = np.zeros((d, d))
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors in columns) of a symmetric positive semidefinite matrix."""
    d = len(matrix)
    a, v = np.array(matrix, float), np.eye(d)
    even = d + d % 2
    ring = list(range(1, even))
    floor = np.finfo(float).tiny
    for _ in range(sweeps):
        rotated = False
        for _ in range(even - 1):
            table = [0, *ring]
            pairs = [(min(x, y), max(x, y)) for x, y in zip(table[: even // 2], reversed(table[even // 2 :])) if max(x, y) < d]
            ring = ring[-1:] + ring[:-1]
            p, q = (np.array(side, int) for side in zip(*pairs)) if pairs else (np.zeros(0, int),) * 2
            off, low, high = a[p, q], a[p, p], a[q, q]
            turn = np.abs(off) > np.finfo(float).eps * np.sqrt(np.abs(low * high)) + floor
            if not turn.any():
                continue
            rotated = True
            p, q, off, low, high = p[turn], q[turn], off[turn], low[turn], high[turn]
            theta = (high - low) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            for m in (a, v):
                left, right = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            upper, lower = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * upper - s[:, None] * lower, s[:, None] * upper + c[:, None] * lower
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = low - t * off, high + t * off
        if not rotated:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


def fit(vectors: DataFrame, components: int = 16) -> tuple[DataFrame, Model | None]:
    """(rows that take part, as ``quantised``; their model, None without a component)."""
    tune(vectors.sparkSession)
    rows = materialise(quantised(vectors), "vectors")
    distinct = materialise(rows.select("x").distinct(), "distinct")
    n, sums = _totals(distinct)
    if not n:
        return rows, None
    covariance = _scatter(distinct, lambda x: _centred(x, n, sums)) / n
    values, axes = jacobi(covariance)
    k = min(components, int((values > NOTHING * max(values[0], 0)).sum()))
    if not k:
        return rows, None
    weights = axes[:, :k] / np.sqrt(values[:k])
    model = Model(n, sums, values[:k], float(np.trace(covariance)), weights)
    # whitened vectors have the mean 0: their scatter is their covariance
    model.identity_error = float(np.abs(_scatter(distinct, lambda x: _centred(x, n, sums) @ weights) / n - np.eye(k)).max())
    return rows, model


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the entries of (n x - S)^2; None where it passes 63 bits."""
    if n * float(np.abs(x).max(initial=0) + 1) * 2 < 2**62:
        y = x * n - np.array(sums, np.int64)
        if float(np.abs(y).max(initial=0)) ** 2 * x.shape[1] < 2**62:
            return (y * y).sum(axis=1).tolist()
    exact = [sum((n * e - s) ** 2 for e, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 2**63 else None for e in exact]


def whiten(rows: DataFrame, model: Model | None) -> DataFrame:
    """A row for each row of ``rows`` and component. Columns: ``RESULT``."""
    if model is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    m = model

    def run(batches):
        k = len(m.eigenvalues)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            each = np.repeat(np.arange(len(x)), k)
            whitened = _centred(x, m.n, m.sums) @ m.weights
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), m.n, np.int64)),
                    pa.array(_deviation(x, m.n, m.sums), pa.int64()).take(pa.array(each)), pa.array(whitened.ravel()), pa.array(np.tile(m.eigenvalues / m.trace, len(x))),
                    pa.array(np.full(len(each), m.identity_error)),
                ],
                [f.split()[0] for f in RESULT.split(", ")],
            )

    return rows.select("vec_id", "x").mapInArrow(tidy(run), RESULT)
