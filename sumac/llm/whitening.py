"""Whitening of embeddings: float32 eigenvectors of the distributed covariance, refined by Ogita-Aishima iterations."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ship
from .vectors import integer_vectors, matrix

SCALE, SHIFT = 64, 1_000_000
#: Eigenvalues below this share of the largest are zero: their components have no whitened values.
LEAST_SHARE = 1e-13
#: Refinement steps. Each squares the error of separated eigenvectors, so five or six are enough; a sub-solve may ask for more.
ROUNDS = 40

#: Eigenvalues must lie this many times farther apart than the error of a step before a step may turn their vectors; else its correction is
#: not small, and its square, which the step leaves as error, is not either.
SAFE = 64

#: Rows of a batch are multiplied in float64 while all products and sums of them stay below 2**53, that is, are exact.
EXACT = 1 << 53

ship(__name__)


def products(d: np.ndarray) -> np.ndarray:
    """The sum of the outer products of integer rows, as Python ints: exact at any size."""
    total = np.zeros((d.shape[1],) * 2, object)
    most = max(1, int(np.abs(d).max(initial=0)))
    step = EXACT // (most * most)
    if not step:  # entries beyond 2**26
        o = d.astype(object)
        return total + o.T @ o
    for start in range(0, len(d), step):
        f = d[start : start + step].astype(np.float64)
        total += (f.T @ f).astype(np.int64).astype(object)
    return total


def added(parts: DataFrame, k: int, n: int) -> np.ndarray:
    """Rows 0 to k of numbered parts (i, s: n + 1 numbers), those with one number added up."""
    total = parts.groupBy("i").agg(*[F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(n + 1)])
    out = np.zeros((k + 1, n + 1), object)
    for r in total.toLocalIterator():  # k + 1 rows
        out[r["i"]] = r[1:]
    return out


def sums(rows: DataFrame, n: int, centre: list[int], squares: bool) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, exact sums of x - centre by dimension, and of their outer products if asked for.

    A task gives a row of sums for each dimension, once, and Spark adds them up; the driver gets one number for each pair of dimensions.
    """
    c = np.array(centre, np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((n + 1 if squares else 1, n + 1), object)
        for b in batches:
            d = matrix(b.column(0), n) - c
            s[0, 0] += len(d)
            s[0, 1:] += d.sum(0, dtype=object) if np.abs(d).max(initial=0) >> 40 else d.sum(0).astype(object)
            if squares:
                s[1:, 1:] += products(d)
        numbers = pa.array([[Decimal(int(x)) for x in row] for row in s], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(s)), pa.int32()), numbers], names=["i", "s"])

    total = added(rows.select("x").mapInArrow(task, "i int, s array<decimal(38,0)>"), n if squares else 0, n)
    whole = np.array([[int(x) for x in row] for row in total], object)
    return whole[0, 0], whole[0, 1:].tolist(), whole[1:, 1:]


def groups_of(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Runs of the indices of rising values in which neighbours are no farther apart than width."""
    return np.split(np.arange(len(values)), np.flatnonzero(np.diff(values) > width) + 1)


def step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima step: better eigenvectors, their eigenvalues, the width below which two eigenvalues could not
    be told apart, and the size of the correction. Matrix products in the precision of a and x only."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # else what rounding leaves, divided by a small gap, would bend the vectors out of their right angles
    values = np.diag(s) / (1 - np.diag(r))
    width = SAFE * 2 * (np.linalg.norm((s - np.diag(values)).astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float)))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > width
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, values, width, float(np.abs(e).max(initial=0))


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors to double precision, a column each.

    Start: float32. Then Ogita-Aishima steps in long double. Where eigenvalues lie closer together than the width that a step can
    tell apart, its correction does not turn their vectors; so each such cluster is solved on its own: the matrix, shifted
    by the cluster's mean and projected on its vectors, is small, and float64 eigenvectors of it turn the cluster. Its shift keeps
    differences that float64 would lose against the eigenvalue itself. A cluster whose projection is as small as the rounding of
    long double is a multiple eigenvalue, of which any orthogonal vectors are right.
    """
    a = np.asarray(a, np.longdouble)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    tiny = len(a) * np.finfo(np.longdouble).eps
    least = np.inf
    for _ in range(ROUNDS):
        x, values, width, moved = step(a, x)
        order = np.argsort(values, kind="stable")
        x, values = x[:, order], values[order]
        turned = False
        for j in groups_of(values, width):
            if len(j) > 1:
                shift = values[j].mean()
                t = x[:, j].T @ (a @ x[:, j] - shift * x[:, j])
                t = (t + t.T) / 2
                off = np.abs(t - np.diag(np.diag(t))).max()
                if off > tiny:
                    x[:, j] = x[:, j] @ np.linalg.eigh((t / np.abs(t).max()).astype(np.float64))[1].astype(np.longdouble)
                    turned = True
        if moved > least / 2 and not turned or moved < tiny:  # no step moves less: what is left is rounding
            break
        least = min(least, moved)
    for _ in range(2):
        x = x @ (3 * np.eye(len(a), dtype=a.dtype) - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))
    lead = x[np.abs(x.astype(np.float64)).argmax(0), np.arange(len(a))]
    return (values[order] * scale).astype(np.float64), (x * np.where(lead < 0, -1, 1)).astype(np.float64)


class Model(NamedTuple):
    """n, centre + first / n is the mean (exact), components a column each, their eigenvalues and the trace."""

    n: int
    centre: list[int]
    first: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, d: np.ndarray) -> np.ndarray:
        """Whitened values of rows of x - centre."""
        return (d - np.array([f / self.n for f in self.first])) @ (self.components / np.sqrt(self.values))


def fit(distinct: DataFrame, n: int, most: int) -> Model | None:
    """Mean and leading components of the rows' covariance; None where nothing varies.

    Rows are centred at the whole number next to their mean before they are multiplied; products are summed as whole numbers, and the rest of the
    mean is taken off exactly. So the covariance does not depend on how rows are dealt, and its only rounding is the last division.
    """
    count, first, _ = sums(distinct, n, [SHIFT] * n, squares=False)
    if not count:
        return None
    centre = [SHIFT + round(f / count) for f in first]
    count, first, second = sums(distinct, n, centre, squares=True)
    v = np.empty((n, n), np.longdouble)
    for i in range(n):
        for j in range(n):
            v[i, j] = np.longdouble(count * second[i, j] - first[i] * first[j]) / np.longdouble(count) / np.longdouble(count)
    values, x = eigen(v)
    keep = min(most, int((values > LEAST_SHARE * max(values.max(initial=0), 0)).sum()))
    return Model(count, centre, first, x[:, :keep], values[:keep], float(np.trace(v))) if keep else None


def identity_error(distinct: DataFrame, n: int, model: Model) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity. Each task gives its sums once."""
    k = len(model.values)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = model.project(matrix(b.column(0), n) - np.array(model.centre, np.int64))
            first += w.sum(0)
            second += w.T @ w
        s = np.vstack([np.append(0.0, first), np.column_stack([np.zeros(k), second])])
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(s.tolist(), pa.list_(pa.float64()))], names=["i", "s"])

    total = added(distinct.select("x").mapInArrow(task, "i int, s array<double>"), k, k).astype(float) / model.n
    mean, cov = total[0, 1:], total[1:, 1:]
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())  # the rows are centred; mean holds what rounding left


def deviations(d: np.ndarray, model: Model) -> list[int | None]:
    """sum((n * x - S) ** 2) of each row, exact; null where it passes 64 bits."""
    most = int(np.abs(d).max(initial=0)) * model.n + max(map(abs, model.first))
    if most * most * d.shape[1] < 1 << 63:
        y = d * model.n - np.array(model.first, np.int64)
        return (y * y).sum(1).tolist()
    y = d.astype(object) * model.n - np.array(model.first, object)
    return [s if s < 1 << 63 else None for s in (y * y).sum(1)]


def whiten(vectors: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error for each row and component.

    Fitted on each distinct vector once; every row is whitened, copies and rows that share an id too. A null id stays null.
    Which vectors take part is said at integer_vectors. Components without variance are left out, so an empty table, a single vector and copies of one
    vector alone give no row. deviation is null where it passes 64 bits.
    """
    rows, n = integer_vectors(vectors, SCALE, SHIFT, id_col, vector_col)
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    model = None
    if n:
        distinct = cut(rows.select("x").distinct())
        model = fit(distinct, n, most)
    error = identity_error(distinct, n, model) if model else 0.0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = matrix(b.column(1), n) - np.array(model.centre, np.int64)
            w = model.project(d)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviations(d, model), pa.int64()), lists], names=["id", "deviation", "w"])

    found = rows.mapInArrow(task, schema) if model else rows.sparkSession.createDataFrame([], schema)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values]) if model else F.array().cast("array<double>")
    long = found.select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return long.select(
        "id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"),
    )
