"""Embedding whitening: streamed covariance, merged moments, symmetric QR, projection.

Each partition takes its vectors one by one into a count, a mean and a scatter matrix by Welford's
rank-one update; partitions' moments meet by the parallel update formula, some at a time. The
eigenvectors of the covariance come from a tridiagonal form and implicitly shifted QR steps. All is
done on whole numbers near a fixed origin, so that a large common offset costs no digits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import floored, lists, matrix, usual_length, whole

# An entry c becomes floor(SCALE * c) + ORIGIN.
SCALE, ORIGIN = 64, 1_000_000
#: Components that are returned at most.
COMPONENTS = 16
#: Entries are kept within this bound, so that sums of a few are exact as doubles.
BOUND = 1 << 52
#: Partitions' moments that meet in one task at most.
FAN = 32

_MOMENTS = "part long, n long, total array<long>, mean array<double>, scatter array<double>"


class Moments:
    """Count, exact sum, mean and scatter matrix of vectors."""

    def __init__(self, width: int):
        self.n, self.total, self.mean, self.scatter = 0, np.zeros(width, np.int64), np.zeros(width), np.zeros((width, width))
        self._product = np.empty((width, width))

    def add(self, row: np.ndarray) -> None:
        """Welford's update: the scatter grows by one matrix of rank one."""
        self.n += 1
        before = row - self.mean
        self.mean += before / self.n
        np.multiply(before[:, None], row - self.mean, out=self._product)
        self.scatter += self._product

    def merge(self, n: int, total: np.ndarray, mean: np.ndarray, scatter: np.ndarray) -> None:
        """The parallel update: both scatters and what the distance of the means adds."""
        if n:
            both, apart = self.n + n, mean - self.mean
            self.scatter += scatter + np.outer(apart, apart) * (self.n * n / both)
            self.mean += apart * (n / both)
            self.total += total
            self.n = both

    def batch(self, part: int) -> pa.RecordBatch:
        columns = [pa.array([part], pa.int64()), pa.array([self.n], pa.int64()), lists(self.total[None]), lists(self.mean[None]), lists(self.scatter.reshape(1, -1))]
        return pa.RecordBatch.from_arrays(columns, names=["part", "n", "total", "mean", "scatter"])


def _merged(rows, width: int) -> Moments:
    out = Moments(width)
    for n, total, mean, scatter in rows:
        out.merge(n, np.asarray(total, np.int64), np.asarray(mean), np.asarray(scatter).reshape(width, width))
    return out


def moments(vectors: DataFrame, width: int, prepare=lambda x: x) -> Moments:
    """The moments of ``vectors``'s only column, long arrays of ``width`` entries without nulls.

    ``prepare`` turns a matrix of them into the doubles that are counted. One row for each partition
    leaves the tasks; these meet by FAN until at most FAN are left, whatever their number. ``total`` is
    exact modulo 2**64.
    """

    def partition(batches):
        from pyspark import TaskContext

        own = Moments(width)
        for batch in batches:
            x = matrix(batch.column(0), width, np.int64)
            rows = prepare(x)
            if own.mean.size != rows.shape[1]:
                own = Moments(rows.shape[1])
            if rows.shape[1] == width:
                own.total += x.sum(axis=0)
            for row in rows:
                own.add(row)
        if own.n:
            yield own.batch(TaskContext.get().partitionId())

    def meet(key, table):
        rows = table.select(["n", "total", "mean", "scatter"]).to_pylist()
        some = _merged((r.values() for r in rows), len(rows[0]["mean"]))
        return pa.Table.from_batches([some.batch(key[0].as_py())])

    found = staged(vectors.mapInArrow(partition, _MOMENTS), "moments")
    while found.count() > FAN:
        found = staged(found.withColumn("some", F.expr(f"part div {FAN}")).groupBy("some").applyInArrow(meet, _MOMENTS), "moments")
    rows = found.orderBy("part").collect()
    return _merged([r[1:] for r in rows], len(rows[0]["mean"]) if rows else width)


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, side diagonal and orthogonal Q of a = Q T Q', by Householder reflections."""
    a, q = a.copy(), np.eye(len(a))
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if not length:
            continue
        turned = -np.copysign(length, v[0])
        v[0] -= turned
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = turned
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix.

    QR steps with Wilkinson's shift chase a bulge down the tridiagonal form; what falls below rounding
    is split off. Each vector's largest entry is made positive.
    """
    d, e, q = _tridiagonal(np.asarray(a, float))
    rows = np.ascontiguousarray(q.T)
    last = len(d) - 1
    while last > 0:
        e[np.abs(e) <= np.finfo(float).eps * (np.abs(d[:-1]) + np.abs(d[1:]))] = 0
        if e[last - 1] == 0:
            last -= 1
            continue
        first = last - 1
        while first > 0 and e[first - 1] != 0:
            first -= 1
        half, side = (d[last - 1] - d[last]) / 2, e[last - 1]
        shift = d[last] - side * side / (half + np.copysign(np.hypot(half, side), half))
        x, z = d[first] - shift, e[first]
        for k in range(first, last):
            r = np.hypot(x, z)
            c, s = (x / r, -z / r) if r else (1.0, 0.0)
            if k > first:
                e[k - 1] = r
            a_k, b_k, g_k = d[k], e[k], d[k + 1]
            d[k] = c * c * a_k - 2 * c * s * b_k + s * s * g_k
            d[k + 1] = s * s * a_k + 2 * c * s * b_k + c * c * g_k
            e[k] = c * s * (a_k - g_k) + (c * c - s * s) * b_k
            if k < last - 1:
                x, z = e[k], -s * e[k + 1]
                e[k + 1] *= c
            rows[k], rows[k + 1] = c * rows[k] - s * rows[k + 1], s * rows[k] + c * rows[k + 1]
    order = np.argsort(-d, kind="stable")
    rows = rows[order]
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)]) if len(rows) else np.zeros(0)
    return d[order], (rows * signs[:, None]).T


@dataclass(frozen=True)
class Whitening:
    """n, exact sums S, and for each component a column to project on and its share of the variance."""

    n: int
    total: np.ndarray
    columns: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """x - S/n on the components, each over the root of its eigenvalue."""
        return ((x - ORIGIN) - (self.total - self.n * ORIGIN) / self.n) @ self.columns

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sum of (n * x - S)**2 over the entries, exact; null (masked) where it exceeds a long."""
        with np.errstate(over="ignore"):
            apart = self.n * (x - ORIGIN) - (self.total - self.n * ORIGIN)
            exact = (apart * apart).sum(axis=1)
        rough = ((self.n * ((x - ORIGIN) - (self.total - self.n * ORIGIN) / self.n)) ** 2).sum(axis=1)
        return np.ma.masked_array(exact, rough > 9.2e18)


def fit(x: DataFrame, width: int, components: int = COMPONENTS) -> tuple[Whitening, float]:
    """The whitening of the rows of x (one column, whole-number vectors near ORIGIN), and its identity error.

    The covariance's divisor is the number of rows. A direction without variance gets a zero column:
    its whitened values are 0 and its explained share is 0. The identity error is the largest absolute
    entry of the whitened rows' covariance minus the identity, measured in a second pass.
    """
    some = moments(x, width, lambda block: (block - ORIGIN).astype(float))
    if not some.n:
        return Whitening(0, some.total, np.zeros((width, 0)), np.zeros(0)), 0.0
    values, vectors = symmetric_qr(some.scatter / some.n)
    held = np.where(values > max(values[0], 0) * width * np.finfo(float).eps, values, 0)[:components]
    scale = np.where(held > 0, 1 / np.sqrt(np.where(held > 0, held, 1)), 0)
    trace = np.trace(some.scatter) / some.n
    model = Whitening(some.n, some.total, vectors[:, : len(held)] * scale, held / trace if trace > 0 else held)
    shared = x.sparkSession.sparkContext.broadcast(model)
    again = moments(x, width, lambda block: shared.value.project(block))
    return model, float(np.abs(again.scatter / again.n - np.eye(len(held))).max(initial=0))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened ``embeddings`` (vec_id, embedding): vec_id, n, deviation, whitened, explained, identity_error.

    An entry c becomes x = floor(64 * c) + 1000000. The whitening is fitted to each distinct x vector
    once: n of them, with sums S. ``deviation`` is the exact sum of (n * x - S)**2, null where it exceeds
    a long. ``whitened`` and ``explained`` have an entry for each of the first ``components`` components.

    Rows whose vector is null, or holds null or non-finite entries, are left out; so are vectors of
    another length than the commonest (of several, the greatest), and empty ones. Entries beyond 2**52
    either way count as that. Repeated rows give repeated results, null vec_ids stay, further columns are
    ignored, and a table without vectors gives an empty result.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter(whole("v"))
    width = usual_length(rows, "v")
    rows = rows.filter((F.size("v") == width) & (F.size("v") > 0)).select("vec_id", F.transform(floored("v", SCALE, BOUND), lambda c: c + ORIGIN).alias("x"))
    # One vector may be a third of all rows: equal ones are dropped before the shuffle.
    distinct = staged(rows.select("x").distinct(), "distinct")
    model, error = fit(distinct, width, components)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        m = shared.value
        for batch in batches:
            x = matrix(batch.column(1), width, np.int64)
            deviation = m.deviation(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation.data, pa.int64(), mask=np.ma.getmaskarray(deviation)), lists(m.project(x))], names=["vec_id", "deviation", "whitened"])

    out = rows.mapInArrow(apply, "vec_id long, deviation long, whitened array<double>")
    return out.select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))
