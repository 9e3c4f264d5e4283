"""Whitening of embeddings by a pivoted Cholesky factor of their scatter and one-sided Jacobi rotations of it.

Tasks add up what is needed: first the count and the sums, which are whole numbers and exact; then, each vector being
centred before it is multiplied, the products of its dimensions. What reaches the driver has the size of dimensions
squared, however many vectors there are. There the scatter is factored, scatter = L Lt with the largest remaining
diagonal first, and the columns of L are rotated until they are orthogonal: their squared norms are the eigenvalues,
the normalised columns the components. The scatter is never multiplied by itself and no eigenvalue routine is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SCALE, SHIFT = 1024.0, 100_000
EXACT = 2.0**52  # an entry that reaches this after scaling has no exact place among the whole numbers
MOST_DIMENSIONS = 2048  # the driver holds some matrices of dimensions squared
SWEEPS = 60
TINY = 1e-14  # a remaining diagonal or an eigenvalue of this share of the largest is rounding


def grid(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) rows whose vector is whole and finite and not beyond what whole numbers hold exactly."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= EXACT / SCALE))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)


def matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            yield batch.column("vec_id"), grid(values.reshape(-1, dims))


def cholesky(scatter: np.ndarray) -> np.ndarray:
    """L, lower triangular up to the order of its rows, with scatter = L Lt; as many columns as the rank."""
    d = len(scatter)
    rest, out = scatter.astype(float).copy(), []
    largest = max(float(np.diag(rest).max()), 0.0) if d else 0.0
    done = np.zeros(d, bool)
    for _ in range(d):
        diagonal = np.where(done, -1.0, np.diag(rest))
        p = int(diagonal.argmax())
        if diagonal[p] <= largest * TINY:
            break
        column = np.where(done, 0.0, rest[:, p] / np.sqrt(rest[p, p]))
        rest -= np.outer(column, column)
        done[p] = True
        out.append(column)
    return np.array(out).T.reshape(d, len(out))


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns in rounds of pairs that share none."""
    ring = list(range(n + n % 2))
    out = []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :]), strict=True) if max(a, b) < n]
        out.append((np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of factor factor-t, falling, and the components as columns."""
    w = factor.copy()
    pairs = rounds(w.shape[1])
    for _ in range(SWEEPS):
        off = 0.0
        for i, j in pairs:
            if not len(i):
                continue
            a, b = w[:, i], w[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            size = np.sqrt(aa * bb)
            apart = np.divide(np.abs(ab), size, out=np.zeros_like(ab), where=size > 0)
            off = max(off, float(apart.max()))
            turn = apart > 1e-16
            zeta = np.divide(bb - aa, 2 * ab, out=np.zeros_like(ab), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            w[:, i], w[:, j] = c * (a - t * b), c * (t * a + b)
        if off <= 1e-15:
            break
    else:
        if off > 1e-10:
            raise ArithmeticError(f"rotations did not end, {off} is left")
    values = (w * w).sum(0)
    order = np.argsort(-values, kind="stable")
    values, w = values[order], w[:, order]
    return values, w / np.sqrt(values)


def added(rows: DataFrame, parts, size: int) -> np.ndarray:
    """The sum over tasks of ``size`` numbers that ``parts(batches)`` makes of each task's rows, added up in Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = parts(batches)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "part"])

    out = np.zeros(size)
    for row in rows.mapInArrow(partial, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect():
        out[row["at"]] = row["part"]
    return out


class Fit:
    """Count, exact sums, eigenvalues and components of a table's vectors."""

    def __init__(self, rows: DataFrame, n: int, dims: int):
        self.n, self.dims = n, dims
        self.sums = [0] * dims

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [0] * dims
            for _, x in matrices(batches, dims):
                total = [a + b for a, b in zip(total, x.sum(0).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total])], names=["at", "part"])

        told = rows.mapInArrow(sums, "at int, part string").groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
        for row in told.collect():
            self.sums[row["at"]] = int(row["part"])
        sums_now = self.sums

        def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            total = None
            for _, x in matrices(batches, dims):
                c = centred(x, n, sums_now)
                total = c.T @ c if total is None else total + c.T @ c
            return None if total is None else total[np.triu_indices(dims)]

        scatter = np.zeros((dims, dims))
        scatter[np.triu_indices(dims)] = added(rows, products, dims * (dims + 1) // 2)
        scatter = np.triu(scatter) + np.triu(scatter, 1).T
        self.trace = float(np.trace(scatter)) / n
        values, parts = jacobi(cholesky(scatter))
        real = values > (values[0] if len(values) else 0.0) * TINY
        self.values, self.parts = values[real] / n, parts[:, real]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, from whole numbers as far as they are exact: S is split into n times a whole number and a remainder."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sums over dimensions of (n x - S)^2, exact."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    apart = x - whole
    most = (int(np.abs(apart).max()) + 1) * n
    if most * most * len(sums) < 1 << 62:
        return ((n * apart - rest) ** 2).sum(1).tolist()
    return [sum((n * a - r) ** 2 for a, r in zip(row, rest.tolist(), strict=True)) for row in apart.tolist()]


OUT = ("vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")


def whitened(vectors: DataFrame, components: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``OUT`` rows: each vector on each of the first ``components`` components, over the root of the eigenvalue.

    An entry c becomes floor(1024 c) + 100000. Left out are rows whose vector is NULL, empty, holds a NULL or
    non-finite entry or one beyond ``EXACT``, or has not the commonest number of dimensions (the larger of equally
    common ones). Components of no variance are left out: alike vectors, or a single one, give no rows, and neither does
    an empty table. Repeated rows count as often as they stand there; a NULL id is carried. ``deviation`` is exact
    (NULL if over 38 digits), ``identity_error`` is measured over all rows, not derived. Sums over tasks do not grow
    with a key: no column is looked at but the vector, and each task sends one row per entry of the matrix.
    """
    good = usable(vectors, id_col, vector_col)
    sizes = good.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    empty = vectors.sparkSession.createDataFrame([], OUT)
    if not sizes:
        return empty.withColumnRenamed("vec_id", id_col)
    n, dims = sizes[0]["n"], sizes[0]["dims"]
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"{dims} dimensions; the matrix is made for {MOST_DIMENSIONS} at most")
    rows = good.filter(F.size("v") == dims)
    fit = Fit(rows, n, dims)
    k = min(components, len(fit.values))
    if not k:
        return empty.withColumnRenamed("vec_id", id_col)
    sums, share = fit.sums, (fit.values[:k] / fit.trace).tolist()
    project = fit.parts[:, :k] / np.sqrt(fit.values[:k])

    def spread(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for _, x in matrices(batches, dims):
            w = np.hstack([centred(x, n, sums) @ project, np.ones((len(x), 1))])
            total = w.T @ w if total is None else total + w.T @ w
        return None if total is None else total.ravel()

    moments = added(rows, spread, (k + 1) ** 2).reshape(k + 1, k + 1) / n
    covariance = moments[:k, :k] - np.outer(moments[:k, k], moments[:k, k])
    error = float(np.abs(covariance - np.eye(k)).max())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in matrices(batches, dims):
            w = centred(x, n, sums) @ project
            at = pa.array(np.repeat(np.arange(len(x)), k))
            exact = pa.array([d if d < 10**38 else None for d in deviations(x, n, sums)], pa.decimal128(38, 0))
            rows_out = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [pc.take(ids, at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(rows_out, n)),
                 pc.take(exact, at), pa.array(w.ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(rows_out, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(write, OUT).withColumnRenamed("vec_id", id_col)
