"""Whitening of embeddings by principal components, found by a block Jacobi-Davidson method.

The covariance is never formed: it is only applied, as the sum over all rows of (x - mean) ((x - mean) . W), one
job for a block W of vectors. The components of a search space are improved together: for each one that
has not converged a correction equation, projected against all wanted vectors, is solved by MINRES, whose
steps for all equations share one product. Components whose residual has reached double precision are locked.

Rows become whole numbers, and are centred exactly, as n * x - sum, before anything is multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.vectors import matrix
from holdfast.sources.tables import settle

EPS = np.finfo(np.float64).eps
MERGED = 64  # partial sums of more tasks than this are merged by tasks before the driver adds them
SHIFT, LIMIT = 1_000_000, 2**52  # of the whole numbers


def _minres(product: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, basis: np.ndarray, rhs: np.ndarray, steps: int, drop: float) -> np.ndarray:
    """Approximate solutions of P (A - shift I) P t = rhs, a column each, P projecting out the columns of basis.

    Every step is one product of A with all columns. Ends after `steps`, or when all residuals have fallen by `drop`.
    """
    def project(t: np.ndarray) -> np.ndarray:
        return t - basis @ (basis.T @ t)

    v = project(project(rhs))
    beta = start = np.linalg.norm(v, axis=0)
    live = start > 0
    v = v / np.where(live, beta, 1)
    before, t = np.zeros_like(v), np.zeros_like(v)
    d1, d2 = np.zeros_like(v), np.zeros_like(v)
    c, c1, s, s1 = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    eta, beta_before = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        w = project(product(v) - v * shifts) - before * beta_before
        alpha = (v * w).sum(0)
        w = project(w - v * alpha)
        beta = np.linalg.norm(w, axis=0)
        # Givens rotations of the tridiagonal matrix's new column, by the usual recurrences.
        r3, r2 = s1 * beta_before, c * (c1 * beta_before) + s * alpha
        r1_hat = c * alpha - s * (c1 * beta_before)
        r1 = np.hypot(r1_hat, beta)
        live &= r1 > EPS * np.abs(shifts)
        safe = np.where(live, r1, 1)
        d = np.where(live, (v - d2 * r3 - d1 * r2) / safe, 0)
        c1, s1, c, s = c, s, np.where(live, r1_hat / safe, 1), np.where(live, beta / safe, 0)
        t = t + d * (c * eta)
        eta = -s * eta
        d1, d2, before, beta_before = d, d1, v, beta
        v = np.where(live & (beta > 0), w / np.where(beta > 0, beta, 1), 0)
        if not (live & (np.abs(eta) > drop * start)).any():
            break
    return project(t)


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of `new` add to the spaces `against`."""
    for _ in range(2):  # twice is enough
        for space in against:
            new = new - space @ (space.T @ new)
        size = np.linalg.norm(new, axis=0)
        new = new[:, size > 0] / size[size > 0]
        if new.shape[1]:
            q, r = np.linalg.qr(new)
            # What is left of a column that the others already span is noise.
            new = q[:, np.abs(np.diag(r)) > 1e-8]
    return new


def leading(product: Callable[[np.ndarray], np.ndarray], size: int, k: int, widest: int | None = None, steps: int = 8, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors of a symmetric matrix given by its products.

    widest: most columns of the search space. All residuals reach 32 * eps * sqrt(size) of the largest eigenvalue.
    """
    k = min(k, size)
    widest = min(size, max(widest or 6 * k, 3 * k))
    locked, values = np.zeros((size, 0)), np.zeros(0)
    space = _orthonormal(np.random.default_rng(11).normal(size=(size, min(size, k + 2))))
    image = product(space)
    for _ in range(rounds):
        inner = space.T @ image
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn  # now the Ritz vectors, best first
        wanted = min(k - locked.shape[1], space.shape[1])
        residual = image[:, :wanted] - space[:, :wanted] * theta[:wanted]
        residual -= locked @ (locked.T @ residual)
        error = np.linalg.norm(residual, axis=0)
        top = max(float(np.abs(values).max(initial=0)), float(np.abs(theta).max(initial=0)))
        good = error <= 32 * EPS * np.sqrt(size) * top
        done = wanted if good.all() else int(np.argmin(good))  # locked in order, the largest first
        locked, values = np.hstack([locked, space[:, :done]]), np.concatenate([values, theta[:done]])
        if locked.shape[1] >= k or locked.shape[1] == size:
            break
        space, image, theta, residual = space[:, done:], image[:, done:], theta[done:], residual[:, done:]
        wanted -= done
        if space.shape[1] + wanted > widest - locked.shape[1]:  # restart with the best half
            kept = min(space.shape[1], max(wanted + 2, (widest - locked.shape[1]) // 2))
            space, image, theta = space[:, :kept], image[:, :kept], theta[:kept]
        basis = np.hstack([locked, space[:, :wanted]])
        correction = _minres(product, theta[:wanted], basis, -residual, steps, 1e-2)
        new = _orthonormal(correction, locked, space)
        if not new.shape[1]:  # nothing left but rounding: try another direction
            new = _orthonormal(np.random.default_rng(locked.shape[1]).normal(size=(size, wanted)), locked, space)
        if not new.shape[1]:  # the space is all there is
            locked = np.hstack([locked, space[:, :wanted]])
            values = np.concatenate([values, theta[:wanted]])
            break
        space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    else:
        raise ArithmeticError("components have not converged")
    inner = locked.T @ product(locked)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1][:k], (locked @ turn)[:, ::-1][:, :k]


@dataclass
class Whitening:
    """What has been fitted: n rows, sums by dimension, total variance, eigenvalues and components (columns)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    identity_error: float
    products: int


def _whole(df: DataFrame, vector: str) -> DataFrame:
    """df with x, the vector in whole numbers, where it can take part."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    numbers = F.col(f"`{vector}`").cast("array<double>")
    whole = F.transform(numbers, lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(64 * c))).cast("bigint") + SHIFT)
    usable = numbers.isNotNull() & (F.size(numbers) > 0) & ~F.coalesce(F.exists(numbers, bad), F.lit(True))
    return df.where(usable).withColumn("__x", whole)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """(n * x - sums) / n, the numerator exact where it fits 63 bits."""
    return (n * x - sums) / n if sums.dtype != object else ((n * x.astype(object) - sums) / n).astype(np.float64)


def _summed(rows: DataFrame, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all batches of part(rows of the batch), an array of doubles of one shape."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(matrix(batch.column(0)))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "total"])

    def merge(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table["task"].to_pylist(), table["total"].to_pylist()))
        total = sum(np.frombuffer(p) for _, p in parts)
        return pa.table({"task": pa.array([parts[0][0]], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    found = rows.select("x").mapInArrow(run, "task int, total binary")
    if rows.sparkSession.sparkContext.defaultParallelism > MERGED:
        found = found.groupBy(F.col("task") % MERGED).applyInArrow(merge, "task int, total binary")
    return sum(np.frombuffer(p) for _, p in sorted(map(tuple, found.collect())))


def fit(df: DataFrame, vector: str = "embedding", k: int = 16) -> Whitening | None:
    """Mean and leading components of the distinct vectors, every vector counted once; None without usable vectors.

    Only vectors of the commonest size count (of equally common ones the larger).
    """
    whole = _whole(df, vector).select(F.col("__x").alias("x"))
    rows = settle(whole.distinct().withColumn("size", F.size("x")), "whole-vectors")
    common = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return None
    size, n = common
    rows = rows.where(F.col("size") == size).select("x")
    found = rows.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.sum(F.col("c").cast("decimal(28,0)")).alias("s"), F.max(F.abs("c")).alias("most"))
    table = found.orderBy("d").collect()
    sums, most = [int(r["s"]) for r in table], max(r["most"] for r in table)
    exact = np.array(sums, np.int64 if 2 * n * most < 2**62 else object)

    # In double precision rows far out would swallow the others' variance; dividing by the largest keeps products finite.
    spread = _summed(rows, size, lambda x: (_centred(x, n, exact) ** 2).sum(0)) / n
    trace = float(spread.sum())
    if trace == 0:
        return Whitening(n, sums, 0.0, np.zeros(0), np.zeros((size, 0)), 0.0, 0)
    calls = 0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal calls
        calls += 1

        def part(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, exact)
            return (c.T @ (c @ block)).ravel()

        return _summed(rows, size, part).reshape(size, -1) / n

    values, components = leading(product, size, k)
    real = values > 64 * EPS * size * values[0]  # the others have no variance to divide by
    values, components = values[real], components[:, real]
    scale = components / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, exact) @ scale
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    found_moments = _summed(rows, size, moments) / n
    m = len(values)
    mean = found_moments[m * m :]
    error = np.abs(found_moments[: m * m].reshape(m, m) - np.outer(mean, mean) - np.eye(m)).max()
    return Whitening(n, sums, trace, values, components, float(error), calls)


def whiten(df: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """df's usable rows with whitened (array<double>, a number for each component) and deviation.

    deviation is the sum over dimensions of (n * x - sum)**2, exact, and null where a long cannot hold it.
    Vectors that are null, empty, of another size than the fitted ones, or hold null or non-finite
    entries are dropped; 64 * entry is held within +-2**52. Repeated rows and null ids stay as they are.
    Columns of df named whitened, deviation or __x are replaced.
    """
    rows = _whole(df, vector).drop("whitened", "deviation")
    size = 0 if model is None else len(model.sums)
    rows = rows.where(F.size("__x") == size)
    out = rows.withColumn("whitened", F.lit(None).cast("array<double>")).withColumn("deviation", F.lit(None).cast("bigint")).drop("__x")
    if model is None:
        return out
    n, sums, scale = model.n, model.sums, model.components / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("__x")).reshape(batch.num_rows, size)
            most = int(np.abs(x).max(initial=0))
            narrow = 2 * n * max(most, *map(abs, sums)) < 2**62
            exact = np.array(sums, np.int64) if narrow else np.array(sums, object)
            white = _centred(x, n, exact) @ scale
            gap = n * (x if narrow else x.astype(object)) - exact
            if not narrow or float(np.abs(gap).max(initial=0)) ** 2 * size >= 2**62:
                gap = gap.astype(object)
            total = (gap * gap).sum(1)
            deviation = pa.array([int(t) if t < 2**63 else None for t in total.tolist()], pa.int64())
            offsets = pa.array((np.arange(batch.num_rows + 1) * scale.shape[1]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))
            kept = [(name, c) for name, c in zip(batch.schema.names, batch.columns) if name != "__x"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), lists, deviation], [*(name for name, _ in kept), "whitened", "deviation"])

    return rows.mapInArrow(run, out.schema)
