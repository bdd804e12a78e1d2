"""Whitening of embedding vectors by LOBPCG.

Entries become integers, floor(``SCALE`` c) + ``SHIFT``, so counts and sums are exact. The leading
eigenvectors of the covariance V of those vectors are found without V: a pass over the rows, each
centred before it is multiplied, gives V times the columns of an orthonormal basis of the iterate,
its residuals and the previous direction. Rayleigh-Ritz on that basis gives the next iterate. The
driver holds a few columns of one entry a dimension, never rows. A pass sums per task, then per
dimension. Each residual comes from products of that pass, so it certifies its eigenpair:
the iteration ends when every wanted one is at most ``TOLERANCE`` of the largest eigenvalue.

Rows whose vector is null, empty, or holds a null or non-finite entry are dropped, and so are rows
of another length than most (of two equally frequent lengths the shorter one is dropped). Repeated
rows count as often as they stand. A component without variance (one row, equal rows) has a null
``whitened`` and, where nothing varies at all, a null ``explained``. A ``deviation`` beyond a long is
null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.workspace import written

SCALE, SHIFT = 1024, 100_000
TOLERANCE = 1e-13
#: Products of one search; each is a pass over the rows. A search that needs more ends in an error.
MAX_PASSES = 500
#: Columns of the iterate for each wanted one. More of them cost arithmetic and save passes.
GUARD = 4
#: Relative variance below which a direction counts as none.
NO_VARIANCE = 1e-12
#: Entries of a batch handled at once.
BATCH_ENTRIES = 1 << 20


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x) of the rows that take part, written."""
    good = vectors.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_c")).filter("size(_c) > 0")
    good = good.filter(F.forall("_c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    x = written(good.select("_key", F.transform("_c", lambda c: F.floor(F.lit(float(SCALE)) * c) + SHIFT).alias("_x")), "integer-vectors")
    usual = x.groupBy(F.size("_x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).head()
    return x if usual is None else x.filter(F.size("_x") == usual.d)


def _matrix(batch: pa.RecordBatch, column: str = "_x") -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _blocks(matrix: np.ndarray) -> Iterator[np.ndarray]:
    step = max(1, BATCH_ENTRIES // max(1, matrix.shape[1]))
    for start in range(0, len(matrix), step):
        yield matrix[start : start + step]


def _summed(x: DataFrame, own: Callable[[np.ndarray], np.ndarray], rows: int, columns: int) -> np.ndarray:
    """Sum over all rows of ``own`` (rows x columns a block of vectors): by task, then by row of the result."""
    if not columns:
        return np.zeros((rows, 0))
    schema = pa.schema([("at", pa.int32()), ("v", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        seen = False
        for batch in batches:
            for block in _blocks(_matrix(batch)):
                total += own(block)
                seen = True
        if seen:
            yield pa.record_batch([pa.array(np.arange(rows, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], schema=schema)

    parts = x.select("_x").mapInArrow(run, "at int, v array<double>")
    sums = parts.groupBy("at").agg(*[F.sum(F.col("v")[i]).alias(f"c{i}") for i in range(columns)]).collect()
    out = np.zeros((rows, columns))
    for row in sums:
        out[row.at] = row[1:]
    return out


def covariance_product(x: DataFrame, mean: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """V ``block``, in one pass over centred rows."""

    def own(rows: np.ndarray) -> np.ndarray:
        centred = rows - mean
        return centred.T @ (centred @ block)

    return _summed(x, own, len(mean), block.shape[1]) / n


def _orthonormal(*blocks: np.ndarray) -> np.ndarray:
    """An orthonormal basis of all columns; what depends on the columns before it is left out.
    Each block is put against the basis twice, as one pass leaves rounding errors."""
    basis = np.zeros((len(blocks[0]), 0))
    for block in blocks:
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
            left, size, _ = np.linalg.svd(block, full_matrices=False)
            block = left[:, size > 1e-10]
        basis = np.hstack([basis, block])
    return basis


def leading_eigenpairs(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, tolerance: float = TOLERANCE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(eigenvalues falling, unit eigenvectors as columns, residual norms, passes) of the ``k`` largest
    of the symmetric matrix that ``product`` multiplies with. The iterate has ``GUARD`` times the
    wanted columns: the gap that counts is then that to the first column outside it."""
    m = min(d, GUARD * k)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((d, m)))
    own = basis.shape[1]  # columns of the basis that are the iterate
    for passes in range(1, MAX_PASSES + 1):
        times = product(basis)
        small = basis.T @ times
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1][:m], turns[:, ::-1][:, :m]
        iterate = basis @ turns
        residual = times @ turns - iterate * values
        norms = np.linalg.norm(residual, axis=0)
        if norms[:k].max() <= tolerance * max(values[0], 0):
            return values[:k], iterate[:, :k], norms[:k], passes
        direction = basis[:, own:] @ turns[own:]
        basis = _orthonormal(iterate, residual, direction)
        own = min(m, basis.shape[1])
    raise RuntimeError(f"residuals {norms[:k]} are above {tolerance} of {values[0]} after {MAX_PASSES} passes")


def _deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; beyond a long, null."""
    float_sums = np.array(sums, np.float64)
    widest = np.abs(n * x.astype(np.float64) - float_sums).max(initial=0.0)
    if widest**2 * len(sums) < 2.0**62 and n * float(np.abs(x).max(initial=0)) < 2.0**62 and np.abs(float_sums).max(initial=0.0) < 2.0**62:
        off = n * x.astype(np.int64) - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row for each vector
    and component."""
    x = integer_vectors(vectors, key, vector)
    out = f"_key {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double"
    first = x.head()
    if first is None:
        return vectors.sparkSession.createDataFrame([], out + ", identity_error double").withColumnRenamed("_key", key)
    d = len(first["_x"])
    k = min(components, d)
    totals = x.agg(F.count("*").alias("n"), *[F.sum(F.col("_x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)]).head()
    n, sums = totals[0], [int(s) for s in totals[1:]]
    mean = np.array([s / n for s in sums])
    trace = float(_summed(x, lambda rows: ((rows - mean) ** 2).sum(axis=0)[:, None], d, 1).sum()) / n
    if trace > 0:
        values, axes, _, _ = leading_eigenpairs(lambda block: covariance_product(x, mean, n, block), d, k)
    else:
        values, axes = np.zeros(k), np.eye(d)[:, :k]
    varied = values > NO_VARIANCE * max(values[0], 0.0)
    scale = np.where(varied, 1 / np.sqrt(np.where(varied, values, 1.0)), 0.0)
    explained = [float(v / trace) if trace > 0 else None for v in np.maximum(values, 0.0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix, keys, at = _matrix(batch), batch.column("_key"), 0
            for block in _blocks(matrix):
                white = (block - mean) @ axes * scale
                every = np.repeat(np.arange(len(block)), k)
                which = np.tile(np.arange(k), len(block))
                deviation = pa.array(_deviations(block, sums, n), pa.int64())
                columns = [
                    keys.slice(at, len(block)).take(pa.array(every)), pa.array((which + 1).astype(np.int32)), pa.array(np.full(len(every), n)), deviation.take(pa.array(every)),
                    pa.array(white.ravel(), mask=~varied[which]), pa.array([explained[i] for i in range(k)], pa.float64()).take(pa.array(which)),
                ]
                yield pa.record_batch(columns, names=["_key", "component", "n", "deviation", "whitened", "explained"])
                at += len(block)

    rows = written(x.mapInArrow(run, out), "whitened")
    use = np.flatnonzero(varied)

    def own(block: np.ndarray, off: np.ndarray | float = 0.0) -> np.ndarray:
        return (block - mean) @ axes[:, use] * scale[use] - off

    white_mean = _summed(x, lambda b: own(b).sum(axis=0)[:, None], len(use), 1)[:, 0] / n
    covariance = _summed(x, lambda b: own(b, white_mean).T @ own(b, white_mean), len(use), len(use)) / n
    error = float(np.abs(covariance - np.eye(len(use))).max()) if len(use) else None
    return rows.withColumn("identity_error", F.lit(error).cast("double")).withColumnRenamed("_key", key)
