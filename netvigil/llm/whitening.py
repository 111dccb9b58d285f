"""Operator 11, embedding whitening: shifted CholeskyQR of the centred rows, then an SVD of R.

Entries become integers ``floor(256 c)``, each distinct integer vector is one row of the fit list, which is
written once.  Exact sums give the mean.  Every pass over the list centres its rows, solves them
against the triangular factors so far and adds up their Gram matrix per task; the driver factors
the sum (``R_k``, shifted where the Gram matrix is near singular) until the rows are orthonormal on
their span.  The singular vectors of ``R = R_k ... R_1`` are the components, their squared singular
values over ``n`` the variances.  A shift moves no singular vector and later passes take it back out
of the values.  Scoring is a map over all rows.

Per-task Gram matrices (``d * d`` doubles) are written and added up in rounds of ``FAN_IN``, so the
driver gets ``DRIVER_BYTES`` of them at most, or one; nothing on the driver grows with the rows.  Equal vectors are
merged on the map side before the shuffle, so a vector of a third of all rows costs a row a task.

Defined cases: NULL vectors and those with a NULL, NaN or infinite entry are dropped; a vector
shorter than the longest counts as if zeros followed; ``floor(256 c)`` beyond a long is the nearest long (within 1,024);
repeated rows are one row of the fit list and all scored; NULL ids stay NULL.  A component without variance
(fewer distinct vectors or independent columns than asked for) has NULL ``whitened`` and
explains 0 (NULL if no component has any).  An empty table gives an empty result.  A deviation that
does not fit a long is NULL in the query, one beyond 38 digits also in the operator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import table, written

SCALE = 256
COMPONENTS = 4
BLOCK_CELLS = 1 << 20  # entries of one block of rows inside a task
DRIVER_BYTES = 64 << 20  # partial matrices that the driver collects
FAN_IN = 16
MAX_PASSES = 8
UNIT = 2.0 ** -53
LEAST_VARIANCE = 1e-16  # of the largest one; below it a component counts as having none


def integers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as integer vectors, and which rows are whole (others are left out)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    length = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = column.flatten()
    c = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)) if len(flat) else np.zeros(0)
    row = np.repeat(np.arange(n), length)
    place = np.arange(len(c)) - np.repeat(np.cumsum(length) - length, length)
    good = np.asarray(column.is_valid()).astype(bool)
    good[row[~np.isfinite(c)]] = False
    full = np.zeros((n, width))
    full[row, place] = c
    full[~good] = 0
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(full[good] * SCALE), -2.0 ** 63, 2.0 ** 63 - 1024).astype(np.int64)
    return x, good


def _packed(width: int):
    """Integer vectors as bytes; equal vectors have equal bytes (two a number where they all fit)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _ = integers(b.column("v"), width)
            small = (np.abs(x) < 1 << 15).all(1) & (x > -(1 << 63)).all(1)
            yield pa.RecordBatch.from_arrays([pa.array(
                [r.astype("<i2" if s else "<i8").tobytes() for r, s in zip(x, small)], pa.binary())], ["x"])
    return run


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.array([np.frombuffer(v, "<i2" if len(v) == 2 * width else "<i8")
                     for v in column.to_pylist()], np.int64).reshape(len(column), width)


def _sums(width: int):
    """Per task and dimension: sums of the numbers' high and low halves, which cannot overflow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(width, np.int64), np.zeros(width, np.int64), 0
        for b in batches:
            x = _unpacked(b.column("x"), width)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int32)), pa.array(high), pa.array(low),
                 pa.array(np.full(width, n, np.int64))], ["dim", "high", "low", "n"])
    return run


def solved(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``r^-T x`` for columns ``x`` and upper triangular ``r``: forward substitution over all columns."""
    q = x.copy()
    for j in range(len(r)):
        if j:
            q[j] -= r[:j, j] @ q[:j]
        q[j] /= r[j, j]
    return q


def _blocks(x: np.ndarray) -> Iterator[np.ndarray]:
    step = max(1, BLOCK_CELLS // max(1, x.shape[1]))
    for at in range(0, len(x), step):
        yield x[at:at + step]


def _gram(width: int, mean: np.ndarray, through):
    """Per task: the Gram matrix of ``through(centred columns)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in _blocks(_unpacked(b.column("x"), width)):
                q = through((x - mean).T)
                total = q @ q.T + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())],
                ["part", "cells"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for v in b.column("cells"):
            m = np.frombuffer(v.as_buffer())
            total = m if total is None else total + m
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())],
            ["part", "cells"])


def summed(parts: DataFrame, side: int, driver_bytes: int = DRIVER_BYTES) -> np.ndarray:
    """Sum of the matrices of ``part, cells``, by rounds of ``FAN_IN`` until the driver may collect them."""
    parts = written(parts, "gram")
    n = parts.count()
    while n > 1 and n * side * side * 8 > driver_bytes:
        n = -(-n // FAN_IN)
        parts = written(parts.repartition(n, F.col("part") % n).sortWithinPartitions("part")
                        .mapInArrow(_added, "part long, cells binary"), "gram")
    total = np.zeros((side, side))
    for r in parts.orderBy("part").toLocalIterator():
        total = total + np.frombuffer(r.cells).reshape(side, side)
    return total


@dataclass
class Whitening:
    """Fitted model: exact sums over ``n`` distinct vectors, variances and unit components (columns)."""

    n: int
    sums: list[int]
    variance: np.ndarray  # per component, falling; 0 where a component has none
    components: np.ndarray  # width x components, NaN columns where a component has no variance
    total: float  # trace of the covariance
    identity_error: float | None
    passes: int

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> list[float | None]:
        return [float(v / self.total) if self.total > 0 else None for v in self.variance]


def triangular_factor(g: np.ndarray, first: bool, block: int) -> tuple[np.ndarray, float]:
    """Cholesky factor of a Gram matrix, shifted on the first pass and whenever it is near singular."""
    d = len(g)
    values = np.linalg.eigvalsh(g)
    shift = 0.0
    if first or values[0] < 1e-8 * values[-1]:
        shift = 11 * (block * d + d * (d + 1)) * UNIT * values[-1]
    return np.linalg.cholesky(g + shift * np.eye(d)).T, shift / values[-1]


def fit(vectors: DataFrame, width: int, components: int = COMPONENTS,
        driver_bytes: int = DRIVER_BYTES) -> Whitening | None:
    """Fit on the distinct integer vectors of ``v`` (None if there are none)."""
    fit_list = written(vectors.select("v").mapInArrow(_packed(width), "x binary").distinct(), "whitening-fit")
    rows = (fit_list.mapInArrow(_sums(width), "dim int, high long, low long, n long").groupBy("dim")
            .agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")])
            .orderBy("dim").collect())
    if not rows or not width:
        return None
    n, sums = int(rows[0].n), [(int(r.high) << 32) + int(r.low) for r in rows]
    mean = np.array([s / n for s in sums])

    def gram(through, side):
        return summed(fit_list.mapInArrow(_gram(width, mean, through), "part long, cells binary"), side, driver_bytes)

    factors: list[np.ndarray] = []

    def orthogonalised(x):
        for f in factors:
            x = solved(x, f)
        return x

    total, shift = None, 0.0
    for passes in range(1, MAX_PASSES + 1):
        g = gram(orthogonalised, width)
        if total is None:
            total = float(np.trace(g)) / n
            if not total > 0:
                return Whitening(n, sums, np.zeros(components), np.full((width, components), np.nan), 0.0, None, 1)
        elif np.abs(g @ g - g).max() <= (4 * shift if len(factors) > 1 and shift else 1e-14 * width):
            break  # orthonormal on the span of the rows (but for the shift, where that is not the whole space)
        r, shift = triangular_factor(g, not factors, max(1, BLOCK_CELLS // width))
        factors.append(r)
    r = np.eye(width)
    for f in factors:
        r = f @ r
    _, sigma, vt = np.linalg.svd(r)
    k = min(components, width)
    variance = sigma[:k] ** 2 / n
    variance[sigma[:k] ** 2 <= LEAST_VARIANCE * sigma[0] ** 2] = 0
    axes = vt[:k].T * np.sign(vt[:k][np.arange(k), np.abs(vt[:k]).argmax(1)])
    axes[:, variance == 0] = np.nan
    real = int((variance > 0).sum())
    to = (axes[:, :real] / np.sqrt(variance[:real])).T
    cov = gram(lambda x: to @ x, real) / n
    return Whitening(n, sums, variance, axes, total, float(np.abs(cov - np.eye(real)).max()), passes)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sum over dimensions of ``(n x - S)^2``."""
    largest = max((n * int(abs(int(v))) + abs(s) for v, s in zip(_extremes(x), sums)), default=0)
    if len(sums) * largest ** 2 < 1 << 63:
        return pa.array(((n * x - np.array(sums, np.int64)) ** 2).sum(1)).cast(pa.decimal128(38))
    total = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([v if v < 10 ** 38 else None for v in total], pa.decimal128(38))


def _extremes(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.abs(x.max(0).astype(float)), np.abs(x.min(0).astype(float))) if len(x) else np.zeros(0)


def _scores(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, k = model.mean, len(model.variance)
        real = model.variance > 0
        to = np.where(real, model.components / np.sqrt(np.where(real, model.variance, 1)), 0)
        for b in batches:
            x, good = integers(b.column("v"), model.width)
            ids = b.column("id").filter(pa.array(good))
            at = 0
            for part in _blocks(x):
                y = (part - mean) @ np.nan_to_num(to)
                flat = pa.array(y.reshape(-1), mask=np.tile(~real, len(part)))
                edges = pa.array(np.arange(0, y.size + 1, k, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), _deviation(part, model.n, model.sums), pa.ListArray.from_arrays(edges, flat)],
                    ["id", "deviation", "whitened"])
                at += len(part)
    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
           vector_col: str = "embedding", driver_bytes: int = DRIVER_BYTES) -> tuple[DataFrame, Whitening | None]:
    """``id, deviation decimal(38,0), whitened array<double>`` of every whole vector, and the model."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    whole = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    width = rows.where(whole).agg(F.max(F.size("v"))).first()[0] or 0
    rows = rows.where(F.size("v") <= width)  # longer ones hold an entry that drops them
    model = fit(rows, width, min(components, width), driver_bytes) if width else None
    schema = "id long, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema), None
    return rows.mapInArrow(_scores(model), schema), model


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """Whitened values of every embedding on the first four components."""
    rows, model = whiten(table(spark, sf_dir, "embeddings"))
    n, explained, error = (model.n, model.explained, model.identity_error) if model else (0, [], None)
    shares = F.array(*[F.lit(v).cast("double") for v in explained]).cast("array<double>")
    return (rows.select(F.col("id").alias("vec_id"), F.expr("try_cast(deviation as long)").alias("deviation"),
                        F.posexplode("whitened").alias("_at", "whitened"))
            .select("vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                    "whitened", F.get(shares, F.col("_at")).alias("explained"), F.lit(error).cast("double").alias("identity_error")))
