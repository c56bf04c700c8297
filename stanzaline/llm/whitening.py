"""Embedding whitening by matrix-free block subspace iteration.

Vectors become whole numbers (``SCALE`` times the entry, rounded down). The fit list holds each different
vector once; its size and sums are exact. The leading eigenvectors of its covariance V come from a block Q of
k + EXTRA columns: each Spark pass computes X'(XQ) on centred rows as sums of small matrices, QR and
Rayleigh-Ritz give the next block, and the iteration ends when the residuals |Vu - eu| certify all k
components; a block that takes too many steps doubles. V itself is never formed. Between two Rayleigh-Ritz steps the block is filtered by a Chebyshev
polynomial of V over the unwanted part of the spectrum, so that close eigenvalues need few passes. A last pass
whitens the fit list and measures the covariance of the result.

Defined cases: a vector that is null, or holds a null or an entry that is not finite, is left out; a shorter
vector has zeros in the dimensions that it lacks; entries beyond 64 bits become the nearest long; repeated rows
and rows that tie on vec_id each get their result; components whose eigenvalue is nothing but rounding (all,
if there is one different vector alone) are left out, so there are at most as many as the fit list has
dimensions; a deviation beyond 64 bits is null; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, COMPONENTS, SEED = 256, 4, 271_828
#: Columns of the block beside the components that are asked for.
EXTRA = 8
#: A component is certified when its residual is at most this part of the largest eigenvalue.
TOLERANCE = 1e-13
#: Passes from one Rayleigh-Ritz step to the next, and steps after which the block doubles; with all columns it is exact.
DEGREE, PATIENCE = 8, 16
_MOST = np.iinfo(np.int64).max


@dataclass
class Fit:
    """What whitening needs: list size, exact sums, eigenvalues, unit eigenvectors as columns, trace of V, error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float
    passes: int = 0


def whole(vector, scale: int = SCALE):
    """The vector as longs; null where it is left out."""
    entries = F.transform(vector.cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))))
    fit = F.forall(vector.cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(fit, entries)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of longs, filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None] < lengths[:, None]] = flat
    return out


def _added(spark_frame: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], width: int) -> np.ndarray:
    """The sum of small matrices, one for each task: of about sqrt(tasks) of them in one place, in the order of the tasks."""
    tasks = spark_frame.rdd.getNumPartitions()
    groups = max(1, round(tasks**0.5))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for batch in common.slices(batches, 8192):
            total += part(_matrix(batch.column(0), width))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()])], names=["task", "sum"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("task")
        total = np.sum([np.frombuffer(b) for b in ordered["sum"]], axis=0)
        return pd.DataFrame({"task": [int(ordered["task"].iloc[0])], "sum": [total.tobytes()]})

    sums = spark_frame.mapInArrow(each, "task long, sum binary").groupBy(F.pmod("task", F.lit(groups))).applyInPandas(add, "task long, sum binary").collect()
    return np.sum([np.frombuffer(r["sum"]) for r in sorted(sums, key=lambda r: r["task"])] or [np.zeros(shape).ravel()], axis=0).reshape(shape)


def _exact(frame: DataFrame, width: int) -> tuple[int, list[int]]:
    """Count, and the sum of each dimension, exactly."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in common.slices(batches, 8192):
            x = _matrix(batch.column(0), width)
            if np.abs(x.astype(float)).max(initial=0) > 2**48:  # the sum of so many might pass 64 bits
                x = x.astype(object)
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, x.sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(map(str, sums), pa.string())], names=["at", "n", "s"])

    total = frame.mapInArrow(each, "at int, n long, s string").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"))
    rows = sorted(total.collect(), key=lambda r: r["at"])
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]


def _filtered(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, y: np.ndarray, top: float, cut: float) -> np.ndarray:
    """Chebyshev polynomial of V of degree DEGREE on the block, small on [0, cut], one at the eigenvalue ``top``; y is V q."""
    half = cut / 2
    first = sigma = half / (half - top)
    new = (y - half * q) * (sigma / half)
    for _ in range(2, DEGREE + 1):
        after = 1 / (2 / first - sigma)
        q, new = new, (apply(new) - half * new) * (2 * after / half) - (sigma * after) * q
        sigma = after
    return new


def fit(listed: DataFrame, components: int = COMPONENTS, tolerance: float = TOLERANCE) -> Fit:
    """Leading components of the covariance of ``listed``, a table of different vectors x of longs."""
    width = listed.agg(F.max(F.size("x"))).first()[0] or 0
    n, sums = _exact(listed, width)
    if not n or not width:
        return Fit(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0, 0.0)
    # the whole part of the mean is taken off in longs, so that no digit is lost where the mean is large
    base = np.array([min(max(s // n, -_MOST), _MOST) for s in sums], np.int64)
    rest = np.array([(s - n * int(b)) / n for s, b in zip(sums, base)])
    centred = lambda x: (x - base).astype(float) - rest
    passes = 0

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ q)

        return _added(listed, part, q.shape, width) / n

    trace = float(_added(listed, lambda x: (centred(x) ** 2).sum(0), (width,), width).sum()) / n
    if not trace:
        return Fit(n, sums, np.zeros(0), np.zeros((width, 0)), trace, 0.0)
    block, steps, draw = min(width, components + EXTRA), 0, np.random.default_rng(SEED)
    q = np.linalg.qr(draw.standard_normal((width, block)))[0]
    while True:
        y = apply(q)
        found, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        found, turn = found[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        wanted = min(components, int((found > 1e-13 * trace).sum()))
        residuals = np.linalg.norm(y[:, :wanted] - q[:, :wanted] * found[:wanted], axis=0)
        if block == width or (residuals <= tolerance * found[0]).all():
            break
        steps += 1
        if steps % PATIENCE == 0:
            block = min(width, 2 * block)
            q = np.linalg.qr(np.hstack([q, draw.standard_normal((width, block - q.shape[1]))]))[0]
            continue
        q = np.linalg.qr(_filtered(apply, q, y, found[0], max(found[-1], 1e-6 * found[0])))[0]
    values, vectors = found[:wanted], q[:, :wanted]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(wanted)] < 0, -1.0, 1.0)

    def covariance(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ vectors / np.sqrt(values)
        return w.T @ w

    error = float(np.abs(_added(listed, covariance, (wanted, wanted), width) / n - np.eye(wanted)).max(initial=0))
    return Fit(n, sums, values, vectors, trace, error, passes)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S) squared, exactly; None beyond 64 bits."""
    most = max([abs(s) for s in sums], default=0) + n * int(np.abs(x.astype(object)).max(initial=0))
    if len(sums) * most * most <= _MOST:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
    return [int(v) if v <= _MOST else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each remaining row and component."""
    rows = common.materialize(vectors.select("vec_id", whole(F.col("embedding")).alias("x")).where(F.col("x").isNotNull()), "vectors")
    listed = common.materialize(rows.select("x").distinct(), "fit")
    model = fit(listed, components)
    width, kept = len(model.sums), len(model.values)
    base = np.array([min(max(s // model.n, -_MOST), _MOST) for s in model.sums], np.int64)
    rest = np.array([(s - model.n * int(b)) / model.n for s, b in zip(model.sums, base)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 8192):
            x = _matrix(batch.column(1), width)
            projected = ((x - base).astype(float) - rest) @ model.vectors / np.sqrt(model.values)
            each = np.repeat(np.arange(len(x)), kept)
            constant = lambda v: pa.array(np.full(len(each), v))
            component = np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))
            columns = [batch.column(0).take(pa.array(each)), pa.array(component), constant(model.n), pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(each)), pa.array(projected.ravel()), pa.array((model.values / model.trace)[component - 1] if kept else np.zeros(0)), constant(model.error)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
