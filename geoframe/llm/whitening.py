"""Whitening of embeddings by a one-sided Jacobi SVD.

Entries become whole numbers, so counts and sums are exact.  The fit list holds each different
vector once.  Its rows, centred, are compressed by a blockwise QR: a task folds its rows block by
block into one triangle of d x d numbers, and triangles are stacked and folded again, sixteen at
a time, until one is left.  That R has the singular values of all centred rows.  Plane rotations
then make R's columns orthogonal: d / 2 disjoint pairs at a time, in the order of a round-robin
tournament, sweep after sweep, until every pair is orthogonal to working precision.  The rotations
together are the components, and the lengths of the columns over sqrt(n) the standard deviations.
The squares of the rows are never formed, so small deviations keep their digits.

Only R (d x d) and the sums (d) reach the driver.  The rows are read once for the fit list, which
is written, and the list three times: sums, QR, and the covariance of what was whitened.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, as
are vectors shorter than the longest (an empty vector is one).  Null and repeated ids keep their
rows, repeated vectors count once in the fit list.  Components whose deviation is zero to working
precision can't be whitened and give no rows, so one vector alone, equal vectors or an empty table
give none.  ``deviation`` is exact, and null where it doesn't fit into a long.  A component's
entry of largest magnitude is positive.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

SCALE = 256
#: Numbers of a block; states that are folded at a time.
BLOCK = 1 << 20
FAN = 16
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x, floor(scale * c) of each entry c, of the rows whose entries are all finite."""
    named = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return named.filter(F.col("v").isNotNull() & ~F.exists("v", odd)).select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """The vectors of each batch as a matrix, in slices of BLOCK numbers, with their rows."""
    step = max(1, BLOCK // d)
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d), part


def _state(part: int, numbers: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(np.ascontiguousarray(numbers).ravel())
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], ["part", "state"])


def _folded(states: DataFrame, merge: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Merges the states of all tasks, FAN at a time, into one; each has rows of ``width`` numbers."""
    states = cut(states)
    top = states.agg(F.max("part")).first()[0]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        made = None
        for state in table.column("state"):
            now = state.values.to_numpy(zero_copy_only=False).reshape(-1, width)
            made = now if made is None else merge(made, now)
        return pa.Table.from_batches([_state(table.column("part")[0].as_py() // FAN, made)])

    while top > 0:
        states = states.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(run, "part int, state array<double>")
        top //= FAN
    return np.array(states.first()["state"]).reshape(-1, width)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 1, object)
        for x, _ in _blocks(batches, d):
            total[0] += len(x)
            small = len(x) * float(np.abs(x, dtype=float).max(initial=0)) < 2.0**62
            total[1:] += x.sum(0).astype(object) if small else x.astype(object).sum(0)
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([str(t) for t in total], pa.string())], ["at", "total"])

    parts = fit.select("x").mapInArrow(run, "at int, total string")
    sums = {r["at"]: int(r["total"]) for r in parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return sums[0], [sums[i + 1] for i in range(d)]


def triangle(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of a QR of the centred rows."""
    d = len(mean)

    def fold(above: np.ndarray, below: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([above, below]), mode="r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for x, _ in _blocks(batches, d):
            made = np.linalg.qr(x - mean, mode="r") if made is None else fold(made, x - mean)
        if made is not None:
            yield _state(TaskContext.get().partitionId(), made)

    return _folded(fit.select("x").mapInArrow(run, "part int, state array<double>"), fold, d)


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) of ``r``, by plane rotations
    of its columns; disjoint pairs are rotated together."""
    d = r.shape[1]
    even = d + d % 2
    a, v = np.zeros((len(r), even)), np.eye(even)
    a[:, :d] = r
    players = np.arange(even)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(even - 1):
            i, j = players[: even // 2], players[: even // 2 - 1 : -1]
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx) * np.sqrt(yy)
            off = np.divide(np.abs(xy), size, out=np.zeros_like(xy), where=size > 0)
            worst = max(worst, off.max(initial=0))
            turn = off > 1e-16
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            a[:, i], a[:, j] = c * x - s * y, s * x + c * y
            p, q = v[:, i], v[:, j]
            v[:, i], v[:, j] = c * p - s * q, s * p + c * q
            players[1:] = np.roll(players[1:], 1)
        if worst <= 1e-15 * np.sqrt(d):
            break
    length = np.sqrt((a * a).sum(0))[:d]
    order = np.argsort(-length, kind="stable")
    v = v[:d, order]
    return length[order], v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0)


def identity_error(fit: DataFrame, mean: np.ndarray, project: np.ndarray) -> float:
    """The largest entry, by magnitude, of the whitened vectors' covariance minus the identity."""
    d, k = project.shape

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """States are a row for the mean and the count, then the centred products."""
        n, m = a[0, k], b[0, k]
        apart = b[0, :k] - a[0, :k]
        out = a + b
        out[0] = [*(a[0, :k] + apart * (m / (n + m))), n + m]
        out[1:, :k] += np.outer(apart, apart) * (n * m / (n + m))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for x, _ in _blocks(batches, d):
            w = (x - mean) @ project
            now = np.zeros((k + 1, k + 1))
            now[0] = [*w.mean(0), len(w)]
            now[1:, :k] = (w - now[0, :k]).T @ (w - now[0, :k])
            made = now if made is None else merge(made, now)
        if made is not None:
            yield _state(TaskContext.get().partitionId(), made)

    state = _folded(fit.select("x").mapInArrow(run, "part int, state array<double>"), merge, k + 1)
    return float(np.abs(state[1:, :k] / state[0, k] - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2, exact."""
    most = float(np.abs(x, dtype=float).max(initial=0)) * n + max(map(abs, sums))
    if most * most * x.shape[1] < 2.0**62:
        apart = x * n - np.array(sums, np.int64)
        return (apart * apart).sum(1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
    return [int(t) if t < 1 << 63 else None for t in exact]


def whiten(vectors: DataFrame, components: int = 4, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each remaining vector and component: vec_id, component (from 1), n, deviation,
    whitened, explained, identity_error."""
    rows = whole_numbers(vectors, scale, vec_id, vector)
    fit = cut(rows.select("x").distinct())
    d = fit.agg(F.max(F.size("x"))).first()[0]
    empty = vectors.sparkSession.createDataFrame([], OUT)
    if not d:
        return empty
    rows, fit = rows.filter(F.size("x") == d), fit.filter(F.size("x") == d)
    n, sums = exact_sums(fit, d)
    mean = np.array([s / n for s in sums])
    length, axes = jacobi(triangle(fit, mean))
    k = int((length[:components] > max(length[0], 1e-300) * d * np.finfo(float).eps).sum())
    if not k:
        return empty
    explained = length[:k] ** 2 / (length**2).sum()
    project = axes[:, :k] / (length[:k] / np.sqrt(n))
    error = identity_error(fit, mean, project)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, part in _blocks(batches, d):
            m = len(x)
            at = pa.array(np.repeat(np.arange(m), k))
            deviation = pa.array(_deviations(x, n, sums), pa.int64())
            made = [part.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(at), pa.array(((x - mean) @ project).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(made, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, OUT)
