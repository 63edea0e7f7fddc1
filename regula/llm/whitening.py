"""Whitening of vectors by shifted CholeskyQR.

Components are integers x = floor(``SCALE`` * c) + ``OFFSET``; rows are centred
exactly as (n * x - S) / n with the integer sums S of all n rows.  A pass over
all rows solves Y = X R^-1 through the triangular factors found so far and adds
up the Gram matrix Y'Y per task; the tasks' matrices are merged by a grouped
aggregation.  Its Cholesky factor, of the matrix shifted by a bound of its
rounding errors where it is not safely definite, is composed with the factors
before it.  After the first, shifted pass the columns are well conditioned, and
further passes make Y orthogonal to double precision, which the Gram matrix
alone, whose condition is the square of the rows', could not give.  Then the
singular values and right singular vectors of R are those of the rows: the
eigenvalues of the covariance are their squares over n.

The driver holds dimension x dimension matrices alone.  Components whose
singular value is below ``LEAST`` of the greatest have no variance that could be
scaled to one; they are left out, so constant vectors give no rows.

Awkward input: rows whose vector is null, empty or has null or non-finite
entries are left out, and so are those of another length than the table's
dimension (see ``vectors.usable``).  Repeated rows and rows without id count as
often as they stand.  An empty table gives no rows.  An entry of 2**24 or more in
size raises, since the sums would not fit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regula.llm import vectors

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
LIMIT = 1 << 30
#: passes at most; three are enough but for nearly dependent columns
PASSES = 8
#: distance of the Gram matrix from the identity at which the rows are orthogonal
ORTHOGONAL = 1e-10
#: share of the greatest at which a singular value, or a Gram matrix' eigenvalue, counts as nought
LEAST, EMPTY = 1e-10, 1e-6
#: rows solved at once
BLOCK = 1 << 13


@dataclass(frozen=True)
class Whitening:
    """n rows with integer ``sums``; columns of ``axes`` are the components,
    ``values`` their eigenvalues (falling) and ``trace`` the whole variance."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of the integer rows ``x``."""
        return centred(x, self.n, self.sums) @ (self.axes / np.sqrt(self.values))


def integers(column: pa.Array, dim: int) -> np.ndarray:
    return vectors.steps(vectors.matrix(column, dim), SCALE, LIMIT) + OFFSET


def _wide(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, as 64-bit integers where they fit and Python's otherwise."""
    high = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    kind = np.int64 if high < 1 << 62 else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S / n, each entry rounded once."""
    return _wide(x, n, sums).astype(float) / n


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Sum over the dimensions of (n * x - S)^2, exactly."""
    wide = _wide(x, n, sums)
    top = int(np.abs(wide).max(initial=0))
    if top * top * max(wide.shape[1], 1) >= 1 << 63:
        wide = wide.astype(object)
    return [int(v) for v in (wide * wide).sum(axis=1)]


def solve(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """y R^-1 for an upper triangular R, by substitution column by column."""
    out = y.copy()
    for j in range(r.shape[0]):
        if j:
            out[:, j] -= out[:, :j] @ r[:j, j]
        out[:, j] /= r[j, j]
    return out


def _merged(rows: DataFrame, work, kind: str) -> list:
    """Position-wise sums of the arrays ``work`` makes of each task's batches."""
    def task(batches: Iterator[pa.RecordBatch]):
        total = work(batches)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["part"])

    per_task = rows.select("vector").mapInArrow(task, f"part array<{kind}>")
    wide = F.col("value").cast("decimal(38,0)") if kind == "long" else F.col("value")
    merged = per_task.select(F.posexplode("part").alias("position", "value")).groupBy("position").agg(F.sum(wide).alias("total"))
    return [r["total"] for r in sorted(merged.collect(), key=lambda r: r["position"])]  # a matrix of the dimension at most


def column_sums(rows: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows and exact sum of each integer column."""
    def work(batches):
        total = np.zeros(dim + 1, np.int64)
        for batch in batches:
            total[:dim] += integers(batch.column("vector"), dim).sum(axis=0)
            total[dim] += batch.num_rows
        return total

    sums = [int(v) for v in _merged(rows, work, "long")]
    return (sums[-1], tuple(sums[:-1])) if sums else (0, (0,) * dim)


def _gram(rows: DataFrame, dim: int, through) -> np.ndarray:
    """Sum over all rows of y'y, y being ``through`` of the integer rows."""
    def work(batches):
        total = None
        for batch in batches:
            x = integers(batch.column("vector"), dim)
            for at in range(0, len(x), BLOCK):
                y = through(x[at:at + BLOCK])
                total = y.T @ y if total is None else total + y.T @ y
        return total

    flat = np.array(_merged(rows, work, "double"))
    width = int(round(len(flat) ** 0.5))
    return flat.reshape(width, width)


def _cholesky(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper factor of a Gram matrix.  It is shifted by a bound of the rounding
    errors of its sums and of the factoring, so that the factor exists, in the
    first pass and wherever it is not safely definite."""
    dim, unit = len(gram), np.finfo(float).eps / 2
    spread = np.linalg.eigvalsh(gram)
    if first:
        gram = gram + 11 * (min(n, BLOCK) * dim + dim * (dim + 1)) * unit * spread[-1] * np.eye(dim)
    elif spread[0] <= EMPTY * spread[-1]:
        gram = gram + 100 * dim * unit * spread[-1] * np.eye(dim)
    return np.linalg.cholesky(gram).T


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS, passes: int = PASSES) -> Whitening:
    """The whitening of all vectors of ``rows`` (vector)."""
    n, sums = column_sums(rows, dim)
    factors, whole = [], np.eye(dim)

    def through(x):
        y = centred(x, n, sums)
        for r in factors:
            y = solve(y, r)
        return y

    trace = 0.0
    for turn in range(passes if n else 0):
        gram = _gram(rows, dim, through)
        if not turn:
            trace = float(np.trace(gram)) / n
            if trace == 0:
                break
        spread, turned = np.linalg.eigh(gram)
        # directions without variance stay at nought, all others come to one
        empty = spread <= EMPTY
        if turn and (empty | (np.abs(spread - 1) <= ORTHOGONAL)).all():
            whole = (turned * np.sqrt(np.where(empty, 0, spread))).T @ whole
            break
        factors.append(_cholesky(gram, n, not turn))
        whole = factors[-1] @ whole
    if not trace:
        return Whitening(n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0)
    _, size, axes = np.linalg.svd(whole)
    used = min(components, int((size > LEAST * size[0]).sum()))
    axes = axes[:used].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(used)])
    return Whitening(n, sums, axes, size[:used] ** 2 / n, trace)


def identity_error(rows: DataFrame, dim: int, whitening: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, over
    all rows."""
    used = len(whitening.values)
    if not used:
        return 0.0
    return float(np.abs(_gram(rows, dim, whitening.apply) / whitening.n - np.eye(used)).max())


def whiten(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component (from 1, by falling eigenvalue), n, deviation, whitened,
    explained and identity_error of each usable row and component.

    ``deviation`` is a decimal: in a large table it does not fit into 64 bits."""
    rows, dim = vectors.usable(df, {"id": id}, vector)
    found = fit(rows, dim, components)
    used = len(found.values)

    def work(batches):
        for batch in batches:
            x = integers(batch.column("vector"), dim)
            for at in range(0, len(x), BLOCK):
                part = x[at:at + BLOCK]
                each = np.repeat(np.arange(len(part)), used)
                numbers = np.tile(np.arange(1, used + 1, dtype=np.int32), len(part))
                off = pa.array([str(v) for v in deviations(part, found.n, found.sums)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(part)).take(pa.array(each)), pa.array(numbers), off.take(pa.array(each)),
                     pa.array(found.apply(part).ravel())], names=["id", "component", "deviation", "whitened"])

    out = rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, component int, deviation string, whitened double")
    share = F.element_at(F.array(*[F.lit(float(v / found.trace)) for v in found.values]), F.col("component")) if used else F.lit(None).cast("double")
    return out.select(F.col("id").alias(id), "component", F.lit(found.n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"),
                      "whitened", share.alias("explained"), F.lit(identity_error(rows, dim, found)).alias("identity_error"))
