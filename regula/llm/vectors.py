"""Tables of vectors: which rows count, and their components as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components, but not for
    a null or empty one."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def usable(df: DataFrame, columns: dict[str, str], vector: str, parts: int = 1) -> tuple[DataFrame, int]:
    """The rows with a finite vector as the new names of ``columns`` and
    ``vector``, and the dimension.

    A table has one dimension: the commonest length that ``parts`` divides (the
    smaller of equally common ones).  Rows of another length are left out."""
    rows = df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()], F.col(f"`{vector}`").alias("vector")).where(finite(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().where(F.col("dim") % parts == 0)
    top = lengths.orderBy(F.desc("count"), "dim").first()
    dim = top["dim"] if top else 0
    return rows.where(F.size("vector") == dim), dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """rows x dim doubles of a list column whose lists all have ``dim`` values."""
    return pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), dim)


def steps(x: np.ndarray, scale: float, limit: int) -> np.ndarray:
    """floor(scale * x) as int64.  Values of ``limit`` or more in size raise:
    the sums that are made of them have to fit."""
    out = np.floor(x * scale)
    if len(out) and np.abs(out).max() >= limit:
        raise ValueError(f"vector component of {limit / scale:g} or more")
    return out.astype(np.int64)
