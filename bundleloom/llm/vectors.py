"""Vectors: which take part, and exact cosine in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """True for vectors that are not null or empty, hold no null or non-finite component and are not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def own(table: DataFrame, *keys: str | Column) -> DataFrame:
    """id, further keys and the vector, for the rows whose vector can be compared.

    Vectors of floats travel as such, half the size; arithmetic is in doubles (see :func:`matrix`).
    """
    v = F.col("embedding")
    if dict(table.dtypes)["embedding"] not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    return table.select(F.col("vec_id").cast("long").alias("id"), *[F.col(k) if isinstance(k, str) else k for k in keys], v.alias("v")).filter(usable(F.col("v")))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of one length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe for very large and very small components."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of matching rows, each summed in the same order, so equal vectors score alike."""
    a, b = (m / np.abs(m).max(axis=1, keepdims=True) for m in (a, b))
    dot = (a * b).sum(axis=1)
    return dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _fine(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in extended precision, scaled by a power of two, and their lengths."""
    m = m.astype(np.longdouble)
    m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=-1, keepdims=True))[1])
    return m, np.sqrt((m * m).sum(axis=-1, keepdims=True))


def fine_unit(m: np.ndarray, step: int = 4096) -> np.ndarray:
    """Unit rows, from extended precision, so that vectors of one direction nearly always get the same doubles."""
    return np.concatenate([(lambda x: (x[0] / x[1]).astype(np.float64))(_fine(m[i : i + step])) for i in range(0, len(m), step)] or [m])


def fine_cosine(one: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of a vector with some rows, in extended precision and rounded to double, at most 1 in size."""
    (a, x), (b, y) = _fine(one[None, :]), _fine(rows)
    return np.clip(((a * b).sum(axis=1) / (x * y)[:, 0]).astype(np.float64), -1.0, 1.0)
