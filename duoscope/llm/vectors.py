"""Columns of vectors: which rows are fit to be worked on, and their components as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

#: Integers are below this; then neither sums over a batch nor squares leave 64 bits.
LIMIT = 1 << 28


def usable(df: DataFrame, vector: str, key: str, parts: int = 1) -> tuple[DataFrame, int]:
    """The rows whose vector holds finite numbers alone, and the number of components.

    That number is the length of the vector of the least key (null last) among those whose length is a multiple of
    parts; null and empty vectors and those of any other length are dropped. 0 where no row is left."""
    v = col(vector).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    left = df.where(fine)
    first = left.select(F.struct(col(key).isNull(), col(key), F.size(v)).alias("first")).agg(F.min("first")).first()[0]
    dim = first[2] if first else 0
    return left.where(F.size(v) == dim), dim


def lattice(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(256 * component) of each vector, one row each; an error where a value is too large to stay exact."""
    flat = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    x = np.floor(256.0 * flat)
    if x.size and np.abs(x).max() >= LIMIT:
        raise ValueError(f"a component is beyond {LIMIT // 256}, the most for exact sums")
    return x.astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes of 2, 4 and 8."""
    most = int(np.abs(x).max()) if x.size else 0
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def widened(raw: bytes, count: int) -> np.ndarray:
    """narrow() undone: count integers from their bytes."""
    return np.frombuffer(raw, f"<i{len(raw) // count}").astype(np.int64)
