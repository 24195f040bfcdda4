"""Vectors as exact integers: which rows count, and their entries as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c counts as floor(SCALE * c).
SCALE = 1024
#: Largest scaled entry: beyond, it would not be a long.
MOST = 2.0**62


def usable(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """vec_id, embedding of the rows whose vector is neither null nor holds a null or non-finite entry (or one whose
    integer is no long), and has `size` entries, where given. Rows stay as often as they come; other columns go."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * SCALE) < MOST)
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(entry(c), F.lit(False)))
    if size is not None:
        good = good & (F.size("embedding") == size)
    return vectors.select(F.col("vec_id").cast("long"), "embedding").filter(good)


def scaled(column: pa.ListArray, size: int) -> np.ndarray:
    """The integers floor(SCALE * c) of a batch of vectors of one size, as a matrix of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(column), size)


def exact(x: np.ndarray, factor: int) -> np.ndarray:
    """x, as longs if `factor` times its largest entry is one with room to spare, else as Python integers."""
    largest = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    return x if largest * factor < 1 << 62 else x.astype(object)


def longs(values) -> pa.Array:
    """An array of longs; null where an integer is none."""
    if getattr(values, "dtype", None) == np.int64:
        return pa.array(values)
    return pa.array([int(v) if -(1 << 63) <= v < 1 << 63 else None for v in values], pa.int64())
