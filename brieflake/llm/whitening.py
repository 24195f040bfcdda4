"""Embedding whitening by the singular value decomposition of the centred rows.

x = floor(1024 * c) + 100000 for every entry c. With n vectors and per-dimension sums S, the centred rows x - S / n are
a distributed row matrix; MLlib's computeSVD gives its singular values s and right vectors. Its covariance with
divisor n has the eigenvalues e = s * s / n, and whitening projects a centred row on the vectors, over sqrt(e). The total variance comes
from the exact integer deviations (n * x - S) ** 2, not from the decomposition, so `explained` is right though only the
first components are kept.

The driver holds the sums (one number a dimension), the decomposition's small matrix and COMPONENTS vectors.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brieflake.llm.common import materialize
from brieflake.llm.vectors import exact, longs, scaled, usable

COMPONENTS = 8
SHIFT = 100_000
#: Singular values below this share of the largest count as zero: the rows don't span that direction.
RANK = 1e-7
#: Dimensions up to which all singular vectors are computed from the small matrix (LAPACK); beyond, only the first ones.
DENSE = 2048

_SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _centred(column: pa.ListArray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    x = exact(scaled(column, len(sums)) + SHIFT, 2 * n)
    return n * x - np.array(sums, dtype=x.dtype)


def dimension_sums(rows: DataFrame, size: int) -> list[int]:
    """S: the sum of x by dimension. One row a dimension leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:
            x = scaled(batch.column("embedding"), size) + SHIFT
            total = [a + int(b) for a, b in zip(total, exact(x, len(x)).sum(axis=0))] if len(x) else total
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([decimal.Decimal(t) for t in total], pa.decimal128(38, 0))], names=["d", "s"])

    got = rows.select("embedding").mapInArrow(run, "d int, s decimal(38,0)").groupBy("d").agg(F.sum("s").alias("s")).collect()
    return [int(r.s) for r in sorted(got)]


def principal(rows: DataFrame, n: int, sums: list[int], components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit vectors (as columns) of the covariance, as many as the rows span, `components` at most."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    size = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = (_centred(batch.column("embedding"), n, sums) / n).astype(np.float64)
            at = pa.array(np.arange(len(y) + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(y.ravel()))], names=["y"])

    matrix = MLUtils.convertVectorColumnsFromML(rows.select("embedding").mapInArrow(run, "y array<double>").select(array_to_vector("y").alias("y")), "y")
    svd = RowMatrix(matrix, n, size).computeSVD(size if size <= DENSE else min(components, size - 1), False, RANK)
    s = svd.s.toArray()
    k = min(components, int((s > 0).sum()))
    return s[:k] ** 2 / n, svd.V.toArray()[:, :k]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    vectors (vec_id, embedding). deviation: the sum over the dimensions of (n * x - S) ** 2, null if it is no long (the
    total variance takes it whole all the same). identity_error: the largest absolute entry of the covariance of
    `whitened` minus the identity. Components that the vectors don't span are left out: with one vector, or none that
    differs, there are no rows. Null vectors and those with null or non-finite entries drop out; of vectors of several
    sizes those of the most frequent one count (ties: the largest), as the others have no place among its dimensions. Null vec_id: kept.
    Repeated rows: as often as they come. Empty table: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    all_rows = materialize(usable(vectors), "whiten-rows")
    sizes = all_rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    nothing = spark.createDataFrame([], f"vec_id long, {_SCHEMA}")
    if not sizes or not sizes[0]["size"]:
        return nothing
    size, n = sizes[0]["size"], sizes[0]["count"]
    rows = all_rows.filter(F.size("embedding") == size)
    sums = dimension_sums(rows, size)
    values, axes = principal(rows, n, sums, components)
    if not len(values):
        return nothing
    scale = axes / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _centred(batch.column("embedding"), n, sums)
            largest = max(abs(int(d.max())), abs(int(d.min()))) if d.size else 0
            wide = d if largest * largest * size < 1 << 62 else d.astype(object)
            deviation = (wide * wide).sum(axis=1)
            w = (d / n).astype(np.float64) @ scale
            at = pa.array(np.arange(len(w) + 1, dtype=np.int32) * len(values))
            spread = pa.array((deviation / n / n).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), longs(deviation), spread, pa.ListArray.from_arrays(at, pa.array(w.ravel()))], names=["vec_id", "deviation", "spread", "w"])

    done = materialize(rows.mapInArrow(run, "vec_id long, deviation long, spread double, w array<double>"), "whitened")
    pairs = [(i, j) for i in range(len(values)) for j in range(i + 1)]
    got = done.agg(F.sum("spread"), *[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(got[1:], pairs))
    explained = F.array(*[F.lit(float(e / (got[0] / n))) for e in values])
    return done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error")
    )
