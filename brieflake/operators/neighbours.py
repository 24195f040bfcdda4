"""Exact nearest neighbours without all pairs.

Vectors are dealt to the nearest of some pivots (cells). A query is first compared with its nearest cells; the k-th distance found there
rules out every cell that can't hold a nearer vector: by the cell's radius (a vector lies within it of its pivot), and by the plane
between two pivots (a vector of a cell is nearer to its own). In the cells that are left, rows that the triangle inequality rules
out by their distance to the pivot are skipped, the others are compared as matrices, in groups of bounded size: a cell
of any size is split by hash, and so are the queries that come to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brieflake.operators.retrieval import top
from brieflake.sources.scratch import written

#: Vectors of a cell on average, and pivots at most (they are held by the driver and sent to each task).
CELL = 1024
PIVOTS = 512
#: Rows and queries of one comparison.
ROWS = 4096
QUERIES = 512


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def _to(points: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of rows of x to points, each difference squared and summed."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in points], axis=1)) if len(x) else np.zeros((0, len(points)))


def nearest_rows(q: np.ndarray, x: np.ndarray, ids: np.ndarray, radius: np.ndarray, far: float, most: float, k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and rounded squared distances of the k rows nearest to q, ties by id. radius: the rows' distances to the
    pivot, far: that of q, most: the distance beyond which no row counts."""
    able = np.flatnonzero(np.abs(radius - far) <= most)
    if len(able) > 4 * k:
        # by the expanded square first; what rounding may hide stays in
        part = x[able]
        rough = (part * part).sum(axis=1) - 2 * (part @ q)
        cut = np.partition(rough, k - 1)[k - 1]
        slack = 1e-9 * (1 + np.abs(rough).max() + q @ q) + 10.0**-digits
        able = able[rough <= cut + slack]
    d = np.round(((x[able] - q) ** 2).sum(axis=1), digits)
    first = np.lexsort((ids[able], d))[:k]
    return able[first], d[first]


class Neighbours:
    """The k nearest vectors (vec_id, embedding, other columns) of each query (query_id, q), by squared L2 distance,
    exact, ties to the smaller id. `compared` of `pairs`: how many (query, vector) pairs lie in the cells that were gone through.

    Vectors and queries that are null or of another size than the first pivot take no part; other columns of vectors come along.
    """

    def __init__(self, vectors: DataFrame, queries: DataFrame, k: int = 10, digits: int = 9):
        self.spark, self.k, self.digits = vectors.sparkSession, k, digits
        self.columns = [c for c in vectors.columns if c != "embedding"]
        self.types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != "embedding")
        self.id_type = queries.schema["query_id"].dataType.simpleString()
        rows = vectors.filter("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL)")
        self.n = rows.count()
        most = max(1, min(PIVOTS, math.ceil(self.n / CELL)))
        chosen = rows.select("embedding").orderBy(F.md5(F.col("vec_id").cast("string")), "embedding").limit(most).collect()
        self.size = len(chosen[0].embedding) if chosen else 0
        pivots = [r.embedding for r in chosen if len(r.embedding) == self.size]
        self.pivots = np.unique(np.array(pivots, dtype=np.float64).reshape(len(pivots), self.size), axis=0)
        same = f"size(embedding) = {self.size}"
        self.rows = self._placed(rows.filter(same))
        self.queries = written(queries.select("query_id", F.col("q").alias("embedding")).filter(f"embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL) AND {same}"), "near-queries")
        cells = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("r")).collect()
        self.count, self.radius = np.zeros(len(self.pivots), np.int64), np.zeros(len(self.pivots))
        for c in cells:
            self.count[c.cell], self.radius[c.cell] = c.n, c.r
        self.compared, self.pairs = 0, 0

    def _placed(self, rows: DataFrame) -> DataFrame:
        pivots, size, columns = self.pivots, self.size, self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = _to(pivots, _matrix(batch.column("embedding"), size))
                cell = d.argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], batch.column("embedding"), pa.array(cell), pa.array(d[np.arange(len(cell)), cell])], names=[*columns, "embedding", "cell", "radius"])

        kind = rows.schema["embedding"].dataType.simpleString()
        return written(rows.select(*columns, "embedding").mapInArrow(run, f"{self.types}, embedding {kind}, cell int, radius double"), "near-cells")

    def _cells(self, queries: DataFrame, first: bool) -> DataFrame:
        """query_id, embedding, cell, far, most: the cells of each query: the nearest that hold k vectors, or the others that aren't ruled out by `least`."""
        pivots, size, count, radius, k = self.pivots, self.size, self.count, self.radius, self.k
        between = np.sqrt(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)) if len(pivots) <= PIVOTS else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = _to(pivots, _matrix(batch.column("embedding"), size))
                order = np.argsort(far, axis=1, kind="stable")
                held = np.cumsum(count[order], axis=1)
                home = np.zeros(far.shape, bool)
                np.put_along_axis(home, order, (held - count[order]) < k, axis=1)
                home &= count > 0
                most = np.full(len(far), np.inf)
                if first:
                    take = home
                else:
                    least = batch.column("least").to_numpy(zero_copy_only=False)
                    most = np.where(np.isnan(least), np.inf, np.sqrt(np.nan_to_num(least)) * (1 + 1e-9) + 1e-9)
                    own = order[:, 0]
                    step = between[own]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = np.where(step > 0, (far**2 - far[np.arange(len(far)), own][:, None] ** 2) / (2 * step), 0.0)
                    bound = np.maximum(far - radius, plane)
                    take = ~home & (count > 0) & (bound <= most[:, None])
                at, cell = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(at)), batch.column("embedding").take(pa.array(at)), pa.array(cell.astype(np.int32)), pa.array(far[at, cell]), pa.array(most[at])], names=["query_id", "embedding", "cell", "far", "most"])

        kind = queries.schema["embedding"].dataType.simpleString()
        return written(queries.mapInArrow(run, f"query_id {self.id_type}, embedding {kind}, cell int, far double, most double"), "near-pairs")

    def _scored(self, pairs: DataFrame) -> DataFrame:
        """The k nearest of each query within each group of the cells that it is paired with."""
        size, k, digits, columns = self.size, self.k, self.digits, self.columns
        asked = {r.cell: r.n for r in pairs.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        self.compared += sum(int(self.count[c]) * n for c, n in asked.items())
        plan = [(c, max(1, math.ceil(int(self.count[c]) / ROWS)), math.ceil(n / QUERIES)) for c, n in asked.items()]
        # a row a cell
        ways = F.broadcast(self.spark.createDataFrame(plan, "cell int, ways int, chunks int"))
        key = ["cell", "way", "chunk"]
        rows = self.rows.join(ways, "cell").withColumn("way", F.pmod(F.xxhash64("vec_id"), "ways").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("ways", "chunks")
        queries = pairs.join(ways, "cell").withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int")).withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways", "chunks")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            left, right = left.combine_chunks(), right.combine_chunks()
            found, near, whose = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
            if len(left) and len(right):
                x, q = _matrix(left.column("embedding").combine_chunks(), size), _matrix(right.column("embedding").combine_chunks(), size)
                ids, radius = left.column("vec_id").to_numpy(), left.column("radius").to_numpy()
                far, most = right.column("far").to_numpy(), right.column("most").to_numpy()
                for i in range(len(q)):
                    at, d = nearest_rows(q[i], x, ids, radius, far[i], most[i], k, digits)
                    found.append(at)
                    near.append(d)
                    whose.append(np.full(len(at), i))
            at = pa.array(np.concatenate(found))
            return pa.table([right.column("query_id").take(pa.array(np.concatenate(whose))), *[left.column(c).take(at) for c in columns], pa.array(np.concatenate(near))], names=["query_id", *columns, "distance"])

        out = f"query_id {self.id_type}, {self.types}, distance double"
        return rows.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(run, out)

    def topk(self) -> DataFrame:
        """query_id, rank, the vectors' columns, distance (squared, rounded)."""
        if not self.n:
            return self.spark.createDataFrame([], f"query_id {self.id_type}, rank int, {self.types}, distance double")
        order = [F.col("distance"), F.col("vec_id")]
        self.pairs = self.queries.count() * int(self.count.sum())
        near = written(top(self._scored(self._cells(self.queries, True)), self.k, order, ["query_id"]), "near-first")
        least = near.filter(F.col("rank") == self.k).select("query_id", F.col("distance").alias("least"))
        others = self._cells(self.queries.join(least, "query_id", "left"), False)
        best = near.drop("rank").unionByName(self._scored(others)) if others.count() else near.drop("rank")
        return top(best, self.k, order, ["query_id"]).select("query_id", "rank", *self.columns, "distance")


def scanned(vectors: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
    """What `Neighbours` finds, for queries that fit in each task: every vector is compared with all of them in one scan, and the k best
    of each query leave a task."""
    columns = [c for c in vectors.columns if c != "embedding"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != "embedding")
    id_type = queries.schema["query_id"].dataType.simpleString()
    whole = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL)"
    rows = vectors.filter(whole)
    one = rows.select("embedding").orderBy(F.md5(F.col("vec_id").cast("string")), "embedding").limit(1).collect()
    if not one:
        return vectors.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, {types}, distance double")
    size = len(one[0].embedding)
    asked = queries.select("query_id", F.col("q").alias("embedding")).filter(f"{whole} AND size(embedding) = {size}").toArrow().combine_chunks()
    q = _matrix(asked.column("embedding").combine_chunks(), size) if len(asked) else np.zeros((0, size))
    names = asked.column("query_id").combine_chunks() if len(asked) else asked.column("query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.full(len(q), np.inf)  # the k-th distance of each query up to here
        best = None
        for batch in batches:
            if not len(batch) or not len(q):
                continue
            x = _matrix(batch.column("embedding"), size)
            ok = ~np.isnan(x).any(axis=1)
            rough = (x * x).sum(axis=1)[:, None] - 2 * (x @ q.T) + (q * q).sum(axis=1)
            # what rounding may hide stays in
            slack = 1e-9 * (1 + (x * x).sum(axis=1).max(initial=0, where=ok) + (q * q).sum(axis=1).max()) + 10.0**-digits
            if len(x) > k:
                most = np.minimum(most, np.partition(np.where(ok[:, None], rough, np.inf), k - 1, axis=0)[k - 1] + slack)
            at, whose = np.nonzero(ok[:, None] & ~(rough > most + slack))
            d = np.round(((x[at] - q[whose]) ** 2).sum(axis=1), digits)
            new = pa.table([pa.array(whose), pa.array(d), *[batch.column(c).take(pa.array(at)) for c in columns]], names=["__whose", "__d", *columns])
            best = (new if best is None else pa.concat_tables([best, new])).combine_chunks()
            whose, d, ids = (best.column(c).to_numpy() for c in ("__whose", "__d", "vec_id"))
            order = np.lexsort((ids, d, whose))
            first = np.flatnonzero(np.diff(whose[order], prepend=-1))
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            best = best.take(pa.array(order[place < k]))
            full = order[place == k - 1]
            most[whose[full]] = np.minimum(most[whose[full]], d[full])
        if best is not None:
            best = best.combine_chunks()
            got = pa.table([names.take(best.column("__whose").combine_chunks()), *[best.column(c) for c in columns], best.column("__d")], names=["query_id", *columns, "distance"])
            yield from got.to_batches()

    near = rows.filter(f"size(embedding) = {size}").select(*columns, "embedding").mapInArrow(run, f"query_id {id_type}, {types}, distance double")
    return top(near, k, [F.col("distance"), F.col("vec_id")], ["query_id"]).select("query_id", "rank", *columns, "distance")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, digits: int = 9) -> DataFrame:
    """Up to PIVOTS queries are compared with every vector: to deal a vector to its cell takes as many distances."""
    asked = written(queries.select("query_id", "q"), "near-asked")
    return scanned(vectors, asked, k, digits) if asked.count() <= PIVOTS else Neighbours(vectors, asked, k, digits).topk()
