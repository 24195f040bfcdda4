"""Centroid clustering of integer vectors with partial-distance search.

Squared differences are summed over the dimensions of the highest variance first, STEP at a time; a centroid is given up
for a vector once its sum is strictly above the best full distance so far. Survivors finish all dimensions, so
distances and ties (the smaller number) are exact. Each round is one pass over the written vectors: a task sends one
row for each of its centroids and dimensions, and the driver divides the sums (CLUSTERS x SIZE integers).
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brieflake.llm.common import materialize
from brieflake.llm.vectors import SCALE, exact, longs, scaled, usable

CLUSTERS = 8
ROUNDS = 10
SIZE = 64
SEED = 3
#: Dimensions between two looks at the best distance.
STEP = 8


def assign(x: np.ndarray, centroids: list[list[int]], order: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid, and how many differences were computed."""
    reach = max((abs(v) for c in centroids for v in c), default=0)
    largest = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    kind = np.int64 if (reach + largest) ** 2 * len(order) < 1 << 62 else object
    x = x[:, order].astype(kind)
    best, which, work = None, np.zeros(len(x), np.int32), 0
    for number, centroid in enumerate(centroids):
        c = np.array([centroid[d] for d in order], dtype=kind)
        live, total = np.arange(len(x)), np.zeros(len(x), kind)
        for at in range(0, len(order), STEP):
            part = x[live, at : at + STEP] - c[at : at + STEP]
            work += part.size
            total = total + (part * part).sum(axis=1)
            if best is not None:
                still = (total <= best[live]).astype(bool)
                live, total = live[still], total[still]
        if best is None:
            best = total
            continue
        nearer = (total < best[live]).astype(bool)
        best[live[nearer]], which[live[nearer]] = total[nearer], number
    return which, best, work


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of `seed:vec_id`, in that order (null ids last, equal ids by their vector)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = rows.select(h.alias("h"), "embedding").orderBy(F.col("h").asc_nulls_last(), "embedding").limit(clusters).collect()
    return [[int(v) for v in np.floor(np.array(r.embedding, dtype=np.float64) * SCALE)] for r in got]


def cluster_sums(rows: DataFrame, size: int, centroids: list[list[int]], order: list[int]) -> dict[int, tuple[int, list[int]]]:
    """Number -> (vectors, sums by dimension) of the centroids that are some vector's nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * len(centroids), [[0] * size for _ in centroids]
        for batch in batches:
            x = scaled(batch.column("embedding"), size)
            which, _, _ = assign(x, centroids, order)
            x = exact(x, max(1, len(x)))
            for k in np.unique(which):
                mine = x[which == k]
                count[k] += len(mine)
                total[k] = [a + int(b) for a, b in zip(total[k], mine.sum(axis=0))]
        some = [k for k, c in enumerate(count) if c]
        cells = [(k, d, count[k], decimal.Decimal(total[k][d])) for k in some for d in range(size)]
        cols = list(zip(*cells)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)))], names=["k", "d", "m", "s"])

    got = rows.select("embedding").mapInArrow(run, "k int, d int, m long, s decimal(38,0)").groupBy("k", "d").agg(F.sum("m").alias("m"), F.sum("s").alias("s")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(got):
        out.setdefault(r.k, (r.m, []))[1].append(int(r.s))
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector of `size` entries.

    vectors (vec_id, embedding); entries count as floor(1024 * c). distance: squared, to the vector's final centroid. Distances
    and their sums that are no long (entries beyond some 10 ** 5) are null. Fewer vectors than clusters: as many centroids as
    vectors. Vectors that are null, of another size or hold null or non-finite entries drop out. Null vec_id: takes part, last among the
    candidates for a first centroid. Repeated rows: each counts. Ties: the smaller number. Empty table: no rows. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, size), "cluster-rows")
    centroids = first_centroids(rows, clusters, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    spread = rows.agg(*[F.var_pop(F.col("embedding")[d].cast("double")) for d in range(size)]).first()
    order = sorted(range(size), key=lambda d: (-spread[d], d))
    for _ in range(rounds):
        for k, (m, sums) in cluster_sums(rows, size, centroids, order).items():
            centroids[k] = [s // m for s in sums]
    final = list(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, best, _ = assign(scaled(batch.column("embedding"), size), final, order)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(which), longs(best)], names=["vec_id", "cluster", "distance"])

    done = materialize(rows.mapInArrow(run, "vec_id long, cluster int, distance long"), "clustered")
    # a row for each cluster; a distance that is no long makes its sums null
    whole = lambda s: F.when(F.count("distance") == F.count("*"), s)
    sums = {r.cluster: r.s for r in done.groupBy("cluster").agg(whole(F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()}
    total = None if None in sums.values() else sum(sums.values())
    fits = lambda v: None if v is None or v >= 1 << 63 else int(v)
    said = [(k, fits(v), fits(total), hashlib.sha256(",".join(map(str, final[k])).encode()).hexdigest()) for k, v in sums.items()]
    facts = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED) -> str:
    """The clustering as DuckDB SQL over `embeddings` (unique vec_id), every distance in full."""
    near = "(SELECT vec_id, arg_min(k, (dist, k)) AS k, min(dist) AS dist FROM (SELECT vec_id, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS dist FROM v, c{r}) GROUP BY 1)"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * e::DOUBLE) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: isfinite(e))) = {size})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INT) AS k, x AS c FROM v QUALIFY k < {clusters})",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED {near.format(r=r)}",
            f"s{r} AS (SELECT k, d, CAST(sum(e) AS BIGINT) AS s, count(*) AS m FROM (SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS d FROM a{r} JOIN v USING (vec_id)) GROUP BY 1, 2)",
            f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(t.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT k, list((s - ((s % m) + m) % m) // m ORDER BY d) AS c FROM s{r} GROUP BY 1) t ON t.k = c{r}.k)",
        ]
    steps.append(f"z AS MATERIALIZED {near.format(r=rounds)}")
    return f"WITH {', '.join(steps)} SELECT vec_id, CAST(z.k AS INT) AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY z.k) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM z JOIN c{rounds} ON c{rounds}.k = z.k"
