"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, results merged.

Equal vectors are one node; of its ids only the KEEP smallest can be in an answer and are kept, so a vector that
holds a large part of the rows is no hot group. Nodes go by hash into shards of about SHARD nodes, fewer where they
would exceed SHARD_BYTES (a shard holds one vector length): both are memory bounds of a task, to be raised with the
executors' memory, as each query visits every shard. A shard's graph is stored as flat arrays of neighbour numbers: layer 0 as nodes
x 2M, each upper layer as its nodes and their M neighbours; -1 is empty. Every row is indexed.

Graphs are walked in float32, each shard's vectors scaled by their largest component, so that none overflows; answers are
ranked by the distances of the original vectors in double precision. A query beyond the shard's scale is compared
with all of its vectors.

A query is searched in every shard of its vector length. Queries go in blocks of about QUERY_BYTES, so a task holds
one shard's graph and one block.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brieflake.llm.common import materialize

SHARD = 32_768
SHARD_BYTES = 128 << 20
M = 16
EF_BUILD = 80
EF_SEARCH = 160
QUERY_BYTES = 8 << 20
#: A query this many times larger than a shard's largest component isn't told from its neighbours in float32.
FAR = 1e4


class Graph:
    """The graph of one shard over float32 rows; distances are squared Euclidean."""

    def __init__(self, vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 7):
        self.v, self.m, self.ef = np.ascontiguousarray(vectors, np.float32), m, ef
        n = len(vectors)
        self.level = np.minimum(16, (-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(m)).astype(int))
        self.near = [np.full((n, 2 * m), -1, np.int32)]
        self.dist = [np.full((n, 2 * m), np.inf, np.float32)]
        self.nodes: list[np.ndarray] = [np.arange(n, dtype=np.int32)]
        self.place: list[np.ndarray] = [np.arange(n, dtype=np.int32)]
        for layer in range(1, int(self.level.max(initial=0)) + 1):
            nodes = np.flatnonzero(self.level >= layer).astype(np.int32)
            place = np.full(n, -1, np.int32)
            place[nodes] = np.arange(len(nodes))
            self.nodes.append(nodes)
            self.place.append(place)
            self.near.append(np.full((len(nodes), m), -1, np.int32))
            self.dist.append(np.full((len(nodes), m), np.inf, np.float32))
        self.seen, self.stamp = np.zeros(n, np.int64), 0
        self.entry = -1
        for i in range(n):
            self._insert(i)

    def _search(self, q: np.ndarray, start: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        self.stamp += 1
        seen, stamp, near, place, v = self.seen, self.stamp, self.near[layer], self.place[layer], self.v
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        todo = list(start)
        heapq.heapify(todo)
        for _, i in start:
            seen[i] = stamp
        while todo:
            d, i = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= ef:
                break
            row = near[place[i]]
            row = row[row >= 0]
            row = row[seen[row] != stamp]
            if not len(row):
                continue
            seen[row] = stamp
            diff = v[row] - q
            found = np.einsum("ij,ij->i", diff, diff)
            if len(best) >= ef:
                close = found < -best[0][0]
                row, found = row[close], found[close]
            for x, j in zip(found.tolist(), row.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (-x, j))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, j))
                else:
                    continue
                heapq.heappush(todo, (x, j))
        return sorted((-d, i) for d, i in best)

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[tuple[float, int]]:
        """Neighbours that are nearer to the new node than to a chosen one; the rest fills up."""
        if len(found) <= most:
            return found
        ids = np.array([i for _, i in found])
        v = self.v[ids]
        sq = np.einsum("ij,ij->i", v, v)
        apart = sq[:, None] + sq[None, :] - 2 * (v @ v.T)
        least = np.full(len(ids), np.inf, np.float32)
        taken, rest = [], []
        for k, (d, i) in enumerate(found):
            if d < least[k]:
                taken.append(k)
                if len(taken) == most:
                    break
                np.minimum(least, apart[k], out=least)
            else:
                rest.append(k)
        return [found[k] for k in taken + rest[: most - len(taken)]]

    def _link(self, layer: int, a: int, b: int, d: float) -> None:
        row, dist = self.near[layer][self.place[layer][a]], self.dist[layer][self.place[layer][a]]
        k = int(dist.argmax())
        if d < dist[k]:
            row[k], dist[k] = b, d

    def _insert(self, i: int) -> None:
        top = int(self.level[i])
        if self.entry < 0:
            self.entry = i
            return
        q = self.v[i]
        diff = self.v[self.entry] - q
        start = [(float(diff @ diff), self.entry)]
        highest = int(self.level[self.entry])
        for layer in range(highest, top, -1):
            start = self._search(q, start, 1, layer)
        for layer in range(min(top, highest), -1, -1):
            found = self._search(q, start, self.ef, layer)
            for d, j in self._choose(found, self.m):
                self._link(layer, i, j, d)
                self._link(layer, j, i, d)
            start = found
        if top > highest:
            self.entry = i

    def pack(self) -> dict:
        return {"entry": self.entry, "layers": [x.tobytes() for x in self.near], "nodes": [x.tobytes() for x in self.nodes]}

    @classmethod
    def unpack(cls, vectors: np.ndarray, entry: int, layers: list[bytes], nodes: list[bytes], m: int = M) -> Graph:
        g = cls.__new__(cls)
        n = len(vectors)
        g.v, g.entry, g.m = np.ascontiguousarray(vectors, np.float32), entry, m
        g.nodes = [np.frombuffer(x, np.int32) for x in nodes]
        g.near = [np.frombuffer(x, np.int32).reshape(len(k), -1) for x, k in zip(layers, g.nodes)]
        g.place = []
        for k in g.nodes:
            place = np.full(n, -1, np.int32)
            place[k] = np.arange(len(k))
            g.place.append(place)
        g.seen, g.stamp = np.zeros(n, np.int64), 0
        return g

    def query(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> list[int]:
        diff = self.v[self.entry] - q
        start = [(float(diff @ diff), self.entry)]
        for layer in range(len(self.near) - 1, 0, -1):
            start = self._search(q, start, 1, layer)
        return [i for _, i in self._search(q, start, max(ef, k), 0)]


def distances(exact: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; where the squares overflow or vanish, by scaled differences."""
    diff = exact - q
    with np.errstate(over="ignore", under="ignore"):
        d = np.sqrt((diff**2).sum(1))
    odd = ~np.isfinite(d) | (d < 1e-150)
    if odd.any():
        half = np.abs(exact[odd] / 2 - q / 2)
        most = half.max(1, keepdims=True)
        with np.errstate(invalid="ignore", over="ignore"):
            d[odd] = np.where(most[:, 0] > 0, 2 * (most[:, 0] * np.sqrt(((half / np.where(most > 0, most, 1)) ** 2).sum(1))), 0.0)
    return d


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: no null, zero or non-finite vectors, no null ids."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", v.alias("v")).filter("vec_id is not null and v is not null").filter(good).select("vec_id", "v")


def build_index(rows: DataFrame, keep: int, shard: int = SHARD, m: int = M, ef: int = EF_BUILD) -> DataFrame:
    """One row per shard: dim, shard, n, scale, exact (vectors), entry, layers, nodes, ids (the kept ids of each node)."""
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.dropDuplicates(["vec_id", "v"]).withColumn("r", F.row_number().over(same)).filter(F.col("r") <= keep)
    nodes = kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(nodes.select("ids", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("h")), "ann-nodes")
    # shards of each vector length, as many as its nodes need: a node takes its vector twice and its links
    most = F.greatest(F.lit(1.0), F.least(F.lit(float(shard)), F.lit(float(SHARD_BYTES)) / (12 * F.col("dim") + 16 * m)))
    shards = nodes.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / most).cast("long").alias("shards"))
    placed = nodes.join(shards, "dim").withColumn("shard", F.pmod("h", "shards").cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")  # an order that doesn't follow ids
        exact = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        scale = float(np.abs(exact).max())
        p = Graph((exact / scale).astype(np.float32), m, ef).pack()
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "n": [len(pdf)], "scale": [scale], "exact": [exact.tobytes()], "entry": [p["entry"]], "layers": [p["layers"]], "nodes": [p["nodes"]], "ids": [[x.tolist() for x in pdf["ids"]]]})

    # a task a shard, however small their data: building takes time, not space
    total = int(shards.agg(F.sum("shards")).first()[0] or 1)
    placed = placed.repartition(min(2 * total, 50_000), "dim", "shard")
    schema = "dim int, shard int, n int, scale double, exact binary, entry int, layers array<binary>, nodes array<binary>, ids array<array<long>>"
    return materialize(placed.groupBy("dim", "shard").applyInPandas(build, schema), "ann-index", row_group_bytes=16 << 20)


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """queries: (vec_id, v). query_id, rank, vec_id, score: the k nearest found, ties to the smaller vec_id."""
    asked_bytes = queries.agg(F.sum(8 * F.size("v") + 64)).first()[0] or 0
    blocks = max(1, -(-asked_bytes // query_bytes))
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    # new names on either side: both come from index and q
    shards = index.select(F.col("dim").alias("s_dim"), F.col("shard").alias("s_shard"))
    sent = q.join(shards, F.col("dim") == F.col("s_dim")).select("query_id", "q", F.col("s_dim").alias("q_dim"), F.col("s_shard").alias("q_shard"), F.col("block").alias("q_block"))
    asked = q.select(F.col("dim").alias("a_dim"), F.col("block").alias("a_block")).distinct()
    held = index.join(asked, F.col("dim") == F.col("a_dim")).drop("a_dim").withColumnRenamed("a_block", "block")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            r = left.iloc[0]
            n, dim = int(r["n"]), int(r["dim"])
            exact, scale = np.frombuffer(r["exact"], np.float64).reshape(n, dim), float(r["scale"])
            g = Graph.unpack((exact / scale).astype(np.float32), int(r["entry"]), list(r["layers"]), list(r["nodes"]))
            ids = r["ids"]
            for query_id, v in zip(right["query_id"].tolist(), right["q"]):
                v = np.asarray(v, np.float64)
                if np.abs(v).max() / scale > FAR:
                    near = np.argsort(distances(exact, v), kind="stable")[: k + 1]
                else:
                    near = g.query((v / scale).astype(np.float32), k + 1, ef)
                d = distances(exact[near], v)
                found = sorted({(float(x), int(i)) for x, node in zip(d, near) for i in ids[node] if i != query_id})
                out += [(query_id, i, x) for x, i in found[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = held.groupBy("dim", "shard", "block").cogroup(sent.groupBy("q_dim", "q_shard", "q_block")).applyInPandas(run, "query_id long, vec_id long, score double")
    # an id may stand for several vectors; its nearest counts
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, query_every: int = 100, k: int = 10, shard: int = SHARD, ef: int = EF_SEARCH) -> DataFrame:
    """The k nearest of every query (vec_id divisible by query_every) among all rows but its own.

    Vectors that are null, zero or hold null or non-finite components take no part, as query or candidate, nor do null
    ids. Vectors of another length than the query's are no candidates. Repeated rows: (vec_id, vector) counts once;
    an id with several vectors is a query with each of them and is found at its nearest. Fewer than k candidates: all.
    Empty table: no rows. Other columns are ignored.
    """
    rows = materialize(usable(vectors), "ann-rows")
    index = build_index(rows, keep=k + 1, shard=shard)
    queries = rows.filter(F.pmod("vec_id", F.lit(query_every)) == 0).dropDuplicates(["vec_id", "v"])
    return search(index, queries, k, ef)
