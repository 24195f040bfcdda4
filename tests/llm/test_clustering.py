import hashlib
import math

import duckdb
import numpy as np

from brieflake.llm import clustering as C

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, k int"


def brute(rows, clusters=8, rounds=10, size=64, seed=3):
    """The contract in plain Python: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centroids = [x for _, x in sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else digest(r[0]), r[1]))[:clusters]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min((far(x, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        mine = {}
        for _, x in kept:
            mine.setdefault(nearest(x)[1], []).append(x)
        for k, xs in mine.items():
            centroids[k] = [sum(col) // len(xs) for col in zip(*xs)]
    out = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = {}
    for _, k, d in out:
        inertia[k] = inertia.get(k, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, k, d, inertia[k], sum(inertia.values()), sha[k]) for i, k, d in out], key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], SCHEMA).repartition(4)
    return sorted([tuple(r) for r in C.cluster(df, **kw).collect()], key=str)


def test_against_plain_python(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) * 0.1 + (i % 5) * 0.2).astype(np.float32).tolist()) for i in range(150)]
    rows += [(500, rows[0][1])] * 40 + [(None, rows[1][1]), (7, rows[2][1])]
    rows += [(600, None), (601, [1.0] * 63), (602, [None] + [1.0] * 63), (603, [float("nan")] * 64), (604, [float("-inf")] * 64), (605, [])]
    assert run(spark, rows) == brute(rows)


def test_ties_few_vectors_and_none(spark):
    same = [(i, [0.25] * 64) for i in range(12)]
    got = run(spark, same, rounds=3)
    assert got == brute(same, rounds=3) and {r[1] for r in got} == {0}
    few = [(1, [0.0] * 64), (2, [1.0] * 64), (None, [0.5] * 64)]
    assert run(spark, few, rounds=3) == brute(few, rounds=3)
    assert run(spark, [(1, None)]) == [] and run(spark, []) == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e9 * (i % 3)] * 32 + [float(i)] * 32) for i in range(20)]
    got, want = run(spark, rows, clusters=3, rounds=2), brute(rows, 3, 2)
    assert [r[:2] + r[5:] for r in got] == [r[:2] + r[5:] for r in want]
    assert all(a == (b if b < 1 << 63 else None) for g, w in zip(got, want) for a, b in zip(g[2:5], w[2:5]))


def test_search_gives_up_early_and_is_exact():
    rng = np.random.default_rng(8)
    spread = 5 * 0.85 ** np.arange(64)
    x = np.floor(rng.normal(size=(400, 64)) * spread * 200).astype(np.int64)
    centroids = [list(map(int, r)) for r in x[:8]]
    which, best, work = C.assign(x, centroids, list(range(64)))
    full = ((x[:, None, :] - np.array(centroids)) ** 2).sum(axis=2)
    assert (which == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert work < 0.6 * 400 * 8 * 64


def test_against_sql(spark, sf):
    got = sorted(tuple(r) for r in C.cluster(spark.read.parquet(f"{sf}/embeddings.parquet")).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(c.execute(C.oracle_sql()).fetchall())
