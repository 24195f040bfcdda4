import numpy as np

from brieflake.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def brute(rows, every, k):
    good = {}
    for vec_id, v, *_ in rows:
        if vec_id is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good.setdefault(vec_id, np.array(v, np.float32).astype(np.float64))
    out = {}
    for q, v in good.items():
        if q % every == 0:
            cand = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good.items() if i != q and len(w) == len(v))
            out[q] = cand[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32))
    vectors = (centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 32))).astype(np.float32)
    rows = [(i, v.tolist(), 1, 0.0) for i, v in enumerate(vectors)]
    want = brute(rows, 50, 10)
    got: dict = {}
    for r in A.nearest(spark.createDataFrame(rows, SCHEMA).repartition(6), query_every=50, shard=700).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11))
        assert [(s, i) for _, s, i in found] == sorted((s, i) for _, s, i in found)
        exact = {i: s for s, i in want[q]}
        hit += sum(i in exact for _, _, i in found)
        for _, s, i in found:
            assert abs(s - np.linalg.norm(vectors[q].astype(float) - vectors[i].astype(float))) < 1e-9
    assert hit / (10 * len(want)) > 0.97


def test_odd_rows(spark):
    hot = [0.5, 0.5, 0.0]
    rows = [(i, hot, 1, 0.0) for i in range(60)] + [(100, [0.5, 0.5, 0.1], 1, 0.0), (101, [1.0, 2.0], 1, 0.0), (200, [1.0, 2.5], 1, 0.0)]
    rows += [(300, None, 1, 0.0), (301, [0.0, 0.0, 0.0], 1, 0.0), (302, [1.0, None, 0.0], 1, 0.0), (303, [float("nan"), 1.0, 1.0], 1, 0.0), (304, [float("inf"), 1.0, 1.0], 1, 0.0), (305, [], 1, 0.0), (None, hot, 1, 0.0), (0, hot, 2, 0.0)]
    got: dict = {}
    for r in A.nearest(spark.createDataFrame(rows, SCHEMA)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert got == {0: [(i, 0.0) for i in range(1, 11)], 100: [(i, 0.1) for i in range(10)], 200: [(101, 0.5)]}


def test_empty(spark):
    assert A.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert A.nearest(spark.createDataFrame([(1, [1.0], 1, 0.0)], SCHEMA)).count() == 0


def test_components_of_any_size(spark):
    for unit in (1e50, 1e200, 1e-200):
        rows = [(k * 100, [k * unit, 1.0 if unit > 1 else unit], 1, 0.0) for k in range(1, 6)]
        df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
        got = {}
        for r in A.nearest(df).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score / unit))
        for k in range(1, 6):
            want = sorted((abs(k - j), 100 * j) for j in range(1, 6) if j != k)
            assert {i for i, _ in got[100 * k]} == {i for _, i in want} and np.allclose([x for _, x in got[100 * k]], [d for d, _ in want], rtol=1e-12)


def test_a_query_far_beyond_its_shard(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist(), 1, 0.0) for i in range(1, 400)] + [(1000, [1e60] * 8, 1, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    got = A.nearest(df, query_every=1000, shard=8).collect()
    assert len(got) == 10 and all(r.query_id == 1000 and r.score > 1e60 for r in got)


def test_recall_on_the_table(spark):
    """At least 0.9 of the exact ten nearest, at the shard size that queries use."""
    import pathlib

    folder = pathlib.Path("/root/testdata/sf0.1/embeddings.parquet")
    if not folder.exists():
        return
    table = spark.read.parquet(str(folder))
    rows = [(r.vec_id, list(r.embedding), 1, 0.0) for r in table.collect() if r.embedding is not None]
    want, hit, total = brute_matrix(rows, 100, 10), 0, 0
    for r in A.nearest(table).collect():
        hit += r.vec_id in want[r.query_id]
        total += 1
    assert total == sum(map(len, want.values())) and hit / total >= 0.95


def brute_matrix(rows, every, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = ((x - x[i]) ** 2).sum(1)
        d[ids == ids[i]] = np.inf
        out[int(ids[i])] = set(ids[np.lexsort((ids, d))[:k]].tolist())
    return out
