import math
from collections import Counter, defaultdict

import numpy as np

from brieflake.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n int, component string, deviation double, w int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0.5, 2) for i, v in rows], SCHEMA)


def brute(vectors, k):
    """x, n, S, eigenvalues and vectors by numpy, deviations and trace in Python integers."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, s = len(x), [sum(col) for col in zip(*x)]
    centred = [[n * a - b for a, b in zip(row, s)] for row in x]
    y = np.array(centred, dtype=float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    deviations = [sum(c * c for c in row) for row in centred]
    return deviations, e[::-1][:k], v[:, ::-1][:, :k], y, sum(deviations) / n**3


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 12)) @ np.diag(np.linspace(0.05, 1, 12))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [1.0] * 11 + [float("inf")]), (904, [1.0, 2.0]), (905, []), (906, [1e30] * 12)]
    hot = [(None, vectors[0].tolist())] * 90
    got = W.whiten(table(spark, rows + bad + hot).repartition(5)).collect()
    deviations, e, v, y, trace = brute([r for _, r in rows] + [vectors[0]] * 90, 8)
    assert len(got) == 390 * 8 and {r.n for r in got} == {390}
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    assert len(by[None]) == 90 * 8
    assert all({r.deviation for r in by[i]} == {deviations[i]} for i, _ in rows)
    want = y @ v / np.sqrt(e)
    have = np.array([[r.whitened for r in sorted(by[i], key=lambda r: r.component)] for i, _ in rows])
    sign = np.sign((have * want[:300]).sum(axis=0))
    assert np.abs(have * sign - want[:300]).max() < 1e-9
    explained = {r.component: r.explained for r in got}
    assert all(abs(explained[c + 1] - e[c] / trace) < 1e-9 * e[c] / trace for c in range(8))
    assert {r.identity_error for r in got}.pop() < 1e-9


def test_rows_that_span_little(spark):
    line = [(i, [float(i), 2.0 * i, 0.5]) for i in range(20)]
    got = W.whiten(table(spark, line)).collect()
    assert {r.component for r in got} == {1} and len(got) == 20
    assert abs(got[0].explained - 1) < 1e-9 and got[0].identity_error < 1e-9
    assert W.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert W.whiten(table(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    empty = W.whiten(table(spark, [(1, None), (2, [])]))
    assert empty.count() == 0 and empty.columns == W.whiten(table(spark, line)).columns


def test_large_entries_stay_exact(spark):
    rows = [(0, [1e14, 1.0]), (1, [-1e14, 2.0]), (2, [3.0, 5.0])]
    got = {r.vec_id: r.deviation for r in W.whiten(table(spark, rows)).collect()}
    deviations, *_ = brute([r for _, r in rows], 2)
    assert got == {i: d if d < 1 << 63 else None for i, d in enumerate(deviations)} and None in got.values()


def test_table(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = W.whiten(t)
    counts = Counter(r.vec_id for r in got.select("vec_id").collect())
    assert set(counts.values()) == {8} and len(counts) == t.count()
    assert got.first().identity_error < 1e-9
