"""The documents' vectors against numpy's decomposition of the whole matrix."""

import numpy as np
from pyspark.sql import functions as F

from brieflake.operators import latent as L


def texts():
    rng = np.random.default_rng(1)
    topics = [[f"{t}{i}" for i in range(15)] for t in "abcde"]
    docs = [(i, " ".join(rng.choice(topics[i % 5], size=int(rng.integers(3, 40))))) for i in range(120)]
    return docs + [(500, None), (501, ""), (502, "A0 a1 A1 a0"), (503, " ".join(f"u{i}" for i in range(400)) * 3)]


def test_against_the_whole_decomposition(spark, monkeypatch):
    monkeypatch.setattr(L, "ENTRIES", 50)
    docs = texts()
    df = spark.createDataFrame(docs, "doc_id long, content string").repartition(5)
    model = L.Latent(df, rank=6, columns=256, passes=12, extra=10)
    cols = {r.doc_id: list(r.c) for r in df.select("doc_id", L.buckets(F.col("content"), 256).alias("c")).collect()}
    a = np.zeros((len(docs), 256))
    for row, (i, _) in enumerate(docs):
        for c in cols[i]:
            a[row, c] += 1
    a = np.where(a > 0, (1 + np.log(np.maximum(a, 1))) * (np.log((len(docs) + 1) / ((a > 0).sum(axis=0) + 1)) + 1), 0)
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    a = a / np.where(norm > 0, norm, 1)
    u, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.values, s[:6], rtol=1e-5)
    assert np.allclose(model.basis @ model.basis.T, v[:6].T @ v[:6], atol=2e-3)
    best = np.linalg.norm(a - a @ v[:6].T @ v[:6])
    assert np.linalg.norm(a - a @ model.basis @ model.basis.T) < best * (1 + 1e-6)
    got = {r.doc_id: np.array(r.embedding) for r in model.embed(df).collect()}
    assert len(got) == len(docs) and not got[500].any() and not got[501].any()
    want = a @ model.basis
    for row, (i, _) in enumerate(docs):
        if i < 500:
            assert np.allclose(got[i], want[row] / np.linalg.norm(want[row]), atol=1e-9)
    near = [i for i in range(120) if got[502] @ got[i] > 0.9]
    assert near and all(i % 5 == 0 for i in near)


def test_none_and_one(spark):
    none = L.Latent(spark.createDataFrame([], "doc_id long, content string"), rank=3, columns=16)
    assert len(none.values) == 0
    one = L.Latent(spark.createDataFrame([(1, "a b")], "doc_id long, content string"), rank=3, columns=16)
    assert len(one.values) == 1 and abs(one.values[0] - 1) < 1e-9


def test_texts_are_read_once(spark, monkeypatch):
    """The fitted documents' vectors come from the written rows, no more tasks send sums than there are cores, and few queries take one scan."""
    from brieflake.operators import neighbours as N

    df = spark.createDataFrame(texts(), "doc_id long, content string").repartition(40)
    model = L.Latent(df, rank=6, columns=256)
    want = {r.doc_id: r.embedding for r in model.embed(df).collect()}
    monkeypatch.setattr(L, "buckets", None)
    vectors = model.vectors()
    got = {r.doc_id: r.embedding for r in vectors.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-12) for i in want)
    assert L._few(df).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    table = vectors.withColumnRenamed("doc_id", "vec_id").withColumn("tag", F.lit("t")).repartition(7)
    asked = vectors.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    far = N.Neighbours(table, asked, 5).topk().orderBy("query_id", "rank").collect()
    monkeypatch.setattr(N, "Neighbours", None)
    assert N.nearest(table, asked, 5).orderBy("query_id", "rank").collect() == far and len(far) == 5 * asked.count()
