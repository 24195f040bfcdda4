"""The stored index and the neighbour search against brute force."""

import math
from collections import Counter

import numpy as np
import pytest

from brieflake.operators import index as IX
from brieflake.operators import neighbours as N
from brieflake.operators import postings as PO
from brieflake.operators import retrieval as R


def bm25(docs, queries, k):
    """Okapi scores in plain Python: (query_id, rank, doc_id, score)."""
    words = {i: (t or "").split() for i, t in docs.items()}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if v < 0 else v for w, v in raw.items()}
    out = []
    for q, text in queries.items():
        scores = {i: round(sum(idf.get(w, 0) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in text.split()), 9) + 0.0 for i, ws in words.items()}
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def close(got, want):
    return [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-8 for a, b in zip(got, want))


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, content string")


def asked(spark, queries):
    return spark.createDataFrame(list(queries.items()), "query_id long, query string")


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    word = lambda: f"t{int(rng.zipf(1.5)) % 300}"
    docs = {i: " ".join(word() for _ in range(int(rng.integers(1, 40)))) for i in range(400)}
    docs |= {1000 + i: "rare gem " * (i + 1) + "t1 " * 20 for i in range(6)} | {2000: None, 2001: "  ", 2002: "x\ty\n z"}
    return docs, {0: "rare gem t1", 1: "t1 t2 t3 t2", 2: "nowhere", 3: "z rare", 4: "", 5: "t7"}


@pytest.mark.parametrize("way", ["index", "at once"])
def test_negative_scores_give_way_to_documents_without_a_hit(spark, tmp_path, way):
    docs = {**{i: "a b" for i in range(6)}, 7: "c"}
    q = asked(spark, {0: "a"})
    if way == "index":
        IX.upsert(frame(spark, docs), str(tmp_path / "i"))
        got = IX.search(spark, str(tmp_path / "i"), q, 3)
    else:
        got = R.bm25_topk(frame(spark, docs), q, 3)
    got = sorted(tuple(r) for r in got.collect())
    assert [r[2] for r in got] == [7, 0, 1] and close(got, bm25(docs, {0: "a"}, 3))


def test_index_through_its_life(spark, tmp_path, corpus, monkeypatch):
    monkeypatch.setattr(IX, "BLOCK", 16)
    docs, queries = corpus
    path, q = str(tmp_path / "index"), asked(spark, queries)
    assert IX.search(spark, path, q).count() == 0 and IX.listing(spark, path).count() == 0
    draft = {i: (t if i % 2 else f"draft t1 {t}") for i, t in docs.items()}
    IX.upsert(frame(spark, draft), path)
    IX.upsert(frame(spark, {i: t for i, t in docs.items() if i % 2 == 0}), path)
    search = IX.Search(spark, path, q, 7)
    got = sorted(tuple(r) for r in search.topk().collect())
    assert close(got, bm25(docs, queries, 7))
    assert search.read < search.postings
    again = IX.upsert(frame(spark, dict(list(docs.items())[:9])), path)
    assert again.n == len(docs) and again.version == 3 and len(again.segments) == 3
    want = Counter(w for t in docs.values() for w in set((t or "").split()))
    assert {r.term: r.df for r in IX.vocabulary(spark, path).collect()} == want
    one = IX.compact(spark, path)
    assert len(one.segments) == 1 and one.n == len(docs) and abs(one.mean_idf - again.mean_idf) < 1e-12
    assert close(sorted(tuple(r) for r in IX.search(spark, path, q, 7).collect()), bm25(docs, queries, 7))
    gone = [1000, 1001, 3, 99999]
    IX.remove(spark.createDataFrame([(i,) for i in gone], "doc_id long"), path)
    rest = {i: t for i, t in docs.items() if i not in gone}
    assert close(sorted(tuple(r) for r in IX.search(spark, path, q, 7).collect()), bm25(rest, queries, 7))
    assert IX.listing(spark, path).first().version == 5


def near(rows, queries, k):
    out = []
    for q, v in queries:
        d = sorted((round(float(((np.array(x, float) - np.array(v, float)) ** 2).sum()), 9), i) for i, _, x in rows)[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(d)]
    return sorted(out)


def test_neighbours_prune_and_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 20)
    monkeypatch.setattr(N, "ROWS", 30)
    monkeypatch.setattr(N, "QUERIES", 4)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 10
    rows = [(i, i % 7, (centres[i % 12] + rng.normal(size=8) * 0.3).astype(np.float32).tolist()) for i in range(500)]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(200)]
    queries = [(i, v) for i, _, v in rows[::25]] + [(5000, [100.0] * 8)]
    bad = [(9000, 1, None), (9001, 1, [1.0]), (9002, 1, [None] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, term int, embedding array<float>")
    search = N.Neighbours(df, spark.createDataFrame(queries + [(6000, None), (6001, [1.0])], "query_id long, q array<float>"), 9)
    got = search.topk()
    assert close(sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in got.collect()), near(rows, queries, 9))
    assert {r.vec_id: r.term for r in got.collect()}.items() <= {i: t for i, t, _ in rows}.items()
    assert search.compared < 0.7 * search.pairs
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_neighbours_of_few_and_none(spark):
    df = spark.createDataFrame([(2, [0.0, 1.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [0.0, 1.0])], "query_id long, q array<double>")
    assert [(r.vec_id, r.rank, r.distance) for r in N.nearest(df, q, 5).orderBy("rank").collect()] == [(1, 1, 0.0), (2, 2, 0.0)]
    assert N.nearest(df.filter("false"), q, 5).count() == 0 and N.nearest(df, q.filter("false"), 5).count() == 0


def stored(spark, path):
    return IX.pages(spark, IX.state(spark, path))


def test_documents_are_replaced_page_by_page(spark, tmp_path, corpus, monkeypatch):
    """Rows are pages, not blocks; what is replaced leaves them where they are read: nothing of a segment is shuffled."""
    monkeypatch.setattr(IX, "BLOCK", 64)
    docs, queries = corpus
    path, plans = str(tmp_path / "index"), []
    IX.upsert(frame(spark, {i: f"draft {t}" for i, t in docs.items()}), path)
    write = IX._write
    monkeypatch.setattr(IX, "_write", lambda table, at: plans.append(table._jdf.queryExecution().executedPlan().toString()) or write(table, at))
    IX.upsert(frame(spark, {i: t for i, t in docs.items() if i % 2}), path)
    monkeypatch.setattr(IX, "_write", write)
    assert len(plans) == 2 and "MapInArrow" in plans[0] and not any(x in plans[0] for x in ("hashpartitioning", "rangepartitioning", "SortMergeJoin"))
    slots = sum(n for _, n in IX.state(spark, path).segments)
    rows = stored(spark, path).count()
    assert rows <= slots * (PO.PAGES + 1) < IX.headers(stored(spark, path)).count()
    want = Counter(w for i, t in docs.items() for w in set((t or "").split()) | (set() if i % 2 else {"draft", "None"} if t is None else {"draft"}))
    assert {r.term: r.df for r in IX.vocabulary(spark, path).collect()} == want


def test_statistics_are_counted_once_and_when_asked_for(spark, tmp_path, corpus, monkeypatch):
    docs, _ = corpus
    path, counted, count = str(tmp_path / "index"), [], IX.document_frequencies
    monkeypatch.setattr(IX, "document_frequencies", lambda heads: counted.append(1) or count(heads))
    some = dict(list(docs.items())[:60])
    IX.upsert(frame(spark, {i: f"draft {t}" for i, t in some.items()}), path)
    again = IX.upsert(frame(spark, some), path)
    assert again.n == len(some) and not counted
    rows = [IX.listing(spark, path).collect() for _ in range(2)]
    assert len(counted) == 1 and rows[0] == rows[1]
    df = Counter(w for t in some.values() for w in set((t or "").split()))
    assert rows[0][0].vocabulary == len(df) and rows[0][0].total_length == sum(len((t or "").split()) for t in some.values())
    assert abs(rows[0][0].mean_idf - np.mean([math.log(len(some) - c + 0.5) - math.log(c + 0.5) for c in df.values()])) < 1e-9


@pytest.mark.parametrize("kind", ["long", "string"])
def test_compact_merges_pages(spark, tmp_path, corpus, monkeypatch, kind):
    """Slots become one page by page, not term by term, and no statistics are counted for it."""
    monkeypatch.setattr(IX, "BLOCK", 64)
    docs = dict(list(corpus[0].items())[:150]) | {2000: None, 2002: "x\ty\n z"}
    path, plans, write = str(tmp_path / "index"), [], IX._write
    every = frame(spark, docs).withColumn("doc_id", R.F.col("doc_id").cast(kind))
    IX.upsert(every, path)
    IX.upsert(every.filter("cast(doc_id as long) % 2 = 1"), path)
    before = {(b.term, p.id): (p.tf, p.len) for b in IX.blocks(stored(spark, path)).collect() for p in b.postings}
    monkeypatch.setattr(IX, "_write", lambda table, at: plans.append(table._jdf.queryExecution().executedPlan().toString()) or write(table, at))
    assert len(IX.compact(spark, path).segments) == 1
    assert IX.pages(spark, IX.state(spark, path)).select("slot", "page").distinct().count() == stored(spark, path).count()
    assert len(plans) == 1 and "FlatMapGroupsInArrow" in plans[0] and "collect_list" not in plans[0]
    assert not (tmp_path / "index" / "statistics").exists()
    got = [(b.term, [p.id for p in b.postings]) for b in IX.blocks(stored(spark, path)).collect()]
    assert all(ids == sorted(ids) for _, ids in got) and max(len(ids) for _, ids in got) > 16
    assert {(b.term, p.id): (p.tf, p.len) for b in IX.blocks(stored(spark, path)).collect() for p in b.postings} == before
    heads = {(h.slot, h.term): (h.n, h.max_tf, h.min_len) for h in IX.headers(stored(spark, path)).collect()}
    assert heads == {(b.slot, b.term): (len(b.postings), max(p.tf for p in b.postings), min(p.len for p in b.postings)) for b in IX.blocks(stored(spark, path)).collect()}
    assert {r.doc_id for r in IX.documents(spark, IX.state(spark, path)).collect()} == {i if kind == "long" else str(i) for i in docs}
