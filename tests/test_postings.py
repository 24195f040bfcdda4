"""Blocks of postings and their best lists against plain Python."""

from collections import Counter

import pytest

from brieflake.operators import postings as PO
from brieflake.operators import retrieval as R

DOCS = [(i, f"a b w{i % 7} " * (1 + i % 3) + "\x0bz\x1cz z", "de" if i % 4 == 0 else "en" if i % 4 < 3 else None) for i in range(200)] + [(900, None, "en"), (901, " \n", None), (902, "", "de"), (903, "b", "fr")]
ASKED = [(0, "a b"), (1, "w3 w3 z\x1cz z"), (2, "nowhere"), (3, "b w5")]


@pytest.fixture
def few(monkeypatch):
    """Slots, parts and pieces so small that there are many."""
    monkeypatch.setattr(R, "SLOT", 16)
    monkeypatch.setattr(PO, "QUERIES", 2)


def test_best_of_types_is_cut_in_each_slot(spark, few):
    docs = spark.createDataFrame(DOCS, "doc_id long, content string, type string").repartition(3)
    queries = spark.createDataFrame(ASKED, "query_id long, query string")
    index = R.Index(docs, queries, by=("type",))
    got = {(r.query_id, r.type, r["rank"]): (r.doc_id, r.score) for r in index.best(5).collect()}
    type_of = {i: t for i, _, t in DOCS}
    want, lists = {}, {}
    for r in index.scores().collect():
        lists.setdefault((r.query_id, type_of[r.doc_id]), []).append((-round(r.score, 9), r.doc_id))
    for key, hits in lists.items():
        want |= {(*key, n + 1): (i, -s) for n, (s, i) in enumerate(sorted(hits)[:5])}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in got)
    assert index.n == len(DOCS)
    # what leaves the tasks: at most 5 for each query and slot, not each hit
    rows = index.blocks.join(PO.asks(index.asked, 4), "term").drop("term")
    mean = index.mean_len
    sent = PO.best(rows, ["type", "slot"], lambda tf, length: R.impact(tf, length, mean), 5, 9)
    most = sent.groupBy("query_id", "type", "slot").count().agg({"count": "max"}).first()[0]
    assert most == 5 and sent.count() < 0.7 * sum(map(len, lists.values()))
    plan = index.best(5)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan


def test_counts_are_those_of_the_tokens(spark, monkeypatch):
    monkeypatch.setattr(PO, "BYTES", 40)
    docs = spark.createDataFrame(DOCS, "doc_id long, content string, type string").coalesce(2)
    got = {r.term: (r.df, r.len, r.texts) for r in PO.term_counts(docs).groupBy("term").agg(*[R.F.sum(c).alias(c) for c in ("df", "len", "texts")]).collect()}
    words = docs.select("doc_id", R.tokens(R.F.col("content")).alias("w")).collect()
    df = Counter(t for r in words for t in set(r.w or []))
    assert {t: v[0] for t, v in got.items() if t is not None} == df
    assert got[None] == (len(DOCS), sum(len(r.w or []) for r in words), len(DOCS) - 1)
    posted = {(b.term, p.id): (p.tf, p.len) for b in PO.term_blocks(docs, 7).collect() if b.term is not None for p in b.postings}
    assert posted == {(t, r.doc_id): (n, len(r.w)) for r in words if r.w for t, n in Counter(r.w).items()}


def test_joins_with_texts_shuffle_none(spark, sf):
    """The best lists are a broadcast side: the texts stay where they are read."""
    from brieflake.plans import retrieval_queries as Q

    plan = Q.rerank_lexical(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_slots_stay_bounded_and_headers_true(spark, tmp_path, monkeypatch):
    from brieflake.operators import index as IX

    monkeypatch.setattr(IX, "BLOCK", 16)
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(i, t) for i, t, _ in DOCS], "doc_id long, content string")

    def checked(at):
        found = IX.blocks(spark, at).collect()
        assert all(b.n == len(b.postings) and b.max_tf == max(p.tf for p in b.postings) and b.min_len == min(p.len for p in b.postings) and [p.id for p in b.postings] == sorted(p.id for p in b.postings) for b in found)
        slots = [b.n for b in found if b.term is None]
        assert sum(slots) == at.n
        return slots

    first = checked(IX.upsert(docs, path))
    assert max(first) <= 16 and len(first) > len(DOCS) // 16
    checked(IX.upsert(docs.filter("doc_id % 3 = 0"), path))
    checked(IX.remove(docs.filter("doc_id % 2 = 1"), path))
    last = checked(IX.compact(spark, path))
    assert max(last) < 32 and len(last) < len(first)
