import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from brieflake.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, n int, target double"


def water(sizes, weights=M.WEIGHTS):
    """Targets by the wording: share by weight, cap, share the excess again."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        t = {s: 2.0 * sizes[s] for s in full} | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 2 * sizes[s]}
        if not over:
            return t
        full |= over


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), min_size=1, max_size=6), st.integers(0, 200))
def test_knapsack_is_optimal(hist, budget):
    lengths, counts = np.array(list(hist)), np.array(list(hist.values()))
    got = M.knapsack(lengths, counts, budget)
    best = max(t for c in itertools.product(*[range(n + 1) for n in counts]) if (t := int(np.dot(c, lengths))) <= budget)
    assert (got <= counts).all() and int((got * lengths).sum()) == best


def test_fit_of_a_large_budget_is_near():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 5000, 900))
    counts = rng.integers(1, 90, len(lengths))
    budget = int((lengths * counts).sum()) // 3
    got = M.fit(lengths, counts, budget, window=4096)
    assert (got <= counts).all() and (got * lengths).sum() == budget


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), min_size=1, max_size=5), st.integers(0, 300))
def test_small_sources_are_fitted_best(hist, target):
    lengths, counts = np.array(list(hist)), np.array(list(hist.values()))
    got = M.copies_by_length(lengths, counts, target)
    best = max(t for c in itertools.product(*[range(2 * n + 1) for n in counts]) if (t := int(np.dot(c, lengths))) <= target)
    assert (got <= 2 * counts).all() and int((got * lengths).sum()) == best


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "b", "B", None, "é"][min(4, int(rng.integers(0, 9)) // 2)], "x", 1, 0.5) for i in range(900)]
    rows += [(1000 + i, "one two three\x0b four", "hot", "x", 1, 0.5) for i in range(2000)] + [(5000, None, "a", "x", 1, 0.5), (5000, None, "a", "x", 1, 0.5), (5001, "", None, "x", 1, 0.5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = M.mix(df).collect()
    again = {(r.doc_id, r.source): r.taken for r in M.mix(df.repartition(3)).collect()}
    assert len(got) == len(rows)
    sizes, taken, goal = {}, {}, {}
    for r in got:
        assert r["size"] * 2 >= r.taken and (r["size"] == 0 or r.taken % r["size"] == 0)
        assert again[(r.doc_id, r.source)] == r.taken
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        goal[r.source] = (r.target, r.source_size)
    want = water(sizes)
    for s in sizes:
        assert goal[s][1] == sizes[s] and abs(goal[s][0] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= 4
    assert sizes["hot"] == 3 * 2000


def test_empty(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_columns_of_any_name_and_long_texts(spark):
    names = "doc_id long, text string, source string, copies int, p_no int, p_id long, p_source string, p_hash long, __h string, __r int, __no int, __copy int, row string, h string, no int"
    rows = [(i, f"w{i} " * (5 + i % 7), "a", 1, 2, 3, "s", 4, f"h{i}", 5, 6, 7, "r", "x", 8) for i in range(60)] + [(100, "long " * 300_000, "b", 1, 2, 3, "s", 4, "h100", 5, 6, 7, "r", "x", 8)]
    df = spark.createDataFrame(rows, names)
    got = M.apply_mix(df, most=2).collect()
    assert got and df.columns == M.apply_mix(df).columns
    own = {r[0]: r for r in rows}
    assert all(tuple(r) == own[r.doc_id] for r in got)
    sizes = {r.doc_id: r["size"] for r in M.mix(df).collect()}
    assert sizes[100] == 300_000


def test_buckets_change_no_choice(spark):
    df = spark.createDataFrame([(i, "one two three", "hot", "x", 1, 0.5) for i in range(500)] + [(1000 + i, "one two", "b", "x", 1, 0.5) for i in range(90)], SCHEMA)
    assert sorted(map(tuple, M.mix(df, buckets=2).collect())) == sorted(map(tuple, M.mix(df, buckets=1024).collect()))
