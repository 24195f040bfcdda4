"""p-values against the enumeration of all signs and all interleavings; the report in plain Python."""

import itertools
import math
import statistics

import pytest

from brieflake.functions import stats as S
from brieflake.operators import experiment as M


@pytest.mark.parametrize("n", range(1, 11))
def test_signed_ranks_over_all_signs(n):
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
    for w in range(n * (n + 1) // 2 + 1):
        other = n * (n + 1) // 2 - w
        want = min(1.0, 2 * sum(x <= min(w, other) for x in sums) / 2**n)
        assert S.wilcoxon_two_sided(w, other, n, 0.0) == pytest.approx(want, abs=1e-15)


def test_signed_ranks_where_exact_ends():
    assert S.wilcoxon_two_sided(21, 0, 6, 0.0) == 0.03125
    for tie, zeros in ((6.0, 0), (0.0, 2)):
        assert S.wilcoxon_two_sided(21, 0, 6, tie, zeros) != 0.03125
    near = [S.wilcoxon_two_sided(w, n * (n + 1) / 2 - w, n, 0.0) for n, w in ((50, 400), (51, 420))]
    assert abs(near[0] - S.normal_two_sided((400 - 637.5) / math.sqrt(50 * 51 * 101 / 24))) < 0.002 and 0 < near[1] < 1
    assert S.wilcoxon_two_sided(0, 0, 0, 0.0) == 1.0


@pytest.mark.parametrize("n, m", [(1, 1), (1, 5), (3, 4), (5, 5), (6, 4), (2, 7)])
def test_ks_over_all_interleavings(n, m):
    gaps = []
    for firsts in itertools.combinations(range(n + m), n):
        x = y = gap = 0
        for t in range(n + m):
            x, y = (x + 1, y) if t in firsts else (x, y + 1)
            gap = max(gap, abs(x * m - y * n))
        gaps.append(gap)
    for apart in sorted(set(gaps)):
        want = sum(g >= apart for g in gaps) / len(gaps)
        assert S.ks_two_sided(apart / (n * m), n, m) == pytest.approx(want, abs=1e-12)


def test_ks_of_large_samples():
    assert S.ks_two_sided(0.0, 5, 5) == 1.0 and S.ks_two_sided(0.5, 0, 5) == 1.0
    for d in (0.02, 0.04, 0.06):
        assert S.ks_limit(d, 3000, 2500) == pytest.approx(S.ks_exact(d, 3000, 2500), rel=0.05)
    assert S.ks_exact(1.0, 400, 300) == pytest.approx(2 / math.comb(700, 300), rel=1e-9)


def t_tail(t, df):
    """Two-sided, by Simpson's rule over the density."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    f = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)
    n, t = 4000, abs(t)
    h = t / n
    return 1 - 2 * h / 3 * (f(0) + f(t) + 4 * sum(f(h * i) for i in range(1, n, 2)) + 2 * sum(f(h * i) for i in range(2, n, 2)))


def test_full_report(spark):
    rows = []
    for i in range(9):
        for c, right, acc in zip("ABCD", (i % 3 == 0, i < 7, i != 2, i % 2 == 0), (i * i % 7 / 9, (i * 5 + 1) % 9 / 8.5, i / 10, 0.3)):
            rows.append((f"d{i}", "m", 1, c, i, right, acc, (i * (3 if c == "A" else 2) % 11) / 11, c in "BD", False))
    rows.append(("solo", "m", 1, "A", 50, True, 0.9, 0.93, False, False))
    r = spark.createDataFrame(rows, "docket string, llm_model string, replicate int, condition string, seq int, case_correct boolean, justice_accuracy double, average_confidence double, inject_spoiler boolean, spoiler_cited_in_reasoning boolean")
    got = {(x.test, x.pair, x.metric): x.value for x in M.full_report(r).collect()}
    by = {(x[0], x[3]): x for x in rows}
    want = {}
    for a, b, kinds in (("A", "B", 3), ("A", "C", 2), ("B", "D", 2), ("A", "D", 1)):
        pairs = [(by[k, a], by[k, b]) for k in sorted({x[0] for x in rows}) if (k, a) in by and (k, b) in by]
        lost, won = sum(x[5] and not y[5] for x, y in pairs), sum(y[5] and not x[5] for x, y in pairs)
        n = lost + won
        tail = sum(math.comb(n, i) for i in range(min(lost, won) + 1)) / 2**n if n else 1
        want |= {("mcnemar", f"{a}/{b}", "b"): lost, ("mcnemar", f"{a}/{b}", "c"): won, ("mcnemar", f"{a}/{b}", "p"): 1 if lost == won else min(1, 2 * tail)}
        if kinds > 1:
            d = [round(y[6] - x[6], 12) for x, y in pairs]
            mean, sd = statistics.mean(d), statistics.stdev(d)
            t = -mean / (sd / math.sqrt(len(d)))
            want |= {("paired_t", f"{a}/{b}", k): v for k, v in (("mean_diff", mean), ("t", t), ("cohens_d", mean / sd), ("p", t_tail(t, len(d) - 1)))}
            some = [x for x in d if x]
            rank = {x: statistics.mean(i + 1 for i, y in enumerate(sorted(map(abs, some))) if y == abs(x)) for x in some}
            plus, minus = sum(rank[x] for x in some if x > 0), sum(rank[x] for x in some if x < 0)
            ties = sum(c**3 - c for c in (list(map(abs, some)).count(v) for v in set(map(abs, some))))
            want |= {("wilcoxon", f"{a}/{b}", "w"): min(plus, minus), ("wilcoxon", f"{a}/{b}", "p"): S.wilcoxon_two_sided(plus, minus, len(some), ties, len(d) - len(some))}
        if kinds > 2:
            x, y = [z[7] for z in rows if z[3] == a], [z[7] for z in rows if z[3] == b]
            gap = max(abs(sum(v <= c for v in x) / len(x) - sum(v <= c for v in y) / len(y)) for c in x + y)
            want |= {("ks", f"{a}/{b}", "d"): gap, ("ks", f"{a}/{b}", "p"): S.ks_two_sided(gap, len(x), len(y))}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(float(v), abs=1e-7) for k, v in want.items())
