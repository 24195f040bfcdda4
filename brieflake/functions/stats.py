"""Tail probabilities, plain Python: of a few rows on the driver, or of a row a group in a worker."""

from __future__ import annotations

import functools
import math

import numpy as np


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided p of k successes in n fair trials."""
    if n == 0:
        return 1.0
    low = min(k, n - k)
    tail = sum(math.comb(n, i) for i in range(low + 1)) / 2**n
    return min(1.0, 2 * tail) if 2 * low != n else 1.0


def chi2_tail_1df(x: float) -> float:
    return math.erfc(math.sqrt(x / 2)) if x > 0 else 1.0


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / (c if abs(c) > tiny else tiny)
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t)) if df > 0 else 1.0


#: Sample size up to which the signed-rank test is exact, and each size up to which the two-sample test is.
WILCOXON_EXACT = 50
KS_EXACT = 10_000


@functools.cache
def signed_rank_counts(n: int) -> list[int]:
    """How many of the 2**n sign vectors give each rank sum 0 .. n (n + 1) / 2 (no ties)."""
    counts = [1]
    for rank in range(1, n + 1):
        longer = counts + [0] * rank
        for total, c in enumerate(counts):
            longer[total + rank] += c
        counts = longer
    return counts


def wilcoxon_two_sided(w_plus: float, w_minus: float, n: int, tie_term: float, zeros: int = 0) -> float:
    """p of the signed-rank test: exact for up to WILCOXON_EXACT differences without ties or zeros, else by the normal
    approximation. tie_term: sum of t**3 - t over tied groups."""
    if n == 0:
        return 1.0
    low = min(w_plus, w_minus)
    if n <= WILCOXON_EXACT and not tie_term and not zeros:
        return min(1.0, 2 * sum(signed_rank_counts(n)[: int(low) + 1]) / 2**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48)
    return normal_two_sided((low - n * (n + 1) / 4) / sd) if sd > 0 else 1.0


def ks_exact(d: float, n: int, m: int) -> float:
    """Share of the interleavings of n and m values whose distributions are d or more apart somewhere.

    Going through a common order, after t values of which i are of the first sample, that share is 1 where the two are so far apart,
    else the mean of the shares before, weighted by which sample the t-th value came from. Only sums of positive numbers.
    """
    whole = math.lcm(n, m)
    apart = round(d * whole)
    share = np.zeros(n + 1)
    share[0] = float(apart <= 0)
    for t in range(1, n + m + 1):
        i = np.arange(max(0, t - m), min(n, t) + 1)
        came = np.where(i > 0, share[i - 1] * i, 0.0) + np.where(i < t, share[i] * (t - i), 0.0)
        out = np.abs(i * (whole // n) - (t - i) * (whole // m)) >= apart
        share[i] = np.where(out, 1.0, came / t)
    return float(share[n])


def ks_limit(d: float, n: int, m: int) -> float:
    """Kolmogorov's limit, at an argument corrected for the sizes."""
    size = round(n * m / (n + m))
    x = d * math.sqrt(size)
    x += 1 / (6 * math.sqrt(size)) + (x - 1) / (4 * size)
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_two_sided(d: float, n: int, m: int) -> float:
    """p of the two-sample statistic: exact up to KS_EXACT values a sample."""
    if not n or not m or d <= 0:
        return 1.0
    return ks_exact(d, n, m) if max(n, m) <= KS_EXACT else ks_limit(d, n, m)
