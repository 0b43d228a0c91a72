"""The chi-square distribution, for thresholds."""

from __future__ import annotations

import math


def cdf(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom <= x): the regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    log_first = a * math.log(z) - z - math.lgamma(a + 1)
    if z < a + 1:
        term = total = 1.0
        n = a
        while term > total * 1e-17:
            n += 1
            term *= z / n
            total += term
        return min(1.0, math.exp(log_first) * total)
    return 1.0 - tail(x, k)


def tail(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom > x), with full relative precision."""
    a, z = k / 2, x / 2
    if z < a + 1:
        return 1.0 - cdf(x, k)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (d_ if abs(d_ := an * d + b) > tiny else tiny)
        c = c_ if abs(c_ := b + an / c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return math.exp(a * math.log(z) - z - math.lgamma(a)) * h


def inverse(p: float, k: int, upper: bool = False) -> float:
    """x with cdf(x, k) = p, or with tail(x, k) = p."""
    lo, hi = 0.0, 1.0
    below = (lambda x: tail(x, k) > p) if upper else (lambda x: cdf(x, k) < p)
    while below(hi):
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) else (lo, mid)
    return hi
