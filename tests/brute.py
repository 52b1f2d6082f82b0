"""Brute-force reference implementations used only by tests."""

import itertools
import math


def sign(v):
    return (v > 0) - (v < 0)


def mk_s(y):
    return sum(sign(y[j] - y[i]) for i, j in itertools.combinations(range(len(y)), 2))


def mk_var(y):
    n = len(y)
    from collections import Counter
    t = Counter(y).values()
    return (n * (n - 1) * (2 * n + 5) - sum(k * (k - 1) * (2 * k + 5) for k in t)) / 18


def pettitt(y):
    n = len(y)
    best, cp = -1, 0
    for k in range(1, n):
        u = sum(sign(y[j] - y[i]) for i in range(k) for j in range(k, n))
        if abs(u) > best:
            best, cp = abs(u), k
    p = min(1.0, 2 * math.exp(-2 * best ** 2 / (n ** 3 + n ** 2)))
    return cp, best, p


def sen(y, x=None):
    x = list(range(len(y))) if x is None else x
    sl = sorted((y[j] - y[i]) / (x[j] - x[i]) for i, j in itertools.combinations(range(len(y)), 2)
                if x[j] != x[i])
    m = len(sl)
    med = sl[m // 2] if m % 2 else (sl[m // 2 - 1] + sl[m // 2]) / 2
    return med, sl


def median(v):
    s = sorted(v)
    m = len(s)
    return s[m // 2] if m % 2 else (s[m // 2 - 1] + s[m // 2]) / 2


def percentile(v, p):
    s = sorted(v)
    h = (len(s) - 1) * p
    lo = math.floor(h)
    hi = math.ceil(h)
    return s[lo] + (h - lo) * (s[hi] - s[lo])
