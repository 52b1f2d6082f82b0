"""Numeric helpers on Columns: stable rounding and p-value math.

The distribution functions are written as native expressions (arithmetic,
``exp``, ``atan`` and higher-order ``aggregate`` over ``sequence``) so they
run on the JVM.  They are evaluated on *result* rows (one per series), never
on data rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def round_significant(c: Column | str, bits: int = 30) -> Column:
    """Round to ``bits`` binary digits (30: nine decimal digits) after the
    leading one, whatever the magnitude; scaling by powers of two is exact, so
    engines whose sums differ in the last bits agree afterwards."""
    c = F.col(c) if isinstance(c, str) else c
    scale = F.pow(F.lit(2.0), F.lit(float(bits)) - F.floor(F.log2(F.abs(c))))
    rounded = F.floor(c * scale + F.lit(0.5)).cast("double") / scale
    usual = F.abs(c).between(1e-280, 1e280)
    return F.when(usual, rounded).when(F.abs(c) < 1e-280, F.lit(0.0)).otherwise(c.cast("double"))


# Fixed value: standard normal 0.975 quantile, used for the 95 % Sen interval.
Z_975 = 1.959963984540054


def erfc(x: Column) -> Column:
    """Complementary error function to nearly full relative precision: the
    all-positive series of erf below 1.5, a continued fraction above."""
    z = F.abs(x)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("term"), z.alias("acc")),
        lambda s, k: F.struct((s["term"] * 2 * z * z / (2 * k + 1)).alias("term"),
                              (s["acc"] + s["term"] * 2 * z * z / (2 * k + 1)).alias("acc")))["acc"]
    below = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-z * z) * series
    fraction = F.aggregate(F.sequence(F.lit(200), F.lit(1)), z, lambda f, k: z + k / (2 * f))
    above = F.exp(-z * z) / (F.lit(math.sqrt(math.pi)) * fraction)
    ans = F.when(z < 1.5, below).otherwise(above)
    return F.when(x.isNull(), None).when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def normal_two_sided_p(z: Column) -> Column:
    """2·(1 − Φ(|z|)) = erfc(|z|/√2)."""
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def _gamma_ratio(a: Column) -> Column:
    """Γ(a + 1/2) / Γ(a): asymptotic at a + 48, then down by the recurrence."""
    def at_large(v: Column) -> Column:
        i, sum_ = F.lit(1.0) / v, F.lit(869 / 4194304)
        for c in (-399 / 262144, -21 / 32768, 5 / 1024, 1 / 128, -1 / 8, 1.0):
            sum_ = F.lit(c) + i * sum_
        return F.sqrt(v) * sum_
    return F.aggregate(F.sequence(F.lit(0), F.lit(47)), at_large(a + 48), lambda r, k: r * (a + k) / (a + k + 0.5))


#: Degrees of freedom from which the normal form of the Student tail is used.
LARGE_DF = 20_000


def student_t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided Student-t tail P(|T| > t) for df ≥ 1.

    The regularised incomplete beta I_x(df/2, 1/2), x = df/(df + t²), by its
    continued fraction with a fixed number of terms (evaluated from the back;
    on the side of x where it converges), so small tails keep their relative
    precision.  From ``LARGE_DF`` on, t is carried to a normal deviate by the
    classical expansion in 1/df.
    """
    nu = df.cast("double")
    a, t2 = nu / 2, t * t
    x = nu / (nu + t2)

    def fraction(x: Column, a: Column, b: Column) -> Column:
        # 1 + d1/(1 + d2/(1 + ...)), two terms d_{2m+1}, d_{2m} a step
        def step(f: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return 1 + even / (1 + odd / f)
        tail = F.aggregate(F.sequence(F.lit(300), F.lit(1)), F.lit(1.0), step)
        return 1 / (1 - (a + b) * x / (a + 1) / tail)

    half = F.lit(0.5)
    front = F.pow(x, a) * F.sqrt(1 - x) * _gamma_ratio(a) / F.lit(math.sqrt(math.pi))
    direct = front / a * fraction(x, a, half)
    other = 1 - front / half * fraction(1 - x, half, a)
    exact = F.when(x < (a + 1) / (a + 2.5), direct).otherwise(other)
    c = nu - 0.5
    z = F.sqrt(c * F.log1p(t2 / nu))
    b48 = 48 * c * c
    deviate = z + (F.pow(z, 3) + 3 * z) / b48 \
        - (4 * F.pow(z, 7) + 33 * F.pow(z, 5) + 240 * F.pow(z, 3) + 855 * z) / (10 * b48 * (b48 + 0.8 * F.pow(z, 4) + 100))
    p = F.when(nu >= LARGE_DF, normal_two_sided_p(deviate)).otherwise(exact)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return F.when(t.isNull() | df.isNull() | (df < 1), None).when(t == 0, F.lit(1.0)).otherwise(p)


def kolmogorov_q(lam: Column, terms: int = 100) -> Column:
    """Asymptotic Kolmogorov tail Q(λ) = 2 Σ_{k≥1} (−1)^{k−1} exp(−2k²λ²)."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.lit(2.0) * F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * k * k * lam * lam))
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))
    return F.when(lam.isNull(), None).when(lam < 0.2, F.lit(1.0)).otherwise(q)


def ks_exact_tail(n1: int, n2: int, d: float) -> float:
    """P(D >= d) of the two-sample Kolmogorov-Smirnov statistic if both samples
    come from one continuous distribution.

    The pooled order is a lattice path from (0, 0) to (n1, n2), all equally
    likely.  Step by step the probability of being at each point of the path's
    diagonal, without having left the band |i / n1 - j / n2| < d, is carried
    on; what leaves adds up to the tail.  Only the points inside the band are
    kept, on the side of the smaller sample.
    """
    a, b = sorted((int(n1), int(n2)))
    g = math.gcd(a, b)
    reach = round(d * (a // g * b))              # the band in units of 1 / lcm
    if reach <= 0:
        return 1.0
    up, over = b // g, a // g                    # a step in the smaller, in the larger sample
    here, first, left = np.ones(1), 0, 0.0       # probabilities of i = first, first + 1, ...
    for step in range(1, a + b + 1):
        i = np.arange(first, first + len(here) + 1)
        j = step - i
        came = np.zeros(len(i))
        came[1:] += here * np.maximum(a - i[1:] + 1, 0)      # from i - 1
        came[:-1] += here * np.maximum(b - j[:-1] + 1, 0)    # from j - 1
        came /= a + b - step + 1
        inside = np.abs(i * up - j * over) < reach
        left += float(came[~inside].sum())
        kept = np.flatnonzero(inside & (i <= a) & (j <= b))
        if not len(kept):
            break
        first, here = int(i[kept[0]]), came[kept[0]:kept[-1] + 1]
    return min(1.0, left)


def ks_exact_p(n1: str, n2: str, d: Column) -> Column:
    """``ks_exact_tail`` for result rows (one a series; at most 20,000 steps
    over arrays of the band's width); null where an argument is."""
    @F.pandas_udf("double")
    def tails(a: pd.Series, b: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) or pd.isna(z) else ks_exact_tail(x, y, z) for x, y, z in zip(a, b, d)], dtype="float64")
    # a sample beyond the exact range must not be walked through, whatever branch asks for it
    few = F.greatest(F.col(n1), F.col(n2)) <= 10_000
    return tails(F.when(few, F.col(n1)), F.when(few, F.col(n2)), d)


def factorial(n: Column) -> Column:
    """n! as a double (∞ beyond 170), via a product over sequence(1, n)."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(1.0),
                       lambda acc, k: acc * k)
