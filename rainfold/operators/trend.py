"""Trend statistics per series (T1-T8, T10), one row per series key.

A *series* is (keys..., pos, x, y): ``pos`` is the 0-based position in
time order (rows with a missing value keep their slot, as the reference's
``arange(len(y))[mask]`` does), ``x`` the regressor (position or period
label) and ``y`` the value.  All statistics for all series are computed in
one distributed pass; p-values are native expressions evaluated on the
result rows only.

Pair statistics never list the n(n-1)/2 pairs: Mann-Kendall S comes from
the block and level decomposition in :mod:`rainfold.operators.dominance`,
Pettitt's U from mid-rank prefix sums, Theil-Sen is in
:mod:`rainfold.operators.theil_sen`.  Counts and sums along a series are
two-level (:mod:`rainfold.operators.blocks`): a series of any length is spread
over tasks, as many series are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainfold.functions.numeric import (factorial, kolmogorov_q, ks_exact_p, normal_two_sided_p,
                                        student_t_two_sided_p)
from rainfold.operators import blocks
from rainfold.operators.blocks import join_keys, natural_block, running, value_blocks
from rainfold.operators.dominance import pairs_le
from rainfold.session import materialise

EXACT_MAX_N = 33
#: Fixed value: values of a sample up to which the two-sample KS p-value is exact.
KS_EXACT_MAX = 10_000


def make_series(df: DataFrame, by: Sequence[str], order: Sequence[str] | str, value: str,
                x: str | None = None, label: str | None = None) -> DataFrame:
    """Shape a table into series rows (by..., pos, x, y, label, n, span, idx).

    ``pos`` counts all rows, ``idx`` the rows with a value, both from 0 in
    order, as two-level counts over blocks of the first order column, so a
    series of any length is spread over tasks.  The table is written to the
    shared folder: whatever reads the series evaluates its source once."""
    by = list(by)
    order = [order] if isinstance(order, str) else list(order)
    label = label or order[0]
    s = df.select(*by, *[c for c in dict.fromkeys(order + [label])], F.col(value).cast("double").alias("_y"),
                  *( [F.col(x).alias("_x")] if x else []))
    has = F.col("_y").isNotNull() & ~F.isnan("_y")
    block = natural_block(s, order[0], alone=len(order) == 1)
    if block is None:
        firsts = value_blocks(s.select(*by, order[0]).distinct(), by, order[0])
        s = join_keys(s, firsts, [*by, order[0]])
    else:
        s = s.withColumn("_block", F.coalesce(block, F.lit(-(1 << 62))))
    s = running(s, by, "_block", order, {"_pos": F.lit(1), "_idx": F.when(has, 1).otherwise(0)}, {"_span": "_pos", "_n": "_idx"})
    xcol = (F.col("_x") if x else F.col("_pos")).cast("double")
    counts = [F.col(f"_{c}").cast("long").alias(c) for c in ("pos", "n", "span", "idx")]
    s = s.where(has).select(*by, counts[0], xcol.alias("x"), F.col("_y").alias("y"), F.col(label).alias("label"), *counts[1:])
    return materialise(s, "series")


def longest(series: DataFrame) -> int:
    """Points of the longest series (one number)."""
    return series.agg(F.max("n")).first()[0] or 0


# ---------------------------------------------------------------- Mann-Kendall

@lru_cache(maxsize=1)
def _kendall_cdf_rows(max_n: int = EXACT_MAX_N) -> list[tuple[int, int, float]]:
    """Pure-Python reference of :func:`kendall_cdf_table` (used by tests).

    P(C ≤ c) for the number C of concordant pairs of a random permutation
    of n untied values (Mahonian distribution), built by the recurrence
    p_n(c) = (1/n) Σ_{k=0}^{min(c, n-1)} p_{n-1}(c-k)."""
    rows = []
    p = [1.0]
    for n in range(2, max_n + 1):
        size = n * (n - 1) // 2 + 1
        new = [0.0] * size
        run = 0.0
        for c in range(size):
            run += p[c] if c < len(p) else 0.0
            drop = c - n
            if drop >= 0 and drop < len(p):
                run -= p[drop]
            new[c] = run / n
        p = new
        acc = 0.0
        for c, v in enumerate(p):
            acc += v
            rows.append((n, c, min(acc, 1.0)))
    return rows


def kendall_cdf_table(spark: SparkSession, max_n: int = EXACT_MAX_N) -> DataFrame:
    """Fixed lookup of about 6,000 rows, built from its rule where it is used."""
    return _kendall_cdf_native(spark, max_n)


def _kendall_cdf_native(spark: SparkSession, max_n: int = EXACT_MAX_N) -> DataFrame:
    """Exact null CDF for n ≤ 33 (about 6,000 rows, fixed size), generated
    natively from the recurrence: one row per n builds its probability
    array with ``aggregate`` over m = 2..n, then prefix sums give the CDF."""
    def step(acc, m):
        def cell(c):
            lo = F.greatest(F.lit(1), c - m + 2)
            length = F.least(c + 1, F.size(acc)) - lo + 1
            return F.aggregate(F.slice(acc, lo, length), F.lit(0.0), lambda a, x: a + x) / m
        return F.transform(F.sequence(F.lit(0), F.size(acc) + m - 2), cell)

    pmf = F.aggregate(F.sequence(F.lit(2), F.col("kn")), F.array(F.lit(1.0)), step)
    ns = spark.range(2, max_n + 1).select(F.col("id").cast("int").alias("kn"))
    probs = ns.select("kn", pmf.alias("_pmf"))
    rows = probs.select("kn", F.posexplode("_pmf").alias("kc", "_p"))
    w = Window.partitionBy("kn").orderBy("kc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("kn", F.col("kc").cast("int").alias("kc"), F.least(F.lit(1.0), F.sum("_p").over(w)).alias("kcdf"))


def mk_counts(series: DataFrame, sid: Sequence[str]) -> DataFrame:
    """S, tie terms and concordance counts per series."""
    sid = list(sid)
    t = F.col("t")
    base = (series.groupBy(*sid, "y").agg(F.count(F.lit(1)).alias("t"), F.max("span").alias("span"))
            .groupBy(*sid).agg(F.sum("t").alias("n"), F.max("span").alias("span"),
                               F.sum(t * (t - 1) / 2).cast("long").alias("tied_pairs"),
                               F.sum(t * (t - 1) * (2 * t + 5)).cast("double").alias("tie_var")))
    le = pairs_le(series, sid, "pos", "y", "span", longest(series))
    j = base.join(le, sid)
    n = F.col("n")
    total = (n * (n - 1) / 2).cast("long")
    conc = F.col("pairs_le") - F.col("tied_pairs")
    disc = total - conc - F.col("tied_pairs")
    return j.select(*sid, "n", total.alias("pairs"), conc.alias("concordant"), disc.alias("discordant"),
                    "tied_pairs", "tie_var", (conc - disc).alias("s"))


def _mk_variance(n: Column, tie_var: Column) -> Column:
    return (n * (n - 1) * (2 * n + 5) - tie_var) / F.lit(18.0)


def mann_kendall(series: DataFrame, sid: Sequence[str], min_n: int = 4, variant: str = "library",
                 alpha: float = 0.05) -> DataFrame:
    """T1 (``variant='library'``, n ≥ 4) and T1b (``variant='local'``, n ≥ 3).

    τ-b of position vs value; two-sided p as Kendall's test would give it:
    exact null distribution for untied samples with n ≤ 33 (or an extreme
    count), else the normal approximation without continuity correction.
    """
    sid = list(sid)
    spark = series.sparkSession
    c = mk_counts(series, sid)
    n, s = F.col("n"), F.col("s").cast("double")
    var_s = _mk_variance(n, F.col("tie_var"))
    denom = F.col("pairs").cast("double") * (F.col("pairs") - F.col("tied_pairs")).cast("double")
    tau = F.when(denom > 0, s / F.sqrt(denom))
    z = F.when(var_s > 0, s / F.sqrt(var_s))
    cmin = F.least(F.col("concordant"), F.col("discordant"))
    exact = (F.col("tied_pairs") == 0) & ((n <= EXACT_MAX_N) | (cmin <= 1))
    c = c.select("*", var_s.alias("var_s"), tau.alias("tau"), z.alias("z"), cmin.alias("_cmin"),
                 exact.alias("_exact"))
    cdf = F.broadcast(kendall_cdf_table(spark))
    c = c.join(cdf, (F.col("n") == cdf.kn) & (F.col("_cmin") == cdf.kc), "left")
    p_exact = (F.when(F.col("n") <= EXACT_MAX_N, F.least(F.lit(1.0), 2 * F.col("kcdf")))
               .when(F.col("_cmin") == 0, F.lit(2.0) / factorial(F.col("n")))
               .otherwise(F.lit(2.0) / factorial(F.col("n") - 1)))
    p = F.when(F.col("tau").isNull(), None).when(F.col("_exact"), p_exact).otherwise(normal_two_sided_p(F.col("z")))
    c = c.withColumn("p_value", p).withColumn(
        "method", F.when(F.col("tau").isNull(), None).when(F.col("_exact"), "exact").otherwise("normal"))
    enough = F.col("n") >= min_n
    tau, p = F.col("tau"), F.col("p_value")
    sig = p < alpha
    if variant == "library":
        trend = (F.when(~enough, "insufficient data")
                 .when((tau > 0) & sig, "increasing").when((tau < 0) & sig, "decreasing")
                 .when(sig, F.format_string("tau=%.3f (check)", tau)).otherwise("no trend"))
    else:
        trend = (F.when(~enough, "insufficient data")
                 .when(sig & (tau > 0), "increasing").when(sig & (tau < 0), "decreasing")
                 .when(sig, "no trend").otherwise("no significant trend"))
    keep = lambda col: F.when(enough, col)
    return c.select(*sid, "n", keep(F.col("s")).alias("s"), keep(F.col("var_s")).alias("var_s"),
                    keep(tau).alias("tau"), keep(F.col("z")).alias("z"), keep(p).alias("p_value"),
                    keep(F.col("method")).alias("method"), trend.alias("trend"),
                    F.coalesce(keep(p < 0.05), F.lit(False)).alias("sign_0_05"),
                    F.coalesce(keep(p < 0.01), F.lit(False)).alias("sign_0_01"),
                    F.coalesce(keep(p < 0.001), F.lit(False)).alias("sign_0_001"))


def seasonal_mann_kendall(series: DataFrame, by: Sequence[str], season: str = "season",
                          min_n: int = 3, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """T4 (Hirsch et al. 1982): S and tie-corrected Var summed over seasons.

    ``series`` must be built with sid = by + [season].  Returns (overall,
    per-season detail).  Z uses the ±1 continuity correction; Var ≤ 0 →
    'insufficient data'.
    """
    by = list(by)
    sid = [*by, season]
    c = mk_counts(series, sid).where(F.col("n") >= min_n)
    detail = c.select(*sid, "n", F.col("s").cast("double").alias("s"),
                      _mk_variance(F.col("n"), F.col("tie_var")).alias("var_s"))
    tot = detail.groupBy(*by).agg(F.sum("s").alias("s_total"), F.sum("var_s").alias("var_s"),
                                  F.count(F.lit(1)).alias("seasons"))
    s, v = F.col("s_total"), F.col("var_s")
    z = (F.when(s > 0, (s - 1) / F.sqrt(v)).when(s < 0, (s + 1) / F.sqrt(v)).otherwise(F.lit(0.0)))
    ok = v > 0
    p = normal_two_sided_p(F.col("z"))
    out = tot.select(*by, "seasons", F.when(ok, s).alias("s_total"), F.when(ok, v).alias("var_s"),
                     F.when(ok, z).alias("z"))
    out = out.withColumn("p_value", p).withColumn(
        "trend", F.when(F.col("z").isNull(), "insufficient data")
        .when((F.col("z") > 0) & (F.col("p_value") < alpha), "increasing")
        .when((F.col("z") < 0) & (F.col("p_value") < alpha), "decreasing")
        .otherwise("no trend"))
    return out, detail


# ---------------------------------------------------------------- Pettitt

def pettitt(series: DataFrame, sid: Sequence[str], min_n: int = 4, alpha: float = 0.05) -> DataFrame:
    """K = max_k |U_k|, U_k = 2·Σ_{i<k} r_i − k(n+1) with mid-ranks r
    (equal to the double sum of signs, ties included).  ``cp_index`` is
    the 0-based index of the first element of the second segment (first
    maximum wins); ``cp_label`` is that element's period label."""
    sid = list(sid)
    # different values of a series with their counts: the values before (two-level) give the mid-rank
    ties = value_blocks(series.groupBy(*sid, "y").agg(F.count(F.lit(1)).alias("_t")), sid, "y")
    ranks = running(ties, sid, "_block", ["y"], {"_before": F.col("_t")})
    ranks = ranks.select(*sid, "y", (F.col("_before") + (F.col("_t") + 1) / 2.0).alias("_r"))
    ranked = series.select(*sid, "idx", "y", "label", "n", F.floor(F.col("idx") / blocks.BLOCK).alias("_block"))
    ranked = join_keys(ranked, ranks, [*sid, "y"])
    # a point and the sum of the ranks before it: the split in front of that point, whose label it has
    u = running(ranked, sid, "_block", ["idx"], {"_sum": F.col("_r")})
    u = u.select(*sid, "n", F.col("idx").alias("_k"), F.col("label").alias("_next"), (2 * F.col("_sum") - F.col("idx") * (F.col("n") + 1)).alias("_u"))
    best = (u.where(F.col("_k") > 0)
            .groupBy(*sid).agg(F.first("n").alias("n"),
                               F.max(F.struct(F.abs("_u").alias("a"), (-F.col("_k")).alias("nk"),
                                              F.col("_next").alias("lab"))).alias("_b")))
    n = F.col("n").cast("double")
    kstat = F.col("_b.a")
    p = F.least(F.lit(1.0), 2 * F.exp(-2 * kstat * kstat / (n * n * n + n * n)))
    enough = F.col("n") >= min_n
    return best.select(*sid, "n",
                       F.when(enough, (-F.col("_b.nk")).cast("long")).alias("cp_index"),
                       F.when(enough, F.col("_b.lab")).alias("cp_label"),
                       F.when(enough, kstat).alias("u_stat"),
                       F.when(enough, p).alias("p_value"),
                       F.coalesce(F.when(enough, p < alpha), F.lit(False)).alias("significant"))


# ---------------------------------------------------------------- OLS

def ols(series: DataFrame, sid: Sequence[str], min_n: int = 3) -> DataFrame:
    """Least-squares line of y on x with r, r², and the two-sided p of
    the slope (Student t, n−2 df).  Single-pass moment aggregates, so a hot
    series is combined map-side."""
    sid = list(sid)
    g = series.groupBy(*sid).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_sxx("y", "x").alias("_sxx"), F.regr_syy("y", "x").alias("_syy"),
        F.regr_sxy("y", "x").alias("_sxy"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    sxx, syy, sxy = F.col("_sxx"), F.col("_syy"), F.col("_sxy")
    slope = F.when(sxx > 0, sxy / sxx)
    r = F.when((sxx > 0) & (syy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sxy / F.sqrt(sxx * syy))))
    enough = F.col("n") >= min_n
    out = g.select(*sid, "n", F.when(enough, slope).alias("slope"),
                   F.when(enough, F.col("_my") - slope * F.col("_mx")).alias("intercept"),
                   F.when(enough, r).alias("r"))
    df_ = F.col("n") - 2
    rr = F.col("r")
    t = rr * F.sqrt(df_.cast("double") / ((F.lit(1.0) - rr) * (F.lit(1.0) + rr)))
    p = F.when(F.abs(rr) >= 1.0, F.lit(0.0)).otherwise(student_t_two_sided_p(t, df_))
    return out.select("*", (rr * rr).alias("r2"), F.when(rr.isNotNull() & (df_ >= 1), p).alias("p_value"))


# ---------------------------------------------------------------- two samples

def two_sample_tests(df: DataFrame, by: Sequence[str], sample: str, value: str,
                     first: str = "early", second: str = "late") -> DataFrame:
    """T7 and T8 from one pass: (keys, n1, n2, ks_d, ks_p_value, ks_method,
    mean1, mean2, t, t_p_value).  The KS p-value is exact if neither sample
    has more than ``KS_EXACT_MAX`` values, else the Kolmogorov tail.  The rows are collapsed to counts per value and sample; the
    cumulative counts give D, the weighted moments give t."""
    by = list(by)
    smp = F.col(sample)
    counts = (df.where(F.col(value).isNotNull() & smp.isin(first, second))
              .groupBy(*by, F.col(value).alias("_v"))
              .agg(F.count_if(smp == first).alias("_a"), F.count_if(smp == second).alias("_b")))
    counts = materialise(counts, "value-counts")
    v = F.col("_v")
    cdf = running(value_blocks(counts, by, "_v"), by, "_block", ["_v"],
                  {"_ba": F.col("_a"), "_bb": F.col("_b"), "_sa": F.col("_a") * v, "_sb": F.col("_b") * v},
                  {"n1": "_ba", "n2": "_bb", "_wa": "_sa", "_wb": "_sb"})
    cdf = cdf.select(*by, "_v", "_a", "_b", (F.col("_ba") + F.col("_a")).alias("_ca"), (F.col("_bb") + F.col("_b")).alias("_cb"), "n1", "n2",
                     F.try_divide("_wa", "n1").alias("mean1"), F.try_divide("_wb", "n2").alias("mean2"))
    g = cdf.groupBy(*by).agg(
        F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.first("mean1").alias("mean1"), F.first("mean2").alias("mean2"),
        F.max(F.abs(F.try_divide("_ca", "n1") - F.try_divide("_cb", "n2"))).alias("_d"),
        F.sum(F.col("_a") * (v - F.col("mean1")) * (v - F.col("mean1"))).alias("_s1"),
        F.sum(F.col("_b") * (v - F.col("mean2")) * (v - F.col("mean2"))).alias("_s2"))
    n1, n2 = F.col("n1"), F.col("n2")
    some = (n1 > 0) & (n2 > 0)
    dfree = n1 + n2 - 2
    pooled = (F.col("_s1") + F.col("_s2")) / F.nullif(dfree, F.lit(0))
    t = (F.col("mean1") - F.col("mean2")) / F.sqrt(pooled * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    ok = (n1 >= 2) & (n2 >= 2) & (pooled > 0)
    exact = F.greatest(n1, n2) <= KS_EXACT_MAX
    out = g.select(*by, "n1", "n2", F.when(some, F.col("_d")).alias("ks_d"),
                   F.when(some & exact, ks_exact_p("n1", "n2", F.col("_d")))
                   .when(some, kolmogorov_q(F.col("_d") * F.sqrt(n1 * n2 / (n1 + n2)))).alias("ks_p_value"),
                   F.when(some & exact, "exact").when(some, "asymptotic").alias("ks_method"), "mean1", "mean2", F.when(ok, t).alias("t"), dfree.alias("_df"))
    return out.withColumn("t_p_value", F.when(F.col("t").isNotNull(), student_t_two_sided_p(F.col("t"), F.col("_df")))).drop("_df")
