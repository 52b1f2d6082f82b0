"""Series of any length: two-level sums, block-decomposed dominance, slope
selection over pairs of blocks, against brute force with small blocks."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from brute import median, mk_s, percentile, pettitt as bf_pettitt, sen
from pyspark.sql import functions as F

from rainfold.operators import aggregates, blocks, theil_sen, trend


def _data():
    rnd = random.Random(1)
    return {"normal": [rnd.gauss(0, 1) for _ in range(150)], "ties": [float(rnd.randint(0, 4)) for _ in range(130)],
            "mixed": [rnd.choice([0.1 * rnd.randint(0, 9), rnd.random()]) for _ in range(100)], "flat": [3.0] * 70,
            "gaps": [float("nan") if i % 3 == 0 else rnd.random() for i in range(120)], "short": [1.0, 5.0, 2.0, 4.0, 4.0]}


def _frame(spark, data):
    return spark.createDataFrame([(k, i, v) for k, ys in data.items() for i, v in enumerate(ys)], "sid STRING, t INT, v DOUBLE")


def _kept(ys):
    return [i for i, v in enumerate(ys) if v == v], [v for v in ys if v == v]


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)


def test_series_numbering_over_blocks(spark, small):
    rows = {(r.sid, r.pos): r for r in trend.make_series(_frame(spark, _data()), ["sid"], "t", "v").collect()}
    for k, ys in _data().items():
        xs, kept = _kept(ys)
        for idx, (pos, y) in enumerate(zip(xs, kept)):
            r = rows.pop((k, pos))
            assert (r.x, r.y, r.label, r.n, r.span, r.idx) == (pos, y, pos, len(kept), len(ys), idx)
    assert not rows


@pytest.mark.parametrize("kind", ["date", "string", "two columns"])
def test_numbering_by_any_order(spark, small, kind):
    df = spark.range(100).select(F.lit(None).cast("string").alias("sid"), F.col("id").cast("double").alias("v"))
    days = F.date_add(F.lit("2000-11-01").cast("date"), F.col("v").cast("int"))
    order = {"date": ["d"], "string": ["s"], "two columns": ["y", "d"]}[kind]
    df = df.select("sid", "v", days.alias("d"), days.cast("string").alias("s"), F.year(days).alias("y"))
    rows = trend.make_series(df, ["sid"], order, "v").collect()   # a null key is a series too
    assert sorted((r.pos, r.y, r.n) for r in rows) == [(i, float(i), 100) for i in range(100)]


def test_mann_kendall_and_pettitt_over_blocks(spark, small):
    s = trend.make_series(_frame(spark, _data()), ["sid"], "t", "v")
    mk = {r.sid: r for r in trend.mann_kendall(s, ["sid"]).collect()}
    pt = {r.sid: r for r in trend.pettitt(s, ["sid"]).collect()}
    for k, ys in _data().items():
        ys = _kept(ys)[1]
        assert mk[k].s == mk_s(ys), k
        cp, u, p = bf_pettitt(ys)
        assert (pt[k].cp_index, pt[k].u_stat) == (cp, u) and pt[k].p_value == pytest.approx(p), k


def test_quantiles_over_blocks(spark, small):
    data = {k: v for k, v in _data().items() if k != "gaps"}
    got = {r.sid: r for r in aggregates.exact_quantiles(_frame(spark, data), ["sid"], "v", [0.1, 0.5, 0.95]).collect()}
    for k, ys in data.items():
        assert [got[k].p10, got[k].p50, got[k].p95] == pytest.approx([percentile(ys, p) for p in (0.1, 0.5, 0.95)]), k
        assert got[k].n == len(ys)


def test_blocks_are_bounded(spark, small):
    """No window of the two-level sums holds one series."""
    values = spark.range(2000).select(F.lit("hot").alias("k"), (F.col("id") * 0.37).alias("v"))
    sizes = [r["count"] for r in blocks.value_blocks(values, ["k"], "v").groupBy("k", "_block").count().collect()]
    assert sum(sizes) == 2000 and len(sizes) > 50 and max(sizes) < 10 * blocks.BLOCK


def _sen_expected(xs, ys):
    med, sl = sen(ys, xs)
    n, big = len(ys), len(sl)
    ties = sum(t * (t - 1) * (2 * t + 5) for v in (ys, xs) for t in Counter(v).values())
    sig = math.sqrt(max(0, (n * (n - 1) * (2 * n + 5) - ties) / 18))
    upper = min(int(round((big + 1.959963984540054 * sig) / 2)), big - 1)
    lower = max(int(round((big - 1.959963984540054 * sig) / 2)) - 1, 0)
    return med, median(ys) - med * median(xs), sl[lower], sl[upper]


def test_theil_sen_over_pairs_of_blocks(spark, small, monkeypatch):
    monkeypatch.setattr(theil_sen, "SHORT", 32)
    monkeypatch.setattr(theil_sen, "LISTED", 600)
    monkeypatch.setattr(theil_sen, "SAMPLED", 400)
    rnd = random.Random(5)
    data = {k: list(zip(*_kept(v))) for k, v in _data().items() if k != "mixed"}
    data["equal x"] = [(float(rnd.randint(0, 20)), rnd.random()) for _ in range(120)]
    data["one x"] = [(7.0, float(i)) for i in range(60)]
    df = spark.createDataFrame([(k, float(x), float(y)) for k, ps in data.items() for x, y in ps], "sid STRING, x DOUBLE, y DOUBLE")
    got = {r.sid: r for r in theil_sen.theil_sen(df, ["sid"]).collect()}
    for k, ps in data.items():
        assert got[k].n == len(ps)
        if k == "one x":
            assert got[k].slope is None and got[k].ci_lower is None
            continue
        want = _sen_expected([p[0] for p in ps], [p[1] for p in ps])
        assert tuple(got[k])[2:] == pytest.approx(want, abs=1e-12), k
        assert tuple(got[k])[4:] == want[2:], k     # order statistics are exact


def test_pair_counts_are_those_of_the_rounded_slopes():
    rnd = np.random.default_rng(3)
    for scale in (1.0, 1e9, 1e-9):
        x = np.sort(rnd.choice(1000, 40, replace=False)).astype(float)
        y = np.round(rnd.normal(size=40), 1) * scale + 0.1 * x * scale
        pair = theil_sen.BlockPair((x[:20], y[:20]), (x[20:], y[20:]), False)
        assert pair.plain
        s = np.sort(((y[None, 20:] - y[:20, None]) / (x[None, 20:] - x[:20, None])).ravel())
        for m in [*s[::17], 0.1 * scale, 0.0, s[0] * 2, s[-1] * 2]:
            assert pair.below(m) == ((s < m).sum(), (s <= m).sum())
        assert sorted(pair.inside(s[50], s[300])) == list(s[(s > s[50]) & (s < s[300])])


# ------------------------------------------------------------ other changes of these operators

def test_ks_exact_tail_by_enumeration():
    from itertools import combinations
    from math import gcd

    from rainfold.functions.numeric import ks_exact_tail
    for a, b in ((3, 4), (5, 5), (4, 8), (6, 3), (1, 7)):
        reached = []
        for chosen in combinations(range(a + b), a):
            i = worst = 0
            for k in range(a + b):
                i += k in chosen
                worst = max(worst, abs(i * b - (k + 1 - i) * a))
            reached.append(worst)
        for k in range(0, a * b + 1, gcd(a, b)):
            want = sum(w >= k for w in reached) / len(reached)
            assert ks_exact_tail(a, b, k / (a * b)) == pytest.approx(want, abs=1e-12)
    assert ks_exact_tail(10_000, 9_999, 0.02) == pytest.approx(0.0358, abs=3e-4)


def test_ks_method_by_sample_size(spark, monkeypatch):
    rows = [("a", s, float(v)) for s, vs in (("early", [1, 2, 2, 3]), ("late", [2, 4, 5])) for v in vs]
    df = spark.createDataFrame(rows, "k STRING, sample STRING, v DOUBLE")
    r = trend.two_sample_tests(df, ["k"], "sample", "v").first()
    assert r.ks_method == "exact" and r.ks_d == pytest.approx(2 / 3)   # ties do not change the null distribution
    assert r.ks_p_value == pytest.approx(14 / 35)   # by the enumeration above
    monkeypatch.setattr(trend, "KS_EXACT_MAX", 3)
    assert trend.two_sample_tests(df, ["k"], "sample", "v").first().ks_method == "asymptotic"


def test_gaps_over_years_are_filled(spark):
    from rainfold.operators.resample import resample_hourly
    rows = [("a", "2020-12-30 22:10:00", 1.0, 5.0), ("a", "2020-12-30 22:40:00", 2.0, None), ("a", "2022-01-01 01:00:00", 4.0, 7.0),
            ("a", "2022-01-01 03:59:00", None, 8.0), ("b", "2021-06-01 00:00:00", 1.0, 1.0), (None, "2021-06-01 00:00:00", 1.0, 1.0),
            (None, "2021-06-01 02:00:00", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "station STRING, t STRING, rain_mm DOUBLE, T_avg DOUBLE") \
        .select("station", F.col("t").cast("timestamp_ntz").alias("datetime_utc"), "rain_mm", "T_avg")
    out = resample_hourly(df).collect()
    a = sorted((r.datetime_utc, r.rain_mm, r.T_avg) for r in out if r.station == "a")
    assert len(a) == (a[-1][0] - a[0][0]).total_seconds() / 3600 + 1
    assert all((y[0] - x[0]).total_seconds() == 3600 for x, y in zip(a, a[1:]))
    assert a[0][1:] == (3.0, 5.0) and a[-1][1:] == (0.0, 8.0) and a[5][1:] == (0.0, None) and sum(r[1] for r in a) == 7.0
    assert sum(r.station == "b" for r in out) == 1 and sum(r.station is None for r in out) == 3


def test_measures_of_close_thresholds_stay_apart(spark):
    from rainfold.plans.nights import yearly_measures
    rows = [("s", d, 2000, 20.0 + d / 10, 25.0) for d in range(10)]
    days = spark.createDataFrame(rows, "station STRING, d INT, year INT, T_min DOUBLE, T_max DOUBLE") \
        .withColumn("date", F.date_add(F.lit("2000-07-01").cast("date"), F.col("d")))
    got = {r.measure: r.value for r in yearly_measures(days, thresholds=[20.0, 20.5]).collect()}
    assert got == {"mean_T_min": pytest.approx(20.45), "mean_T_max": 25.0, "count_gt_20": 9.0, "count_gt_20_5": 4.0,
                   "streak_gt_20": 9.0, "streak_gt_20_5": 4.0}


def test_streaks_keep_keys_without_runs(spark):
    from rainfold.operators.periods import streaks
    rows = [("s", 1, d, v) for d, v in enumerate([5.0, 5.0, None, 5.0, 1.0])] + [("dry", 1, 0, 1.0), ("none", 1, 0, None)]
    df = spark.createDataFrame(rows, "station STRING, year INT, d INT, v DOUBLE")
    got = {(r.station, r.threshold): (r.longest_streak, r.n_streaks_min) for r in streaks(df, ["station"], "year", "d", "v", [2.0, 9.0]).collect()}
    assert got[("dry", 2.0)] == got[("none", 2.0)] == got[("s", 9.0)] == (0, 0)
    assert got[("s", 2.0)][0] == 2


def test_rain_periods_fill_dry_years(spark):
    from rainfold.operators.periods import rain_period_counts
    rows = [("a", "2020-01-01 00:00:00", 1.0), ("a", "2020-01-01 00:30:00", 0.1), ("a", "2020-01-01 01:00:00", 1.0),
            ("a", "2020-12-31 23:30:00", 1.0), ("a", "2021-01-01 00:00:00", 1.0), ("b", "2022-05-05 00:00:00", 0.0), ("b", "2020-05-05 00:00:00", None)]
    df = spark.createDataFrame(rows, "station STRING, t STRING, rain_mm DOUBLE").select(
        "station", F.col("t").cast("timestamp_ntz").alias("datetime_utc"), "rain_mm")
    got = {(r.station, r.year): r.periods for r in rain_period_counts(df).collect()}
    assert got == {("a", 2020): 3, ("a", 2021): 1, ("a", 2022): 0, ("b", 2020): 0, ("b", 2021): 0, ("b", 2022): 0}
