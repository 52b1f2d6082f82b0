"""Edge cases from FIXTURES.md §3 and brute-force checks of the operators."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import percentile
from rainfold.operators import aggregates as agg
from rainfold.operators.combine import outer_merge, two_way_compare, union_eras
from rainfold.operators.coverage import coverage, first_last_periods, keep_valid
from rainfold.operators.periods import rain_period_counts, rain_periods, streaks
from rainfold.operators.ranking import arg_extremes, top_k
from rainfold.operators.resample import daily_from_halfhourly, resample_hourly
from rainfold.plans.nights import night_table

T = dt.datetime


def test_gap_hours_filled(spark):
    df = spark.createDataFrame([("a", T(2020, 1, 1, 0, 0), 1.0, 5.0), ("a", T(2020, 1, 1, 0, 30), None, 7.0),
                                ("a", T(2020, 1, 1, 3, 0), 2.0, None)],
                               "station STRING, datetime_utc TIMESTAMP_NTZ, rain_mm DOUBLE, T_avg DOUBLE")
    out = resample_hourly(df, mean_cols=["T_avg"]).orderBy("datetime_utc").collect()
    assert [r.rain_mm for r in out] == [1.0, 0.0, 0.0, 2.0]
    assert [r.T_avg for r in out] == [6.0, None, None, None]
    sparse = resample_hourly(df, mean_cols=["T_avg"], fill_gaps=False).collect()
    assert len(sparse) == 2
    # gap-filled total equals the raw total
    assert sum(r.rain_mm for r in out) == 3.0


def test_rain_periods_thirty_minutes_and_new_year(spark):
    rows = [("a", T(2020, 5, 1, 0, 0)), ("a", T(2020, 5, 1, 0, 30)), ("a", T(2020, 5, 1, 1, 1)),
            ("b", T(2020, 12, 31, 23, 30)), ("b", T(2021, 1, 1, 0, 0))]
    df = spark.createDataFrame([(s, t, 1.0) for s, t in rows],
                               "station STRING, datetime_utc TIMESTAMP_NTZ, rain_mm DOUBLE")
    per = rain_periods(df).collect()
    a = sorted((r.period_no, r.intervals) for r in per if r.station == "a")
    assert a == [(1, 2), (2, 1)]
    b = sorted((r.year, r.period_no) for r in per if r.station == "b")
    assert b == [(2020, 1), (2021, 1)]
    counts = {(r.station, r.year): r.periods for r in rain_period_counts(df).collect()}
    assert counts == {("a", 2020): 2, ("a", 2021): 0, ("b", 2020): 1, ("b", 2021): 1}


def test_night_edges(spark):
    rows = [T(2020, 9, 22, 5, 30), T(2020, 9, 22, 6, 0), T(2020, 6, 21, 0, 0), T(2020, 6, 21, 23, 0)]
    df = spark.createDataFrame([("a", t, 20.0, 20.0, 20.0) for t in rows],
                               "station STRING, datetime_utc TIMESTAMP_NTZ, T_min DOUBLE, T_max DOUBLE, T_avg DOUBLE")
    nights = {r.night_date for r in night_table(df).collect()}
    assert nights == {dt.date(2020, 9, 21), dt.date(2020, 6, 21)}


def test_streak_rows_vs_calendar(spark):
    df = spark.createDataFrame([("a", 2020, dt.date(2020, 7, d), 25.0) for d in (1, 2, 4)],
                               "station STRING, year INT, date DATE, T_min DOUBLE")
    by_rows = streaks(df, ["station"], "year", "date", "T_min", [20.0]).collect()[0]
    by_cal = streaks(df, ["station"], "year", "date", "T_min", [20.0], calendar=True).collect()[0]
    assert (by_rows.longest_streak, by_rows.n_streaks_min) == (3, 1)
    assert (by_cal.longest_streak, by_cal.n_streaks_min) == (2, 0)


def test_streaks_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for s in "ab":
        for y in (2000, 2001):
            for d in range(60):
                rows.append((s, y, dt.date(y, 6, 1) + dt.timedelta(days=d), float(rnd.randint(15, 30))))
    df = spark.createDataFrame(rows, "station STRING, year INT, date DATE, T_min DOUBLE")
    got = {(r.station, r.year, r.threshold): (r.longest_streak, r.n_streaks_min)
           for r in streaks(df, ["station"], "year", "date", "T_min", [20.0, 25.0]).collect()}
    for s in "ab":
        for y in (2000, 2001):
            vals = [v for (ss, yy, _, v) in rows if ss == s and yy == y]
            for t in (20.0, 25.0):
                runs, cur = [], 0
                for v in vals + [None]:
                    if v is not None and v > t:
                        cur += 1
                    else:
                        if cur:
                            runs.append(cur)
                        cur = 0
                assert got[(s, y, t)] == (max(runs, default=0), sum(1 for r in runs if r >= 3))


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", v) for v in (0.1, 0.2, 1.0, 25.0)], "station STRING, rain_mm DOUBLE")
    h = {r.label: r["count"] for r in agg.histogram(df, ["station"], "rain_mm").collect()}
    assert h == {"0-0.2": 1, "0.2-1": 1, "1-3": 1, "3-5": 0, "5-10": 0, "10-20": 0, "20+": 1}


def test_circular_mean_wraps(spark):
    df = spark.createDataFrame([("a", T(2020, 1, 1, 0, 0), 350.0), ("a", T(2020, 1, 1, 0, 30), 10.0)],
                               "station STRING, datetime_utc TIMESTAMP_NTZ, wind_dir DOUBLE")
    w = daily_from_halfhourly(df).collect()[0].wind_dir
    assert min(w, 360 - w) < 1e-9


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(4)
    rows = [(g, float(rnd.choice([rnd.random() * 10, 1.0, 2.0]))) for g in "abcd" for _ in range(rnd.randint(1, 40))]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    out = {r.g: r for r in agg.exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.9, 0.95]).collect()}
    for g in "abcd":
        vals = [v for gg, v in rows if gg == g]
        for p, name in ((0.25, "p25"), (0.5, "p50"), (0.9, "p90"), (0.95, "p95")):
            assert getattr(out[g], name) == pytest.approx(np.percentile(vals, p * 100)), (g, p)
            assert getattr(out[g], name) == pytest.approx(percentile(vals, p))


def test_box_summary(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in vals], "g STRING, v DOUBLE")
    r = agg.box_summary(df, ["g"], "v").collect()[0]
    q1, q3 = np.percentile(vals, [25, 75])
    assert (r.q1, r.q3) == (q1, q3)
    assert r.whisker_high == 5.0 and r.whisker_low == 1.0 and r.n_outliers == 1


def test_threshold_counts_strict(spark):
    df = spark.createDataFrame([("a", v) for v in (20.0, 20.5, 22.0, 27.0)], "g STRING, v DOUBLE")
    c = {r.threshold: r["count"] for r in agg.threshold_counts(df, ["g"], "v", [20, 22, 24, 26]).collect()}
    assert c == {20.0: 3, 22.0: 1, 24.0: 1, 26.0: 1}


def test_coverage_and_semijoin(spark):
    df = spark.createDataFrame([("a", 2000, 1.0)] * 7 + [("a", 2001, 1.0)] * 3 + [("a", 2002, None)] * 9,
                               "station STRING, year INT, rain_mm DOUBLE")
    cov = {r.year: r for r in coverage(df, ["station"], "year", "rain_mm", 10, 0.7).collect()}
    assert cov[2000].status == "OK" and cov[2001].status == "Incomplete" and cov[2002].present == 0
    kept = keep_valid(df, coverage(df, ["station"], "year", "rain_mm", 10, 0.7), ["station"], "year")
    assert {r.year for r in kept.collect()} == {2000}


def test_first_last_overlap(spark):
    cov = spark.createDataFrame([("a", y, True) for y in range(2000, 2007)], "station STRING, year INT, is_valid BOOLEAN")
    fl = {r.year: (r.is_early, r.is_late) for r in first_last_periods(cov, ["station"], "year", 5).collect()}
    assert fl[2000] == (True, False) and fl[2006] == (False, True) and fl[2003] == (True, True)


def test_top_k_and_arg_extremes_ties(spark):
    df = spark.createDataFrame([("a", h, v) for h, v in [(0, 1.0), (1, 3.0), (2, 3.0), (3, 0.5), (4, 0.5)]],
                               "station STRING, hour INT, m DOUBLE")
    assert [r.hour for r in top_k(df, ["station"], "m", "hour", 2).orderBy("rank").collect()] == [1, 2]
    e = arg_extremes(df, ["station"], "m", "hour").collect()[0]
    assert (e.max_hour, e.max_m, e.min_hour, e.min_m) == (1, 3.0, 3, 0.5)


def test_outer_merge_equals_full_outer_joins(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k INT, a DOUBLE")
    b = spark.createDataFrame([(2, 20.0), (3, 30.0)], "k INT, b DOUBLE")
    m = {r.k: (r.a, r.b) for r in outer_merge([a, b], ["k"]).collect()}
    assert m == {1: (1.0, None), 2: (2.0, 20.0), 3: (None, 30.0)}


def test_two_way_compare_fill(spark):
    df = spark.createDataFrame([("x", 2000, 1), ("y", 2001, 2)], "s STRING, year INT, c BIGINT")
    out = {r.year: (r.l, r.r, r.difference) for r in
           two_way_compare(df, ["year"], "s", "x", "y", "c", fill=0, names=("l", "r")).collect()}
    assert out == {2000: (1, 0, -1), 2001: (0, 2, 2)}


def test_union_eras_overlap(spark):
    old = spark.createDataFrame([("2018-01-01", 1.0), ("2017-12-31", 2.0)], "date STRING, max DOUBLE") \
        .withColumnRenamed("max", "T_max")
    new = spark.createDataFrame([("2018-01-01", 1.5, "txt")], "date STRING, T_max DOUBLE, source STRING")
    assert union_eras([old, new]).count() == 3
    d = union_eras([old, new], key=["date"], dedupe="prefer_new").collect()
    assert {(r.date, r.T_max) for r in d} == {("2018-01-01", 1.5), ("2017-12-31", 2.0)}


def test_specific_rain_modes(spark):
    rows = [("a", T(2020, 1, 1, 0, 0), 0.3), ("a", T(2020, 1, 1, 0, 30), 0.1), ("a", T(2020, 1, 1, 1, 0), 0.1)]
    df = spark.createDataFrame(rows, "station STRING, datetime_utc TIMESTAMP_NTZ, rain_mm DOUBLE")
    f = agg.specific_rain(df, mode="filtered").collect()[0]
    w = agg.specific_rain(df, mode="any_wet").collect()[0]
    assert f.specific_rain == pytest.approx(30.0) and f.wet_hours == 1
    assert w.specific_rain == pytest.approx(20.0) and w.wet_hours == 1


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a INT, b STRING")
    p = {r.column: (r.n_null, r.pct_null) for r in agg.null_profile(df).collect()}
    assert p["a"] == (1, pytest.approx(100 / 3)) and p["b"] == (2, pytest.approx(200 / 3))


def test_histogram_pct_half_even(spark):
    df = spark.createDataFrame([("a", v) for v in [0.1] * 1 + [0.5] * 7], "station STRING, rain_mm DOUBLE")
    h = {r.label: r.pct for r in agg.histogram(df, ["station"], "rain_mm", pct_decimals=1).collect()}
    assert h["0-0.2"] == 12.5 and h["0.2-1"] == 87.5
    df2 = spark.createDataFrame([("a", 0.1)] + [("a", 0.5)] * 15, "station STRING, rain_mm DOUBLE")
    h2 = {r.label: r.pct for r in agg.histogram(df2, ["station"], "rain_mm", pct_decimals=1).collect()}
    assert h2["0-0.2"] == 6.2  # 6.25 rounds half to even


def test_drop_sparse_columns(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, None), (3, 5, 3.0)], "a INT, b INT, c DOUBLE")
    assert agg.drop_sparse_columns(df, ["a", "b", "c"], 50).columns == ["a", "c"]
    assert agg.drop_sparse_columns(df, ["a", "b", "c"], 30).columns == ["a"]
