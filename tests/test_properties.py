"""Property checks: many random series per Spark job."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rainfold.operators import trend
from rainfold.operators.resample import daily_from_halfhourly, resample_hourly
from rainfold.operators.theil_sen import theil_sen


def _series_df(spark, data):
    rows = [(sid, i, float(v)) for sid, ys in data.items() for i, v in enumerate(ys)]
    return trend.make_series(spark.createDataFrame(rows, "sid STRING, t INT, v DOUBLE"), ["sid"], "t", "v")


def _random_series(seed, count=30, tied=True):
    rnd = random.Random(seed)
    out = {}
    for k in range(count):
        n = rnd.randint(4, 40)
        out[f"s{k}"] = [float(rnd.randint(0, 6)) if tied and rnd.random() < 0.5 else round(rnd.uniform(-9, 9), 2)
                        for _ in range(n)]
    return out


def test_mk_reversal_and_monotone_invariance(spark):
    data = _random_series(1)
    rev = {f"{k}_rev": list(reversed(v)) for k, v in data.items()}
    mono = {f"{k}_exp": [math.exp(x / 3) for x in v] for k, v in data.items()}
    out = {r.sid: r for r in trend.mann_kendall(_series_df(spark, {**data, **rev, **mono}), ["sid"]).collect()}
    for k in data:
        assert out[f"{k}_rev"].s == -out[k].s
        assert out[f"{k}_exp"].s == out[k].s
        if out[k].tau is not None:
            assert out[f"{k}_exp"].tau == pytest.approx(out[k].tau)
            assert out[f"{k}_rev"].tau == pytest.approx(-out[k].tau)


def test_theil_sen_affine_equivariance(spark):
    data = _random_series(2, count=10, tied=False)
    a, b = 2.5, -7.0
    aff = {f"{k}_aff": [a * x + b for x in v] for k, v in data.items()}
    out = {r.sid: r for r in theil_sen(_series_df(spark, {**data, **aff}), ["sid"]).collect()}
    for k in data:
        assert out[f"{k}_aff"].slope == pytest.approx(a * out[k].slope, abs=1e-9)
        assert out[f"{k}_aff"].intercept == pytest.approx(a * out[k].intercept + b, abs=1e-9)


def test_pettitt_reversal_invariance(spark):
    data = _random_series(3)
    rev = {f"{k}_rev": list(reversed(v)) for k, v in data.items()}
    out = {r.sid: r for r in trend.pettitt(_series_df(spark, {**data, **rev}), ["sid"]).collect()}
    for k in data:
        assert out[f"{k}_rev"].u_stat == out[k].u_stat


def test_circular_mean_rotation(spark):
    import datetime as dt
    rnd = random.Random(4)
    rows = []
    for g in range(20):
        base = [rnd.uniform(0, 60) for _ in range(rnd.randint(2, 8))]
        rot = rnd.uniform(0, 360)
        for i, d in enumerate(base):
            t = dt.datetime(2020, 1, 1, 0, 30 * (i % 2)) + dt.timedelta(hours=i)
            rows.append((f"g{g}", t, d))
            rows.append((f"g{g}_rot{rot}", t, (d + rot) % 360))
    df = spark.createDataFrame(rows, "station STRING, datetime_utc TIMESTAMP_NTZ, wind_dir DOUBLE")
    out = {r.station: r.wind_dir for r in daily_from_halfhourly(df).collect()}
    for k, v in out.items():
        if "_rot" in k:
            rot = float(k.split("_rot")[1])
            base = out[k.split("_rot")[0]]
            diff = (v - base - rot) % 360
            assert min(diff, 360 - diff) < 1e-6


def test_gap_filled_total_equals_raw_total(spark):
    import datetime as dt
    rnd = random.Random(5)
    rows = [(f"s{s}", dt.datetime(2020, 1, 1) + dt.timedelta(minutes=30 * rnd.randint(0, 2000)), rnd.random())
            for s in range(5) for _ in range(300)]
    df = spark.createDataFrame(rows, "station STRING, datetime_utc TIMESTAMP_NTZ, rain_mm DOUBLE")
    filled = resample_hourly(df, mean_cols=[]).groupBy("station").agg(F.sum("rain_mm").alias("a"),
                                                                       F.count("*").alias("hours"))
    raw = df.groupBy("station").agg(F.sum("rain_mm").alias("b"),
                                    ((F.unix_timestamp(F.max("datetime_utc").cast("timestamp"))
                                      - F.unix_timestamp(F.min("datetime_utc").cast("timestamp"))) / 3600).alias("span"))
    for r in filled.join(raw, "station").collect():
        assert r.a == pytest.approx(r.b)
        assert r.hours >= math.floor(r.span)
