import random

import pytest
from pyspark.sql import functions as F

from brute import mk_s, mk_var, pettitt as bf_pettitt
from rainfold.operators import trend


def _series(spark, data):
    rows = [(sid, i, float(v)) for sid, ys in data.items() for i, v in enumerate(ys)]
    df = spark.createDataFrame(rows, "sid STRING, t INT, v DOUBLE")
    return trend.make_series(df, ["sid"], "t", "v")


def test_mk_micro_fixtures(spark):
    data = {"up": [1, 2, 3, 4, 5], "const": [4, 4, 4, 4], "short": [1, 2, 3],
            "ties": [1, 1, 2, 3, 3, 3]}
    out = {r.sid: r for r in trend.mann_kendall(_series(spark, data), ["sid"]).collect()}
    assert out["up"].s == 10 and out["up"].tau == pytest.approx(1.0)
    assert out["const"].tau is None and out["const"].trend == "no trend"
    assert out["short"].trend == "insufficient data"
    assert out["ties"].var_s == pytest.approx(71 / 3)
    # exact p for n=5 monotone: 2/5! = 1/60
    assert out["up"].p_value == pytest.approx(2 / 120) and out["up"].method == "exact"


def test_mk_matches_brute_force(spark):
    rnd = random.Random(7)
    data = {f"s{k}": [rnd.choice([rnd.random(), 0.0, 1.0, 0.5]) for _ in range(rnd.randint(4, 70))]
            for k in range(25)}
    out = {r.sid: r for r in trend.mann_kendall(_series(spark, data), ["sid"]).collect()}
    for k, ys in data.items():
        assert out[k].s == mk_s(ys), k
        assert out[k].var_s == pytest.approx(mk_var(ys)), k


def test_pettitt_matches_brute_force(spark):
    rnd = random.Random(3)
    data = {f"s{k}": [float(rnd.randint(0, 6)) for _ in range(rnd.randint(4, 40))] for k in range(20)}
    data["step"] = [1, 1, 1, 5, 5, 5]
    out = {r.sid: r for r in trend.pettitt(_series(spark, data), ["sid"]).collect()}
    for k, ys in data.items():
        cp, u, p = bf_pettitt(ys)
        assert (out[k].cp_index, out[k].u_stat) == (cp, u), k
        assert out[k].p_value == pytest.approx(p), k
    assert out["step"].cp_index == 3 and out["step"].u_stat == 9


def test_seasonal_mk(spark):
    rows = []
    rnd = random.Random(5)
    for m in range(1, 4):
        for y in range(2000, 2010):
            rows.append(("a", m, y, float(rnd.randint(0, 5))))
    df = spark.createDataFrame(rows, "sid STRING, season INT, year INT, v DOUBLE")
    s = trend.make_series(df, ["sid", "season"], "year", "v")
    overall, detail = trend.seasonal_mann_kendall(s, ["sid"], "season")
    det = {r.season: r for r in detail.collect()}
    tot_s = 0
    for m in range(1, 4):
        ys = [r[3] for r in rows if r[1] == m]
        assert det[m].s == mk_s(ys)
        tot_s += mk_s(ys)
    assert overall.collect()[0].s_total == tot_s


def test_ols(spark):
    data = {"line": [2, 4, 6, 8.5, 9]}
    out = trend.ols(_series(spark, data), ["sid"]).collect()[0]
    import numpy as np
    x = np.arange(5); y = np.array(data["line"])
    b, a = np.polyfit(x, y, 1)
    assert out.slope == pytest.approx(b) and out.intercept == pytest.approx(a)
    assert out.r == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert 0 <= out.p_value < 0.01


def test_student_t_p_values(spark):
    from rainfold.functions.numeric import student_t_two_sided_p
    # published two-sided critical values: t_{0.975} for df 1, 2, 5, 10, 30
    crit = {1: 12.706204736, 2: 4.302652730, 5: 2.570581836, 10: 2.228138852, 30: 2.042272456}
    df = spark.createDataFrame([(float(t), d) for d, t in crit.items()], "t DOUBLE, d INT")
    for r in df.select("d", student_t_two_sided_p(F.col("t"), F.col("d")).alias("p")).collect():
        assert r.p == pytest.approx(0.05, abs=1e-6)


def test_normal_p(spark):
    from rainfold.functions.numeric import normal_two_sided_p
    df = spark.createDataFrame([(1.959963984540054,), (2.5758293035489,)], "z DOUBLE")
    ps = [r.p for r in df.select(normal_two_sided_p(F.col("z")).alias("p")).collect()]
    assert ps[0] == pytest.approx(0.05, abs=2e-7) and ps[1] == pytest.approx(0.01, abs=2e-7)


def test_theil_sen_matches_brute_force(spark):
    import math
    from brute import sen, median
    from rainfold.operators.theil_sen import theil_sen
    rnd = random.Random(11)
    data = {f"s{k}": [round(rnd.uniform(-5, 5), 3) if rnd.random() > 0.2 else 1.0
                      for _ in range(rnd.randint(4, 45))] for k in range(8)}
    data["line"] = [2, 4, 6, 8]
    out = {r.sid: r for r in theil_sen(_series(spark, data), ["sid"]).collect()}
    for k, ys in data.items():
        med, sl = sen(ys)
        assert out[k].slope == pytest.approx(med, abs=1e-12), k
        assert out[k].intercept == pytest.approx(median(ys) - med * (len(ys) - 1) / 2, abs=1e-9), k
        from collections import Counter
        n, big = len(ys), len(sl)
        sig = math.sqrt((n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in Counter(ys).values())) / 18)
        ru = min(int(round((big + 1.959963984540054 * sig) / 2)), big - 1)
        rl = max(int(round((big - 1.959963984540054 * sig) / 2)) - 1, 0)
        assert out[k].ci_lower == pytest.approx(sl[rl], abs=1e-12), k
        assert out[k].ci_upper == pytest.approx(sl[ru], abs=1e-12), k
    assert out["line"].slope == 2 and out["line"].intercept == 2


def test_native_kendall_table_matches_recurrence(spark):
    got = {(r.kn, r.kc): r.kcdf for r in trend.kendall_cdf_table(spark).collect()}
    ref = {(n, c): v for n, c, v in trend._kendall_cdf_rows()}
    assert set(got) == set(ref)
    assert all(abs(got[k] - ref[k]) < 1e-12 for k in ref)
    # published small-sample value: P(C ≤ 0) = 1/n!
    assert got[(5, 0)] == pytest.approx(1 / 120)


def test_theil_sen_many_equal_slopes(spark):
    from brute import sen
    from rainfold.operators.theil_sen import theil_sen
    # long runs of a constant step give hundreds of identical pairwise slopes
    data = {"steps": [float(i // 3) for i in range(60)], "flat": [5.0] * 30 + [6.0] * 30}
    out = {r.sid: r for r in theil_sen(_series(spark, data), ["sid"]).collect()}
    for k, ys in data.items():
        med, sl = sen(ys)
        assert out[k].slope == pytest.approx(med, abs=1e-9), k


def test_theil_sen_collapsed_bracket_is_exact(spark):
    from rainfold.operators.theil_sen import theil_sen
    data = {"line": [2.0 * i + 1.0 for i in range(40)]}  # 780 identical slopes
    r = theil_sen(_series(spark, data), ["sid"]).collect()[0]
    assert r.slope == 2.0 and r.intercept == 1.0 and r.ci_lower == 2.0 and r.ci_upper == 2.0


def test_kolmogorov_tail_published_values(spark):
    from rainfold.functions.numeric import kolmogorov_q
    # asymptotic Kolmogorov critical values: Q(1.3581) = 0.05, Q(1.6276) = 0.01, Q(1.2239) = 0.10
    df = spark.createDataFrame([(1.3581,), (1.6276,), (1.2239,), (0.1,)], "l DOUBLE")
    q = [r.q for r in df.select(kolmogorov_q(F.col("l")).alias("q")).collect()]
    assert q[0] == pytest.approx(0.05, abs=2e-4) and q[1] == pytest.approx(0.01, abs=1e-4)
    assert q[2] == pytest.approx(0.10, abs=3e-4) and q[3] == 1.0


def test_ks_two_sample_statistic(spark):
    rows = [("a", "early", float(v)) for v in (1, 2, 3, 4)] + [("a", "late", float(v)) for v in (3, 4, 5, 6)]
    df = spark.createDataFrame(rows, "station STRING, sample STRING, v DOUBLE")
    r = trend.two_sample_tests(df, ["station"], "sample", "v").collect()[0]
    assert (r.n1, r.n2, r.ks_d, r.mean1, r.mean2) == (4, 4, 0.5, 2.5, 4.5)
    assert r.t == pytest.approx(-2.190890, abs=1e-6) and r.t_p_value == pytest.approx(0.07098765, abs=1e-7)  # 6 degrees of freedom: closed form


@pytest.mark.parametrize("scale", [1e-13, 1.0, 1e9])
def test_sen_is_exact_at_every_scale(scale):
    import numpy as np
    from rainfold.operators import theil_sen as ts
    rng = np.random.default_rng(5)
    x = np.arange(400.0)
    y = (rng.normal(size=400) + 0.001 * x) * scale
    dx = x[None, :] - x[:, None]
    all_slopes = np.sort(((y[None, :] - y[:, None])[dx > 0]) / dx[dx > 0])
    before = ts.LISTED
    ts.LISTED = 3000  # make the search narrow its bracket several times
    try:
        ranks = [0, 17, len(all_slopes) // 2, len(all_slopes) - 1]
        assert ts.select_slopes(x, y, ranks) == [all_slopes[r] for r in ranks]
    finally:
        ts.LISTED = before


def test_sen_equal_slopes_and_repeated_x():
    import numpy as np
    from rainfold.operators import theil_sen as ts
    x = np.repeat(np.arange(200.0), 2)
    y = np.where(np.arange(400) % 7 == 0, 3.0, np.floor(x / 10))
    dx = x[None, :] - x[:, None]
    all_slopes = np.sort(((y[None, :] - y[:, None])[dx > 0]) / dx[dx > 0])
    before = ts.LISTED
    ts.LISTED = 2000
    try:
        ranks = list(range(0, len(all_slopes), 9973)) + [len(all_slopes) - 1]
        assert ts.select_slopes(x, y, ranks) == [all_slopes[r] for r in ranks]
    finally:
        ts.LISTED = before
    assert ts.sen_statistics(np.ones(5), np.arange(5.0)) is None


def test_tails_keep_relative_precision(spark):
    from rainfold.functions.numeric import normal_two_sided_p, student_t_two_sided_p
    # closed forms: erfc by math.erfc; Student: df 1 is Cauchy, df 2 is algebraic
    zs = [0.0, 0.3, 1.0, 2.0, 2.2, 4.0, 6.5, 9.0]
    df = spark.createDataFrame([(z,) for z in zs], "z DOUBLE")
    import math
    for r in df.select("z", normal_two_sided_p(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=1e-12)
    ts = [0.01, 0.7, 3.0, 50.0, 1e5]
    rows = [(t, d) for t in ts for d in (1, 2)]
    got = {(r.t, r.d): r.p for r in spark.createDataFrame(rows, "t DOUBLE, d INT")
           .select("t", "d", student_t_two_sided_p(F.col("t"), F.col("d")).alias("p")).collect()}
    for t in ts:
        assert got[t, 1] == pytest.approx(2 / math.pi * math.atan(1 / t), rel=1e-9)
        s = t / math.sqrt(2 + t * t)
        assert got[t, 2] == pytest.approx(2 / (2 + t * t) / (1 + s), rel=1e-9)
    # both forms meet where the large-df form takes over, and stay finite far beyond it
    near = spark.createDataFrame([(3.0, 19_999), (3.0, 20_001), (3.0, 10**11)], "t DOUBLE, d BIGINT")
    a, b, c = [r.p for r in near.orderBy("d").select(student_t_two_sided_p(F.col("t"), F.col("d")).alias("p")).collect()]
    assert a == pytest.approx(b, rel=1e-6) and c == pytest.approx(math.erfc(3 / math.sqrt(2)), rel=1e-8)


def test_small_p_values_survive_the_output_rounding(spark):
    from rainfold.plans.output import finalize
    df = spark.createDataFrame([(1.2345678901e-11, 0.1 + 0.2, 0.0, None)], "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    r = finalize(df).collect()[0]
    assert r.a == pytest.approx(1.2345678901e-11, rel=1e-9) and r.b == pytest.approx(0.3, rel=1e-9) and (r.c, r.d) == (0.0, None)


def test_theil_sen_fractional_x(spark):
    from brute import sen
    from rainfold.operators.theil_sen import theil_sen
    rnd = random.Random(21)
    xs = [round(0.1 * i + rnd.random() * 0.05, 4) for i in range(30)]
    ys = [round(rnd.uniform(-1, 1), 3) for _ in xs]
    df = spark.createDataFrame([("a", i, x, y) for i, (x, y) in enumerate(zip(xs, ys))],
                               "sid STRING, t INT, xv DOUBLE, v DOUBLE")
    s = trend.make_series(df, ["sid"], "t", "v", x="xv")
    med, _ = sen(ys, xs)
    assert theil_sen(s, ["sid"]).collect()[0].slope == pytest.approx(med, abs=1e-12)
