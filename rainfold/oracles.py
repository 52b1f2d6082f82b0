"""Independent SQL formulations of the registered queries (DuckDB dialect).

These are written from the definitions, not from the Spark code: where
Spark uses windows or level decompositions, the SQL uses correlated
counts, self-joins or generate_series.  Tables are the driver's views.
"""

from __future__ import annotations


def r6(expr: str, bits: int = 30) -> str:
    """Round to ``bits`` binary digits after the leading one (relative)."""
    x = f"CAST({expr} AS DOUBLE)"
    scale = f"pow(2.0::DOUBLE, {bits} - floor(log2(abs({x}))))"
    return (f"(CASE WHEN abs({x}) BETWEEN 1e-280 AND 1e280 THEN floor({x} * {scale} + 0.5) / {scale} "
            f"WHEN abs({x}) < 1e-280 THEN 0.0 ELSE {x} END)")


# --- fixture views -------------------------------------------------------

HH = """hh AS (
  SELECT event_type AS station,
         time_bucket(INTERVAL '30 minutes', ts) AS datetime_utc,
         avg(value) / 10 AS T_avg, min(value) / 10 AS T_min, max(value) / 10 AS T_max,
         sum(value) / 100 AS rain_mm, (max(value) * 7) % 360 AS wind_dir
  FROM events GROUP BY 1, 2)"""

DD = """dd AS (
  SELECT o_orderpriority AS station, CAST(o_orderdate AS DATE) AS date,
         avg(o_totalprice) / 1e4 AS T_avg, min(o_totalprice) / 1e4 AS T_min,
         max(o_totalprice) / 1e4 AS T_max, sum(o_totalprice) / 1e4 AS rain_mm
  FROM orders GROUP BY 1, 2)"""

# gap-filled hourly table: a spine per station from first to last hour
HOURLY = HH + """,
spine AS (
  SELECT station, unnest(generate_series(min(date_trunc('hour', datetime_utc)),
                                         max(date_trunc('hour', datetime_utc)),
                                         INTERVAL 1 HOUR)) AS hour_ts
  FROM hh GROUP BY station),
hourly AS (
  SELECT s.station, s.hour_ts AS datetime_utc,
         coalesce(sum(h.rain_mm), 0) AS rain_mm, avg(h.T_avg) AS T_avg,
         avg(h.T_min) AS T_min, avg(h.T_max) AS T_max, avg(h.wind_dir) AS wind_dir,
         CAST(hour(s.hour_ts) AS INTEGER) AS hour, CAST(year(s.hour_ts) AS INTEGER) AS year,
         CAST(month(s.hour_ts) AS INTEGER) AS month, CAST(s.hour_ts AS DATE) AS day
  FROM spine s LEFT JOIN hh h
    ON h.station = s.station AND date_trunc('hour', h.datetime_utc) = s.hour_ts
  GROUP BY s.station, s.hour_ts)"""

# days with at least 70 % of 24 hours present (fill_gaps=True counts span hours)
VALID_HOURLY = HOURLY + """,
day_cov AS (
  SELECT station, day FROM hourly GROUP BY station, day
  HAVING count(rain_mm) / 24.0 >= 0.70),
valid AS (
  SELECT h.* FROM hourly h
  WHERE EXISTS (SELECT 1 FROM day_cov c WHERE c.station = h.station AND c.day = h.day))"""


def sql(body: str, *views: str) -> str:
    if not views:
        return body.strip()
    return "WITH " + ",\n".join(views) + "\n" + body


ORACLES: dict[str, str] = {}

ORACLES["hour_profile_top3"] = sql(f"""
SELECT station, hour, mean_rain, rank FROM (
  SELECT station, hour, {r6('avg(rain_mm)')} AS mean_rain,
         CAST(row_number() OVER (PARTITION BY station ORDER BY avg(rain_mm) DESC, hour) AS INTEGER) AS rank
  FROM valid GROUP BY station, hour) t
WHERE rank <= 3""", VALID_HOURLY)


# --- numeric helpers (SQL) -----------------------------------------------

def normal_p(z: str) -> str:
    """2(1 − Φ(|z|)) = erfc(x), x = |z|/√2, by Simpson's rule on
    2/√π · exp(−x²) · ∫₀⁷ exp(−u² − 2ux) du (20,000 intervals)."""
    x = f"(abs({z}) / sqrt(2.0))"
    n, width = 20000, 7.0
    h = width / n
    return (f"(exp(-{x} * {x}) * {2 / 3 * h / 1.7724538509055159!r} * list_sum(list_transform(range(0, {n + 1}), "
            f"lambda k: (CASE WHEN k = 0 OR k = {n} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) "
            f"* exp(-(k * {h!r}) * (k * {h!r} + 2 * {x})))))")


def student_p(t: str, df: str) -> str:
    """Two-sided Student-t p with integer df: A&S 26.7.3/4 with the series
    coefficients written as Gamma-function ratios."""
    th = f"atan(abs({t}) / sqrt({df}))"
    lc2 = f"ln(greatest(cos({th}) * cos({th}), 1e-300))"
    even = (f"sin({th}) * (1 + coalesce(list_sum(list_transform(range(1, CAST({df} // 2 AS BIGINT)), "
            f"lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1) + k * {lc2}))), 0))")
    odd = (f"2 / pi() * ({th} + sin({th}) * cos({th}) * (1 + coalesce(list_sum(list_transform("
           f"range(1, CAST(({df} - 3) // 2 + 1 AS BIGINT)), "
           f"lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) + k * {lc2}))), 0)))")
    a = f"(CASE WHEN {df} = 1 THEN 2 / pi() * {th} WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"
    return f"greatest(0.0, least(1.0, 1 - {a}))"


def ks_q(lam: str) -> str:
    s = (f"list_sum(list_transform(range(1, 101), lambda k: 2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END)"
         f" * exp(-2 * k * k * ({lam}) * ({lam}))))")
    return f"(CASE WHEN ({lam}) < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, {s})) END)"


def ks_exact(n1: str, n2: str, d: str) -> str:
    """Exact two-sample p: 1 less the probability that a random order of both
    samples, drawn without replacement, keeps all differences below d."""
    j = "(s - i)"
    inside = f"{j} BETWEEN 0 AND {n2} AND abs(i * {n2} - {j} * {n1}) < {d} * {n1} * {n2} - 0.5"
    came = (f"(acc[i + 1] * greatest({n2} - {j} + 1, 0) + (CASE WHEN i > 0 THEN acc[i] ELSE 0 END) * ({n1} - i + 1))"
            f" / ({n1} + {n2} - s + 1)")
    start = f"list_transform(range(0, {n1} + 1), lambda i: (CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE)"
    end = (f"list_reduce(range(1, {n1} + {n2} + 1), lambda acc, s: list_transform(range(0, {n1} + 1), "
           f"lambda i: (CASE WHEN {inside} THEN {came} ELSE 0 END)::DOUBLE), {start})")
    return f"(1 - ({end})[{n1} + 1])"


def kendall_cdf(n: str, c: str) -> str:
    """P(C ≤ c) of the concordant-pair count of a random permutation of n."""
    pmf = (f"list_reduce(range(2, {n} + 1), lambda acc, m: list_transform(range(0, len(acc) + m - 1), "
           f"lambda cc: list_sum(list_transform(range(greatest(0, cc - m + 1), least(cc, len(acc) - 1) + 1), "
           f"lambda k: acc[k + 1])) / m), [1.0]::DOUBLE[])")
    return f"list_sum(list_slice({pmf}, 1, {c} + 1))"


# --- statistics over a series CTE `ser(sid, pos, x, y, label)` ------------

def mk_sql(ser: str, sid: list[str], min_n: int = 4, variant: str = "library") -> str:
    """Mann-Kendall from the double sum over ordered pairs."""
    k = ", ".join(sid)
    on = " AND ".join(f"a.{c} = b.{c}" for c in sid)
    pair = f"""SELECT {", ".join("a." + c for c in sid)},
           count(*) FILTER (WHERE b.y > a.y) AS conc, count(*) FILTER (WHERE b.y < a.y) AS disc
         FROM {ser} a JOIN {ser} b ON {on} AND a.pos < b.pos GROUP BY ALL"""
    ties = f"""SELECT {k}, sum(t * (t - 1) / 2) AS tp, sum(t * (t - 1) * (2 * t + 5)) AS tv
         FROM (SELECT {k}, y, count(*) AS t FROM {ser} GROUP BY ALL) GROUP BY ALL"""
    base = f"""SELECT g.*, coalesce(p.conc, 0) AS conc, coalesce(p.disc, 0) AS disc, t.tp, t.tv
      FROM (SELECT {k}, count(*) AS n FROM {ser} GROUP BY ALL) g
      LEFT JOIN ({pair}) p USING ({k}) JOIN ({ties}) t USING ({k})"""
    N = "(n * (n - 1) / 2)"
    s = "(conc - disc)"
    var = "((n * (n - 1) * (2 * n + 5) - tv) / 18.0)"
    tau = f"(CASE WHEN {N} - tp > 0 THEN {s} / sqrt({N} * ({N} - tp)) END)"
    z = f"(CASE WHEN {var} > 0 THEN {s} / sqrt({var}) END)"
    cmin = "least(conc, disc)"
    exact = f"(tp = 0 AND (n <= 33 OR {cmin} <= 1))"
    pex = (f"(CASE WHEN n <= 33 THEN least(1.0, 2 * {kendall_cdf('CAST(n AS BIGINT)', f'CAST({cmin} AS BIGINT)')}) "
           f"WHEN {cmin} = 0 THEN 2 * exp(-lgamma(n + 1)) ELSE 2 * exp(-lgamma(n)) END)")
    p = f"(CASE WHEN {tau} IS NULL THEN NULL WHEN {exact} THEN {pex} ELSE {normal_p(z)} END)"
    if variant == "library":
        trend = (f"CASE WHEN n < {min_n} THEN 'insufficient data' WHEN tau > 0 AND p_value < 0.05 THEN 'increasing' "
                 f"WHEN tau < 0 AND p_value < 0.05 THEN 'decreasing' WHEN p_value < 0.05 THEN "
                 f"printf('tau=%.3f (check)', tau) ELSE 'no trend' END")
    else:
        trend = (f"CASE WHEN n < {min_n} THEN 'insufficient data' WHEN p_value < 0.05 AND tau > 0 THEN 'increasing' "
                 f"WHEN p_value < 0.05 AND tau < 0 THEN 'decreasing' WHEN p_value < 0.05 THEN 'no trend' "
                 f"ELSE 'no significant trend' END")
    en = f"n >= {min_n}"
    return f"""SELECT {k}, n,
      CASE WHEN {en} THEN CAST(s AS BIGINT) END AS s, CASE WHEN {en} THEN {r6('var_s')} END AS var_s,
      CASE WHEN {en} THEN {r6('tau')} END AS tau, CASE WHEN {en} THEN {r6('z')} END AS z,
      CASE WHEN {en} THEN {r6('p_value')} END AS p_value, CASE WHEN {en} THEN method END AS method,
      {trend} AS trend,
      coalesce({en} AND p_value < 0.05, false) AS sign_0_05, coalesce({en} AND p_value < 0.01, false) AS sign_0_01,
      coalesce({en} AND p_value < 0.001, false) AS sign_0_001
    FROM (SELECT *, {s} AS s, {var} AS var_s, {tau} AS tau, {z} AS z, {p} AS p_value,
                 CASE WHEN {tau} IS NULL THEN NULL WHEN {exact} THEN 'exact' ELSE 'normal' END AS method
          FROM ({base}))"""


def sen_sql(ser: str, sid: list[str], min_n: int = 4) -> str:
    """Theil-Sen from the sorted list of all pairwise slopes (brute force)."""
    k = ", ".join(sid)
    on = " AND ".join(f"a.{c} = b.{c}" for c in sid)
    slopes = f"""SELECT {", ".join("a." + c for c in sid)}, list_sort(list((b.y - a.y) / (b.x - a.x))) AS sl
        FROM {ser} a JOIN {ser} b ON {on} AND a.pos < b.pos GROUP BY ALL"""
    ties = f"""SELECT {k}, sum(t * (t - 1) * (2 * t + 5)) AS tv
         FROM (SELECT {k}, y, count(*) AS t FROM {ser} GROUP BY ALL) GROUP BY ALL"""
    g = f"SELECT {k}, count(*) AS n, median(y) AS my, median(x) AS mx FROM {ser} GROUP BY ALL"
    big = "len(sl)"
    sig = "sqrt((n * (n - 1) * (2 * n + 5) - tv) / 18.0)"
    ru = f"least(CAST(round_even(({big} + 1.959963984540054 * {sig}) / 2, 0) AS BIGINT), {big} - 1)"
    rl = f"greatest(CAST(round_even(({big} - 1.959963984540054 * {sig}) / 2, 0) AS BIGINT) - 1, 0)"
    med = f"(CASE WHEN {big} % 2 = 1 THEN sl[({big} + 1) // 2] ELSE (sl[{big} // 2] + sl[{big} // 2 + 1]) / 2 END)"
    en = f"n >= {min_n}"
    return f"""SELECT {k}, n, CASE WHEN {en} THEN {r6('slope')} END AS slope,
        CASE WHEN {en} THEN {r6('my - slope * mx')} END AS intercept,
        CASE WHEN {en} THEN {r6('lo')} END AS ci_lower, CASE WHEN {en} THEN {r6('hi')} END AS ci_upper
      FROM (SELECT g.*, {med} AS slope, sl[{rl} + 1] AS lo, sl[{ru} + 1] AS hi
            FROM ({g}) g JOIN ({slopes}) s USING ({k}) JOIN ({ties}) t USING ({k}))"""


def pettitt_sql(ser: str, sid: list[str], min_n: int = 4) -> str:
    """Pettitt U_k as the double sum of signs across each split point."""
    k = ", ".join(sid)
    on = " AND ".join(f"a.{c} = b.{c}" for c in sid)
    idx = f"(SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY {k}) AS n FROM {ser})"
    splits = f"SELECT {k}, n, unnest(range(1, n)) AS kk FROM (SELECT {k}, count(*) AS n FROM {ser} GROUP BY ALL)"
    u = f"""SELECT s.{sid[0]}{''.join(', s.' + c for c in sid[1:])}, s.n, s.kk,
               abs(sum(sign(b.y - a.y))) AS au
        FROM ({splits}) s JOIN {idx} a ON {" AND ".join(f"a.{c} = s.{c}" for c in sid)} AND a.idx < s.kk
        JOIN {idx} b ON {on} AND b.idx >= s.kk GROUP BY ALL"""
    best = f"""SELECT {k}, n, max(au) AS kstat, arg_min(kk, (-au, kk)) AS cp FROM ({u}) GROUP BY ALL"""
    lab = f"SELECT {k}, idx, label FROM {idx}"
    en = f"n >= {min_n}"
    p = "least(1.0, 2 * exp(-2.0 * kstat * kstat / (n * n * n + n * n)))"
    return f"""SELECT b.{k.replace(', ', ', b.')}, b.n, CASE WHEN {en} THEN CAST(cp AS BIGINT) END AS cp_index,
        CASE WHEN {en} THEN l.label END AS cp_label, CASE WHEN {en} THEN CAST(kstat AS DOUBLE) END AS u_stat,
        CASE WHEN {en} THEN {r6(p)} END AS p_value, coalesce({en} AND {p} < 0.05, false) AS significant
      FROM ({best}) b LEFT JOIN ({lab}) l ON {" AND ".join(f"l.{c} = b.{c}" for c in sid)} AND l.idx = b.cp"""


def ols_sql(ser: str, sid: list[str], min_n: int = 3) -> str:
    k = ", ".join(sid)
    r = "(CASE WHEN sxx > 0 AND syy > 0 THEN greatest(-1.0, least(1.0, sxy / sqrt(sxx * syy))) END)"
    t = f"({r} * sqrt((n - 2) / ((1 - {r}) * (1 + {r}))))"
    p = f"(CASE WHEN {r} IS NULL OR n - 2 < 1 THEN NULL WHEN abs({r}) >= 1 THEN 0.0 ELSE {student_p(t, '(n - 2)')} END)"
    en = f"n >= {min_n}"
    return f"""SELECT {k}, n, CASE WHEN {en} AND sxx > 0 THEN {r6('sxy / sxx')} END AS slope,
        CASE WHEN {en} AND sxx > 0 THEN {r6('my - sxy / sxx * mx')} END AS intercept,
        CASE WHEN {en} THEN {r6(r)} END AS r, CASE WHEN {en} THEN {r6(f'{r} * {r}')} END AS r2,
        CASE WHEN {en} THEN {r6(p)} END AS p_value
      FROM (SELECT {k}, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy,
                   avg(x) AS mx, avg(y) AS my FROM {ser} GROUP BY ALL)"""


def trend_row_sql(ser: str, sid: list[str]) -> str:
    k = ", ".join(sid)
    return f"""SELECT {k}, mk.n, mk.tau AS mk_tau, mk.p_value AS mk_p_value, mk.trend AS mk_trend,
        mk.sign_0_05 AS mk_sign_0_05, mk.sign_0_01 AS mk_sign_0_01,
        se.slope AS sens_slope, se.intercept AS sens_intercept, se.ci_lower AS sens_ci_lower,
        se.ci_upper AS sens_ci_upper, pt.cp_index AS pt_cp_index, pt.cp_label AS pt_cp_label,
        pt.u_stat AS pt_u_stat, pt.p_value AS pt_p_value, pt.significant AS pt_significant
      FROM ({mk_sql(ser, sid)}) mk LEFT JOIN ({sen_sql(ser, sid)}) se USING ({k})
      LEFT JOIN ({pettitt_sql(ser, sid)}) pt USING ({k})"""


# --- more fixture views ----------------------------------------------------

DD_YM = DD + """,
mt AS (SELECT station, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
              coalesce(sum(rain_mm), 0) AS total FROM dd GROUP BY ALL)"""

MONTHLY_SER = DD_YM + """,
ser AS (SELECT station, row_number() OVER w - 1 AS pos, CAST(row_number() OVER w - 1 AS DOUBLE) AS x,
               total AS y, printf('%04d-%02d', year, month) AS label
        FROM mt WINDOW w AS (PARTITION BY station ORDER BY year, month))"""

SUMMER = DD + """,
sd AS (SELECT *, CAST(year(date) AS INTEGER) AS year FROM dd
       WHERE month(date) * 100 + day(date) BETWEEN 621 AND 921 AND T_min IS NOT NULL),
vy AS (SELECT station, year FROM sd GROUP BY ALL HAVING count(date) / 93.0 >= 0.70),
days AS (SELECT * FROM sd WHERE (station, year) IN (SELECT (station, year) FROM vy))"""

WARM = SUMMER + """,
th(threshold) AS (VALUES (20.0::DOUBLE), (22.0::DOUBLE), (24.0::DOUBLE), (26.0::DOUBLE)),
wc AS (SELECT d.station, d.year, t.threshold, count(*) FILTER (WHERE d.T_min > t.threshold) AS count
       FROM days d, th t GROUP BY ALL)"""

STREAKS = SUMMER + """,
th(threshold) AS (VALUES (20.0::DOUBLE), (22.0::DOUBLE), (24.0::DOUBLE), (26.0::DOUBLE)),
marked AS (SELECT d.station, d.year, t.threshold, d.date, d.T_min > t.threshold AS above,
                  sum(CASE WHEN d.T_min > t.threshold THEN 0 ELSE 1 END)
                    OVER (PARTITION BY d.station, d.year, t.threshold ORDER BY d.date) AS resets
           FROM days d, th t),
runs AS (SELECT station, year, threshold, resets, count(*) AS len FROM marked WHERE above GROUP BY ALL),
st AS (SELECT k.station, k.year, k.threshold, coalesce(max(r.len), 0) AS longest_streak,
              count(r.len) FILTER (WHERE r.len >= 3) AS n_streaks_min
       FROM (SELECT DISTINCT station, year, threshold FROM marked) k
       LEFT JOIN runs r USING (station, year, threshold) GROUP BY ALL)"""

NIGHTS = HH + """,
nr AS (SELECT *, CASE WHEN hour(datetime_utc) <= 5 THEN CAST(datetime_utc AS DATE) - 1
                      ELSE CAST(datetime_utc AS DATE) END AS night_date
       FROM hh WHERE hour(datetime_utc) >= 23 OR hour(datetime_utc) <= 5),
nights AS (SELECT station, night_date, min(T_min) AS night_T_min, max(T_max) AS night_T_max,
                  count(T_avg) AS readings_count, CAST(year(min(datetime_utc)) AS INTEGER) AS year,
                  count(T_avg) >= 11 AS is_complete
           FROM nr WHERE month(night_date) * 100 + day(night_date) BETWEEN 105 AND 125
           GROUP BY ALL HAVING min(T_min) IS NOT NULL AND max(T_max) IS NOT NULL)"""

HH_Y = HH + """,
hy AS (SELECT *, CAST(year(datetime_utc) AS INTEGER) AS year FROM hh)"""

DD_Y = DD + """,
dy AS (SELECT *, CAST(year(date) AS INTEGER) AS year FROM dd)"""

MONTHS = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"


def _cols(names, f):
    return ", ".join(f(n) for n in names)


ORACLES["hour_profile_extremes"] = sql(f"""
SELECT a.station, a.hour AS max_hour, {r6('a.m')} AS max_mean_rain, b.hour AS min_hour, {r6('b.m')} AS min_mean_rain
FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY m DESC, hour) AS rn FROM prof) a
JOIN (SELECT *, row_number() OVER (PARTITION BY station ORDER BY m ASC, hour) AS rn FROM prof) b
  ON a.station = b.station AND a.rn = 1 AND b.rn = 1""",
    VALID_HOURLY, "prof AS (SELECT station, hour, avg(rain_mm) AS m FROM valid GROUP BY ALL)")

ORACLES["station_hour_comparison"] = sql(f"""
SELECT hour, {r6('l')} AS mean_left, {r6('r')} AS mean_right, {r6('r - l')} AS difference FROM (
  SELECT hour, avg(rain_mm) FILTER (WHERE station = 'click') AS l, avg(rain_mm) FILTER (WHERE station = 'view') AS r
  FROM valid WHERE station IN ('click', 'view') GROUP BY hour)""", VALID_HOURLY)

ORACLES["month_hour_matrix"] = sql(
    "SELECT station, month, " + ", ".join(f"{r6(f'avg(rain_mm) FILTER (WHERE hour = {h})')} AS h{h:02d}"
                                          for h in range(24)) + " FROM valid GROUP BY ALL", VALID_HOURLY)

ORACLES["distribution_shift"] = sql(f"""
SELECT k.station, k.n1, k.n2, {r6('k.d')} AS ks_d, {r6(ks_exact('k.n1', 'k.n2', 'k.d'))} AS ks_p_value, 'exact' AS ks_method,
       {r6('t.m1')} AS mean1, {r6('t.m2')} AS mean2, {r6('t.tt')} AS t, {r6(student_p('t.tt', 't.df'))} AS t_p_value
FROM (SELECT station, max(n1) AS n1, max(n2) AS n2, max(abs(ca / n1 - cb / n2)) AS d FROM (
        SELECT v.station, v.v, count(*) FILTER (WHERE s.sample = 'early') AS ca,
               count(*) FILTER (WHERE s.sample = 'late') AS cb, max(c.n1) AS n1, max(c.n2) AS n2
        FROM (SELECT DISTINCT station, rain_mm AS v FROM samp) v
        JOIN samp s ON s.station = v.station AND s.rain_mm <= v.v
        JOIN (SELECT station, count(*) FILTER (WHERE sample = 'early') AS n1,
                     count(*) FILTER (WHERE sample = 'late') AS n2 FROM samp GROUP BY station) c
          ON c.station = v.station
        GROUP BY v.station, v.v) GROUP BY station) k
JOIN (SELECT station, m1, m2, df, (m1 - m2) / sqrt(sp2 * (1.0 / n1 + 1.0 / n2)) AS tt FROM (
        SELECT station, n1, n2, m1, m2, n1 + n2 - 2 AS df,
               ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS sp2 FROM (
          SELECT station, count(*) FILTER (WHERE sample = 'early') AS n1, count(*) FILTER (WHERE sample = 'late') AS n2,
                 avg(rain_mm) FILTER (WHERE sample = 'early') AS m1, avg(rain_mm) FILTER (WHERE sample = 'late') AS m2,
                 var_samp(rain_mm) FILTER (WHERE sample = 'early') AS v1,
                 var_samp(rain_mm) FILTER (WHERE sample = 'late') AS v2
          FROM samp GROUP BY station))) t USING (station)""", HOURLY,
    """vd AS (SELECT station, day FROM hourly GROUP BY ALL HAVING count(rain_mm) / 24.0 >= 0.70),
ranked AS (SELECT station, day, row_number() OVER (PARTITION BY station ORDER BY day) AS ra,
                  row_number() OVER (PARTITION BY station ORDER BY day DESC) AS rd FROM vd),
samp AS (SELECT h.station, h.rain_mm, 'early' AS sample FROM hourly h JOIN ranked r USING (station, day) WHERE r.ra <= 5
         UNION ALL
         SELECT h.station, h.rain_mm, 'late' AS sample FROM hourly h JOIN ranked r USING (station, day) WHERE r.rd <= 5)""")


def _seasonal_sql(ser_view: str, extra_views: tuple[str, ...]) -> str:
    det = f"""SELECT station, season, n, CAST(s AS DOUBLE) AS s, var_s FROM ({mk_sql('sser', ['station', 'season'], 3)})
              WHERE n >= 3"""
    body = f"""SELECT station, seasons, CASE WHEN v > 0 THEN {r6('st')} END AS s_total,
        CASE WHEN v > 0 THEN {r6('v')} END AS var_s, CASE WHEN v > 0 THEN {r6('z')} END AS z,
        CASE WHEN v > 0 THEN {r6(normal_p('z'))} END AS p_value,
        CASE WHEN NOT (v > 0) THEN 'insufficient data' WHEN z > 0 AND {normal_p('z')} < 0.05 THEN 'increasing'
             WHEN z < 0 AND {normal_p('z')} < 0.05 THEN 'decreasing' ELSE 'no trend' END AS trend
      FROM (SELECT *, CASE WHEN st > 0 THEN (st - 1) / sqrt(v) WHEN st < 0 THEN (st + 1) / sqrt(v) ELSE 0.0 END AS z
            FROM (SELECT station, count(*) AS seasons, sum(s) AS st, sum(var_s) AS v FROM ({det}) GROUP BY station))"""
    return sql(body, *extra_views, ser_view)


# mk_sql rounds var_s; the seasonal sum needs exact values, so use a dedicated unrounded detail
def _season_detail(ser: str) -> str:
    return f"""SELECT station, season, n, CAST(conc - disc AS DOUBLE) AS s,
        (n * (n - 1) * (2 * n + 5) - tv) / 18.0 AS var_s FROM (
      SELECT g.station, g.season, g.n, coalesce(p.conc, 0) AS conc, coalesce(p.disc, 0) AS disc, t.tv
      FROM (SELECT station, season, count(*) AS n FROM {ser} GROUP BY ALL) g
      LEFT JOIN (SELECT a.station, a.season, count(*) FILTER (WHERE b.y > a.y) AS conc,
                        count(*) FILTER (WHERE b.y < a.y) AS disc
                 FROM {ser} a JOIN {ser} b ON a.station = b.station AND a.season = b.season AND a.pos < b.pos
                 GROUP BY ALL) p USING (station, season)
      JOIN (SELECT station, season, sum(t * (t - 1) * (2 * t + 5)) AS tv
            FROM (SELECT station, season, y, count(*) AS t FROM {ser} GROUP BY ALL) GROUP BY ALL) t
        USING (station, season)) WHERE n >= 3"""


def seasonal_sql(views: tuple[str, ...]) -> str:
    body = f"""SELECT station, seasons, CASE WHEN v > 0 THEN {r6('st')} END AS s_total,
        CASE WHEN v > 0 THEN {r6('v')} END AS var_s, CASE WHEN v > 0 THEN {r6('z')} END AS z,
        CASE WHEN v > 0 THEN {r6(normal_p('z'))} END AS p_value,
        CASE WHEN NOT (v > 0) THEN 'insufficient data' WHEN z > 0 AND {normal_p('z')} < 0.05 THEN 'increasing'
             WHEN z < 0 AND {normal_p('z')} < 0.05 THEN 'decreasing' ELSE 'no trend' END AS trend
      FROM (SELECT *, CASE WHEN st > 0 THEN (st - 1) / sqrt(v) WHEN st < 0 THEN (st + 1) / sqrt(v) ELSE 0.0 END AS z
            FROM (SELECT station, count(*) AS seasons, sum(s) AS st, sum(var_s) AS v
                  FROM ({_season_detail('sser')}) GROUP BY station))"""
    return sql(body, *views)


ORACLES["seasonal_mk_monthly_means"] = seasonal_sql((DD, """sser AS (
  SELECT station, CAST(month(date) AS INTEGER) AS season,
         row_number() OVER (PARTITION BY station, month(date) ORDER BY year(date)) - 1 AS pos, avg(rain_mm) AS y
  FROM dd GROUP BY station, year(date), month(date))"""))

ORACLES["seasonal_mk_daily"] = seasonal_sql((DD, """sser AS (
  SELECT station, CAST(month(date) AS INTEGER) AS season,
         row_number() OVER (PARTITION BY station, month(date) ORDER BY year(date), date) - 1 AS pos, rain_mm AS y
  FROM dd WHERE rain_mm IS NOT NULL)"""))

ORACLES["halfhourly_readings"] = sql(
    f"SELECT station, datetime_utc, {r6('T_avg')} AS T_avg, {r6('T_min')} AS T_min, {r6('T_max')} AS T_max, "
    f"{r6('rain_mm')} AS rain_mm, {r6('wind_dir')} AS wind_dir FROM hh", HH)

ORACLES["daily_from_halfhourly"] = sql(f"""
SELECT station, CAST(datetime_utc AS DATE) AS date, {r6('avg(T_avg)')} AS T_avg, {r6('max(T_max)')} AS T_max,
       {r6('min(T_min)')} AS T_min, {r6('coalesce(sum(rain_mm), 0)')} AS rain_mm,
       {r6('(degrees(atan2(avg(sin(radians(wind_dir))), avg(cos(radians(wind_dir))))) + 360) % 360')} AS wind_dir
FROM hh GROUP BY ALL""", HH)

ORACLES["hourly_resample_filled"] = sql(
    f"SELECT station, datetime_utc, {r6('rain_mm')} AS rain_mm, {r6('T_avg')} AS T_avg, {r6('T_min')} AS T_min, "
    f"{r6('T_max')} AS T_max, {r6('wind_dir')} AS wind_dir, hour, year, month FROM hourly", HOURLY)

ORACLES["hourly_sparse_sum"] = sql(
    f"SELECT station, date_trunc('hour', datetime_utc) AS hour_start, {r6('sum(rain_mm)')} AS rain_mm FROM hh GROUP BY ALL",
    HH)

ORACLES["coverage_by_year"] = sql(f"""
SELECT station, year, count(rain_mm) AS present, 365.0::DOUBLE AS expected, {r6('count(rain_mm) / 365.0')} AS pct,
       CASE WHEN count(rain_mm) / 365.0 >= 0.70 THEN 'OK' ELSE 'Incomplete' END AS status,
       count(rain_mm) / 365.0 >= 0.70 AS is_valid
FROM dy GROUP BY ALL""", DD_Y)

ORACLES["valid_year_range"] = sql("""
SELECT station, min(year) AS first_valid, max(year) AS last_valid, count(*) AS n_valid FROM (
  SELECT station, year FROM dy GROUP BY ALL HAVING count(rain_mm) / 365.0 >= 0.70) GROUP BY station""", DD_Y)

ORACLES["dataset_profile"] = sql(
    "SELECT station, count(*) AS rows, count(DISTINCT CAST(datetime_utc AS DATE)) AS days, min(datetime_utc) AS first_ts, "
    "max(datetime_utc) AS last_ts FROM hh GROUP BY ALL", HH)

ORACLES["intensity_histogram"] = sql(f"""
SELECT s.station, b.bin, b.label, count(w.rain_mm) AS count, s.total,
       {r6('CAST(count(w.rain_mm) AS DOUBLE) / s.total * 100')} AS pct
FROM (SELECT station, count(*) AS total FROM wet GROUP BY station) s CROSS JOIN bins b
LEFT JOIN wet w ON w.station = s.station AND w.rain_mm >= b.lo AND (b.hi IS NULL OR w.rain_mm < b.hi)
GROUP BY s.station, b.bin, b.label, s.total""", HH,
    """wet AS (SELECT station, rain_mm FROM hh WHERE rain_mm > 0),
bins(bin, label, lo, hi) AS (VALUES (0, '0-0.2', 0.0, 0.2), (1, '0.2-1', 0.2, 1.0), (2, '1-3', 1.0, 3.0),
  (3, '3-5', 3.0, 5.0), (4, '5-10', 5.0, 10.0), (5, '10-20', 10.0, 20.0), (6, '20+', 20.0, NULL))""")

ORACLES["intensity_vs_time"] = sql(ols_sql("pts", ["station"]), HH, """t0 AS (SELECT station, min(datetime_utc) AS t0 FROM hh GROUP BY station),
pts AS (SELECT h.station, date_diff('microsecond', t0.t0, h.hs) / 3.6e9 AS x, h.y FROM (
          SELECT station, date_trunc('hour', datetime_utc) AS hs, sum(rain_mm) AS y FROM hh WHERE rain_mm > 1 GROUP BY ALL) h
        JOIN t0 USING (station))""")

RAIN_PERIODS = HH_Y + """,
wet AS (SELECT station, year, datetime_utc AS t, rain_mm FROM hy WHERE rain_mm > 0.2),
starts AS (SELECT w.*, NOT EXISTS (SELECT 1 FROM wet p WHERE p.station = w.station AND p.year = w.year
                                     AND p.t < w.t AND p.t >= w.t - INTERVAL 30 MINUTE) AS is_start FROM wet w),
numbered AS (SELECT *, CAST(sum(CASE WHEN is_start THEN 1 ELSE 0 END) OVER (PARTITION BY station, year ORDER BY t)
                            AS BIGINT) AS period_no FROM starts),
periods AS (SELECT station, year, period_no, min(t) AS start, max(t) AS "end", count(*) AS intervals,
                   sum(rain_mm) AS total, max(rain_mm) AS peak FROM numbered GROUP BY ALL)"""

ORACLES["rain_periods"] = sql(
    f"SELECT station, year, period_no, start, \"end\", intervals, {r6('total')} AS total, {r6('peak')} AS peak FROM periods",
    RAIN_PERIODS)

ORACLES["rain_period_counts"] = sql("""
SELECT k.station, k.year, coalesce(c.periods, 0) AS periods
FROM (SELECT s.station, y.year FROM (SELECT DISTINCT station FROM hy) s, (SELECT DISTINCT year FROM hy) y) k
LEFT JOIN (SELECT station, year, count(*) AS periods FROM periods GROUP BY ALL) c USING (station, year)""",
    RAIN_PERIODS)

ORACLES["specific_rain_filtered"] = sql(f"""
SELECT station, year, {r6('avg(h / 1 * 100)')} AS specific_rain, count(*) AS wet_hours FROM (
  SELECT station, year, date_trunc('hour', datetime_utc) AS hs, sum(rain_mm) AS h FROM hy WHERE rain_mm > 0.2 GROUP BY ALL)
GROUP BY ALL""", HH_Y)

ORACLES["specific_rain_any_wet"] = sql(f"""
SELECT station, year, {r6('avg(h / 2 * 100)')} AS specific_rain, count(*) AS wet_hours FROM (
  SELECT station, year, date_trunc('hour', datetime_utc) AS hs, coalesce(sum(rain_mm), 0) AS h,
         bool_or(rain_mm > 0.2) AS wet FROM hy GROUP BY ALL) WHERE wet
GROUP BY ALL""", HH_Y)

ORACLES["yearly_maxima"] = sql(f"""
SELECT k.station, k.year, {r6('d.m')} AS max_daily, {r6('h.m')} AS max_hourly, {r6('x.m')} AS max_30min
FROM (SELECT DISTINCT station, year FROM hy) k
LEFT JOIN (SELECT station, year, max(s) AS m FROM (SELECT station, year, CAST(datetime_utc AS DATE), sum(rain_mm) AS s
           FROM hy GROUP BY ALL) GROUP BY ALL) d USING (station, year)
LEFT JOIN (SELECT station, year, max(s) AS m FROM (SELECT station, year, date_trunc('hour', datetime_utc), sum(rain_mm) AS s
           FROM hy GROUP BY ALL) GROUP BY ALL) h USING (station, year)
LEFT JOIN (SELECT station, year, max(rain_mm) AS m FROM hy WHERE rain_mm > 0 GROUP BY ALL) x USING (station, year)""",
    HH_Y)

ORACLES["yearly_max_trend"] = sql(
    f"SELECT * FROM ({mk_sql('ser', ['station'], 3, 'local')}) WHERE n >= 4", DD_Y,
    """ym AS (SELECT station, year, max(rain_mm) AS m FROM dy GROUP BY ALL),
ser AS (SELECT station, row_number() OVER (PARTITION BY station ORDER BY year) - 1 AS pos,
               CAST(year AS DOUBLE) AS x, m AS y, year AS label FROM ym)""")

HEAVY = DD_Y + """,
wetd AS (SELECT station, year, rain_mm FROM dy WHERE rain_mm > 0),
hv AS (SELECT w.station, w.year, count(*) FILTER (WHERE w.rain_mm > q.p95) AS count, q.p95, q.n_wet
       FROM wetd w JOIN (SELECT station, year, quantile_cont(rain_mm, 0.95) AS p95, count(*) AS n_wet
                         FROM wetd GROUP BY ALL HAVING count(*) >= 10) q USING (station, year)
       GROUP BY w.station, w.year, q.p95, q.n_wet)"""

ORACLES["heavy_event_counts"] = sql(f"SELECT station, year, count, {r6('p95')} AS p95, n_wet FROM hv", HEAVY)

ORACLES["heavy_event_trend"] = sql(mk_sql("ser", ["station"], 3, "local"), HEAVY, """ser AS (
  SELECT station, row_number() OVER (PARTITION BY station ORDER BY year) - 1 AS pos, CAST(year AS DOUBLE) AS x,
         CAST(count AS DOUBLE) AS y, year AS label FROM hv)""")

ORACLES["monthly_totals"] = sql(
    f"SELECT station, year, month, {r6('total')} AS total, {r6('avg(total) OVER (PARTITION BY station, month)')} AS month_mean FROM mt",
    DD_YM)

ORACLES["monthly_climatology"] = sql(
    f"SELECT station, month, {r6('avg(total)')} AS mean_total, count(year) AS n_years FROM mt GROUP BY ALL", DD_YM)

ORACLES["wettest_months"] = sql(f"""
SELECT station, month, {r6('mean_total')} AS mean_total, n_years, {MONTHS}[month] AS month_name, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY station ORDER BY mean_total DESC, month) AS INTEGER) AS rank
  FROM (SELECT station, month, avg(total) AS mean_total, count(year) AS n_years FROM mt GROUP BY station, month))
WHERE rank <= 3""", DD_YM)

ORACLES["climatology_comparison"] = sql(f"""
SELECT month, {r6('l')} AS mean_left, {r6('r')} AS mean_right, {r6('r - l')} AS difference FROM (
  SELECT month, avg(total) FILTER (WHERE station = '1-URGENT') AS l, avg(total) FILTER (WHERE station = '2-HIGH') AS r
  FROM mt WHERE station IN ('1-URGENT', '2-HIGH') GROUP BY month)""", DD_YM)

ORACLES["monthly_trend_table"] = sql(trend_row_sql("ser", ["station", "month"]), DD_YM, """ser AS (
  SELECT station, month, row_number() OVER (PARTITION BY station, month ORDER BY year) - 1 AS pos,
         CAST(row_number() OVER (PARTITION BY station, month ORDER BY year) - 1 AS DOUBLE) AS x,
         total AS y, year AS label FROM mt)""")

ORACLES["annual_trend_table"] = sql(trend_row_sql("ser", ["station"]), DD_Y, """ser AS (
  SELECT station, row_number() OVER (PARTITION BY station ORDER BY year) - 1 AS pos,
         CAST(row_number() OVER (PARTITION BY station ORDER BY year) - 1 AS DOUBLE) AS x, total AS y, year AS label
  FROM (SELECT station, year, coalesce(sum(rain_mm), 0) AS total FROM dy GROUP BY ALL))""")

ORACLES["mann_kendall_monthly"] = sql(mk_sql("ser", ["station"]), MONTHLY_SER)
ORACLES["theil_sen_monthly"] = sql(sen_sql("ser", ["station"]), MONTHLY_SER)
ORACLES["pettitt_monthly"] = sql(pettitt_sql("ser", ["station"]), MONTHLY_SER)
ORACLES["ols_monthly"] = sql(ols_sql("ser", ["station"]), MONTHLY_SER)

ORACLES["night_table"] = sql(
    f"SELECT station, night_date, {r6('night_T_min')} AS night_T_min, {r6('night_T_max')} AS night_T_max, "
    f"readings_count, year, is_complete FROM nights", NIGHTS)

ORACLES["night_coverage"] = sql(f"""
SELECT station, year, count(night_date) AS total, count(*) FILTER (WHERE is_complete) AS complete,
       {r6('count(*) FILTER (WHERE is_complete) / 21.0')} AS pct,
       count(*) FILTER (WHERE is_complete) / 21.0 >= 0.70 AS is_valid
FROM nights GROUP BY ALL""", NIGHTS)

ORACLES["summer_days"] = sql(
    f"SELECT station, date, year, {r6('T_min')} AS T_min, {r6('T_max')} AS T_max FROM days", SUMMER)

ORACLES["warm_counts"] = sql("SELECT station, year, threshold, count FROM wc", WARM)

ORACLES["warm_count_trend"] = sql(ols_sql("ser", ["station", "threshold"]), WARM,
                                  "ser AS (SELECT station, threshold, CAST(year AS DOUBLE) AS x, "
                                  "CAST(count AS DOUBLE) AS y FROM wc)")

ORACLES["warm_streaks"] = sql("SELECT station, year, threshold, longest_streak, n_streaks_min FROM st", STREAKS)

ORACLES["warm_percentiles"] = sql(f"""
SELECT station, year, {r6('quantile_cont(T_min, 0.90)')} AS p90, {r6('quantile_cont(T_min, 0.95)')} AS p95,
       count(T_min) AS n FROM days GROUP BY ALL""", SUMMER)

ORACLES["yearly_box"] = sql(f"""
SELECT station, year, n, {r6('q1')} AS q1, {r6('med')} AS median, {r6('q3')} AS q3, {r6('q3 - q1')} AS iqr,
       {r6('wl')} AS whisker_low, {r6('wh')} AS whisker_high, n_out AS n_outliers FROM (
  SELECT d.station, d.year, q.n, q.q1, q.med, q.q3,
         min(d.T_max) FILTER (WHERE d.T_max >= q.q1 - 1.5 * (q.q3 - q.q1)) AS wl,
         max(d.T_max) FILTER (WHERE d.T_max <= q.q3 + 1.5 * (q.q3 - q.q1)) AS wh,
         count(*) FILTER (WHERE d.T_max < q.q1 - 1.5 * (q.q3 - q.q1) OR d.T_max > q.q3 + 1.5 * (q.q3 - q.q1)) AS n_out
  FROM days d JOIN (SELECT station, year, count(T_max) AS n, quantile_cont(T_max, 0.25) AS q1,
                           quantile_cont(T_max, 0.5) AS med, quantile_cont(T_max, 0.75) AS q3
                    FROM days WHERE T_max IS NOT NULL GROUP BY ALL) q USING (station, year)
  WHERE d.T_max IS NOT NULL GROUP BY ALL)""", SUMMER)

ORACLES["yearly_summary"] = sql(f"""
SELECT station, year, count(*) AS n, count(*) FILTER (WHERE T_min > 20) AS gt_20,
       count(*) FILTER (WHERE T_min > 22) AS gt_22, count(*) FILTER (WHERE T_min > 24) AS gt_24,
       count(*) FILTER (WHERE T_min > 26) AS gt_26, {r6('median(T_min)')} AS T_min_median,
       {r6('median(T_max)')} AS T_max_median
FROM days GROUP BY ALL""", SUMMER)

ORACLES["two_station_warm_counts"] = sql("""
SELECT year, threshold, coalesce(l, 0) AS count_left, coalesce(r, 0) AS count_right,
       coalesce(r, 0) - coalesce(l, 0) AS difference FROM (
  SELECT coalesce(a.year, b.year) AS year, coalesce(a.threshold, b.threshold) AS threshold, a.count AS l, b.count AS r
  FROM (SELECT * FROM wc WHERE station = '1-URGENT') a
  FULL OUTER JOIN (SELECT * FROM wc WHERE station = '2-HIGH') b USING (year, threshold))""", WARM)

ORACLES["two_station_streaks"] = sql("""
SELECT year, threshold, coalesce(l, 0) AS longest_left, coalesce(r, 0) AS longest_right,
       coalesce(r, 0) - coalesce(l, 0) AS difference FROM (
  SELECT coalesce(a.year, b.year) AS year, coalesce(a.threshold, b.threshold) AS threshold,
         a.longest_streak AS l, b.longest_streak AS r
  FROM (SELECT * FROM st WHERE station = '1-URGENT') a
  FULL OUTER JOIN (SELECT * FROM st WHERE station = '2-HIGH') b USING (year, threshold))""", STREAKS)

ORACLES["median_trend_common_years"] = sql(ols_sql("ser", ["station"]), SUMMER, """common AS (
  SELECT year FROM days WHERE station = '1-URGENT' INTERSECT SELECT year FROM days WHERE station = '2-HIGH'),
ser AS (SELECT station, CAST(year AS DOUBLE) AS x, median(T_min) AS y FROM days
        WHERE station IN ('1-URGENT', '2-HIGH') AND year IN (SELECT year FROM common) GROUP BY ALL)""")

ORACLES["warm_mean_trend_table"] = sql(trend_row_sql("ser", ["station"]), SUMMER, """ser AS (
  SELECT station, row_number() OVER (PARTITION BY station ORDER BY year) - 1 AS pos,
         CAST(row_number() OVER (PARTITION BY station ORDER BY year) - 1 AS DOUBLE) AS x, m AS y, year AS label
  FROM (SELECT station, year, avg(T_min) AS m FROM days GROUP BY ALL))""")


# --- cleaning and ingestion --------------------------------------------------

MESSY = """m AS (
  SELECT event_id, value AS v, event_id % 20 AS k,
    CASE WHEN event_id % 20 < 16 THEN ['N', ' nne', 'NE ', 'ene', 'E', 'ESE', 'se', 'SSE', '5', 'SSW', 'sw', 'WSW',
                                       'W', 'wnw', 'NW', 'NNW'][event_id % 20 + 1]
         WHEN event_id % 20 = 16 THEN printf('%.2f', value) WHEN event_id % 20 = 17 THEN '---'
         WHEN event_id % 20 = 18 THEN '' ELSE 'calm' END AS raw_wind_dir,
    CASE WHEN event_id % 20 < 5 THEN printf('%.2f', value)
         WHEN event_id % 20 < 8 THEN replace(printf('%.2f', value), '.', ',')
         WHEN event_id % 20 < 10 THEN '~' || printf('%.2f', value)
         WHEN event_id % 20 = 10 THEN '-----' WHEN event_id % 20 = 11 THEN '---'
         WHEN event_id % 20 = 12 THEN 'O' || printf('%d', CAST(floor(value) AS BIGINT))
         WHEN event_id % 20 = 13 THEN ' ' WHEN event_id % 20 = 14 THEN '12abc'
         ELSE printf('%d', CAST(floor(value * 10) AS BIGINT)) END AS raw_number,
    CASE WHEN event_id % 20 < 10 THEN printf('%d:%02d', event_id % 26, event_id * 7 % 61)
         WHEN event_id % 20 < 15 THEN printf('%d;%02d', event_id % 26, event_id * 7 % 61)
         ELSE printf('%02d%02d', event_id % 26, event_id * 7 % 61) END AS raw_time,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value_with_nulls,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS user_with_nulls,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS type_with_nulls
  FROM events)"""

_DEG = ("CASE upper(trim(raw_wind_dir)) " + " ".join(
    f"WHEN '{p}' THEN {d}" for p, d in [("N", 0.0), ("NNE", 22.5), ("NE", 45.0), ("ENE", 67.5), ("E", 90.0),
                                         ("ESE", 112.5), ("SE", 135.0), ("SSE", 157.5), ("S", 180.0),
                                         ("SSW", 202.5), ("SW", 225.0), ("WSW", 247.5), ("W", 270.0),
                                         ("WNW", 292.5), ("NW", 315.0), ("NNW", 337.5)])
        + " ELSE CASE WHEN regexp_full_match(trim(raw_wind_dir), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') "
          "THEN TRY_CAST(trim(raw_wind_dir) AS DOUBLE) END END")

_NUM = ("replace(replace(translate(replace(replace(trim(raw_number), ',', '.'), '~', ''), 'Oo', '00'), '—', ''), '--', '')")

ORACLES["clean_report_text"] = sql(f"""
SELECT event_id, {r6(_DEG)} AS wind_deg, translate(upper(trim(raw_wind_dir)), '5', 'S') AS wind_dir_norm,
       {r6(f"CASE WHEN {_NUM} IN ('', '-') THEN NULL ELSE TRY_CAST({_NUM} AS DOUBLE) END")} AS number,
       CASE WHEN regexp_full_match(translate(trim(raw_number), 'Oo', '00'), '[0-9]+')
            THEN TRY_CAST(translate(trim(raw_number), 'Oo', '00') AS INTEGER) END AS number_int,
       {r6("CASE WHEN raw_number IN ('-----', '---', '-', '') THEN NULL ELSE TRY_CAST(replace(raw_number, '~', '') AS DOUBLE) END")} AS plain_number,
       CASE WHEN regexp_full_match(tt, '\\d{{1,2}}:\\d{{2}}')
             AND CAST(regexp_extract(tt, '^(\\d+):', 1) AS INTEGER) <= 23
             AND CAST(regexp_extract(tt, ':(\\d+)$', 1) AS INTEGER) <= 59
            THEN printf('%02d:%02d', CAST(regexp_extract(tt, '^(\\d+):', 1) AS INTEGER),
                        CAST(regexp_extract(tt, ':(\\d+)$', 1) AS INTEGER)) END AS time_hhmm
FROM (SELECT *, replace(trim(raw_time), ';', ':') AS tt FROM m)""", MESSY)

ORACLES["category_audit"] = sql(f"SELECT DISTINCT raw_wind_dir FROM m WHERE ({_DEG}) IS NULL", MESSY)

ORACLES["null_profile"] = sql(f"""
SELECT c AS "column", n_null, n_rows, {r6('CAST(n_null AS DOUBLE) / n_rows * 100')} AS pct_null FROM (
  SELECT 'value_with_nulls' AS c, count(*) FILTER (WHERE value_with_nulls IS NULL) AS n_null, count(*) AS n_rows FROM m
  UNION ALL SELECT 'user_with_nulls', count(*) FILTER (WHERE user_with_nulls IS NULL), count(*) FROM m
  UNION ALL SELECT 'type_with_nulls', count(*) FILTER (WHERE type_with_nulls IS NULL), count(*) FROM m)""", MESSY)

_ERA_COLS = (f"station, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, "
             f"CAST(day(date) AS INTEGER) AS day, {r6('T_max')} AS T_max, {r6('T_min')} AS T_min, "
             f"{r6('T_avg')} AS T_avg, {r6('rain_mm')} AS rain_mm, "
             f"{r6('(CAST(floor(T_max * 100) AS BIGINT) % 16) * 22.5')} AS wind_dir")

ORACLES["union_two_eras"] = sql(f"""
SELECT {_ERA_COLS} FROM dd WHERE date < DATE '1998-02-01'
UNION ALL SELECT {_ERA_COLS} FROM dd WHERE date >= DATE '1998-01-01'""", DD)

ORACLES["union_two_eras_dedup"] = sql(f"SELECT {_ERA_COLS} FROM dd", DD)

_ONE = "floor(({x}) * 10 + 0.5) / 10"


def _one(x: str) -> str:
    return _ONE.format(x=x)


REPORT_VALUES = DD + f""",
rv AS (SELECT station, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
              CAST(day(date) AS INTEGER) AS day,
              {_one('(T_min + T_max) / 2')} AS mean_temp_c, {_one('T_max')} AS max_temp_c,
              printf('%02d:%02d', day(date) * 5 % 24, day(date) * 7 % 60) AS max_temp_time,
              {_one('T_min')} AS min_temp_c, printf('%02d:%02d', day(date) * 3 % 24, day(date) * 11 % 60) AS min_temp_time,
              {_one('greatest(0.0, 18.3 - (T_min + T_max) / 2)')} AS heat_deg_days,
              {_one('greatest(0.0, (T_min + T_max) / 2 - 18.3)')} AS cool_deg_days,
              {_one('T_max - T_min')} AS rain_mm, {_one('T_min / 2')} AS avg_wind_kmh, {_one('T_max / 2')} AS max_wind_kmh,
              printf('%02d:%02d', day(date) * 7 % 24, day(date) * 13 % 60) AS max_wind_time,
              ['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW']
                [CAST(floor(T_max * 100) AS BIGINT) % 16 + 1] AS dom_wind_dir
       FROM dd)"""

_RV_NUM = ["mean_temp_c", "max_temp_c", "min_temp_c", "heat_deg_days", "cool_deg_days", "rain_mm", "avg_wind_kmh",
           "max_wind_kmh"]
_RV_COLS = ("station, year, month, day, date, " + ", ".join(f"{r6(c)} AS {c}" for c in _RV_NUM)
            + ", max_temp_time, min_temp_time, max_wind_time, dom_wind_dir")

ORACLES["text_report_roundtrip"] = sql(f"SELECT {_RV_COLS}, 'txt' AS source_format, printf('reports/%s/%d/%02d_NOAA.TXT', station, year, month) AS source_url "
                                       "FROM rv WHERE day % 9 <> 0",
                                       REPORT_VALUES)

ORACLES["html_report_roundtrip"] = sql(f"""
SELECT station, year, month, day, date, {", ".join(f"{r6(c)} AS {c}" for c in _RV_NUM)}, dom_wind_dir,
       'html_old' AS source_format, printf('reports/%s/%d/climatedata%d%d.html', station, year, month, year) AS source_url, 'fog' AS sig_condition, CAST(NULL AS DOUBLE) AS avg_dew_point_c, CAST(NULL AS DOUBLE) AS snow_fall_cm,
       {r6("CAST(printf('%.1f', mean_temp_c - 20) AS DOUBLE)")} AS dep_from_normal_c, {r6("min_temp_c")} AS avg_wet_bulb_c,
       {r6("CAST(printf('%.1f', max_temp_c / 5) AS DOUBLE)")} AS sun_hours,
       {r6('1013.2')} AS avg_sea_level_pressure_hpa, {r6('22.5')} AS max_wind_dir_deg,
       CAST(NULL AS VARCHAR) AS max_temp_time, CAST(NULL AS VARCHAR) AS min_temp_time, CAST(NULL AS VARCHAR) AS max_wind_time
FROM rv""", REPORT_VALUES)

ORACLES["ingest_ledger"] = sql("""
SELECT format, status, count(*) AS documents, CAST(sum(rows) AS BIGINT) AS rows FROM (
  SELECT 'txt' AS format, CASE WHEN count(*) FILTER (WHERE day % 9 <> 0) > 0 THEN 'ok' ELSE 'parsed_zero_rows' END AS status,
         count(*) FILTER (WHERE day % 9 <> 0) AS rows FROM rv GROUP BY station, year, month
  UNION ALL
  SELECT 'html', 'ok', count(*) FROM rv GROUP BY station, year, month
  UNION ALL
  SELECT fmt, CASE WHEN gone THEN 'not_found' WHEN fmt = 'unsupported' THEN 'unsupported_format'
                   WHEN fmt = 'txt' OR lower(html) LIKE '%<table%' THEN 'parsed_zero_rows' ELSE 'no_table' END, 0
  FROM (SELECT html, CASE WHEN u LIKE '%.txt' THEN 'txt' WHEN u LIKE '%.html' OR u LIKE '%.htm' THEN 'html'
                          WHEN regexp_matches(html, '(?is)<(!doctype[[:space:]]+html|html|body|table)\\b') THEN 'html'
                          ELSE 'unsupported' END AS fmt,
               html IS NULL OR trim(html) = '' OR regexp_matches(html, '(?is)<title>[^<]*\\b(404|not found)\\b[^<]*</title>') AS gone
        FROM (SELECT html, lower(regexp_replace(url, '[?#].*$', '')) AS u FROM pages)))
GROUP BY ALL""", REPORT_VALUES)

ORACLES["missing_days"] = sql("""
SELECT station, CAST(d AS DATE) AS date FROM (
  SELECT station, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM dd GROUP BY station)
EXCEPT SELECT station, date FROM dd""", DD)

ORACLES["month_manifest"] = sql("""
SELECT station, CAST(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)),
                                            INTERVAL 1 MONTH)) AS DATE) AS month_start
FROM dd GROUP BY station""", DD)

ORACLES["source_pick"] = sql("""
SELECT station, year, month, arg_min(source, prio) AS picked, count(*) AS n_available FROM (
  SELECT DISTINCT o_orderpriority AS station, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(month(o_orderdate) AS INTEGER) AS month,
         CASE o_orderstatus WHEN 'F' THEN 'txt' WHEN 'P' THEN 'txt_variant' ELSE 'html' END AS source
  FROM orders) s
JOIN (VALUES ('txt', 1), ('txt_variant', 2), ('html', 3)) p(src, prio) ON p.src = s.source
GROUP BY ALL""")


# --- day pages, stacked reports and further compositions ---------------------

_NULLS = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in
                   ["humidity", "avg_wind_kmh", "max_wind_kmh", "pressure", "radiation"])

ORACLES["day_page_roundtrip"] = sql(f"""
SELECT station, datetime_utc, {r6(_one('(T_min + T_max) / 2'))} AS T_avg, {r6(_one('T_max'))} AS T_max,
       {r6(_one('T_min'))} AS T_min, {r6(_one('T_max - T_min'))} AS rain_mm, {r6(_one('wind_dir'))} AS wind_dir, {_NULLS}
FROM hh WHERE day(datetime_utc) % 7 <> 0""", HH)

ORACLES["day_page_rejects"] = sql("""
SELECT DISTINCT station, strftime(CAST(datetime_utc AS DATE), '%Y-%m-%d') AS date, 'Less than 3 tables found' AS error
FROM hh WHERE day(datetime_utc) % 7 = 0""", HH)

_STACK_NULL = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in
                        ["dep_from_normal", "dew_point", "wet_bulb", "heating", "cooling", "sun_hrs", "snow_fall",
                         "pressure", "wind_speed", "wind_max", "wind_max_dir"])

ORACLES["stacked_report_roundtrip"] = sql(f"""
SELECT c.station, CAST(year(c.d) AS INTEGER) AS year, CAST(month(c.d) AS INTEGER) AS month,
       CAST(day(c.d) AS INTEGER) AS day, CAST(c.d AS DATE) AS date,
       {r6(_one('x.T_max'))} AS max, {r6(_one('x.T_min'))} AS min, {r6(_one('(x.T_min + x.T_max) / 2'))} AS avg,
       {r6(_one('x.T_max - x.T_min'))} AS rain, {r6('(CAST(floor(x.T_max * 100) AS BIGINT) % 16) * 22.5')} AS wind_dir,
       CASE WHEN x.T_max IS NOT NULL THEN 'fog' END AS sig_cond, {_STACK_NULL}
FROM (SELECT station, unnest(generate_series(m0, m0 + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d
      FROM (SELECT DISTINCT station, date_trunc('month', date) AS m0 FROM dd)) c
LEFT JOIN dd x ON x.station = c.station AND x.date = CAST(c.d AS DATE)""", DD)

ORACLES["hourly_rain_trend_by_day"] = sql(trend_row_sql("ser", ["station"]), VALID_HOURLY, """ser AS (
  SELECT station, row_number() OVER (PARTITION BY station ORDER BY day) - 1 AS pos,
         CAST(row_number() OVER (PARTITION BY station ORDER BY day) - 1 AS DOUBLE) AS x, m AS y, day AS label
  FROM (SELECT station, day, avg(rain_mm) AS m FROM valid GROUP BY ALL))""")

ORACLES["hourly_null_profile"] = sql(f"""
SELECT station, c AS "column", n_null, n_rows, {r6('CAST(n_null AS DOUBLE) / n_rows * 100')} AS pct_null FROM (
  SELECT station, 'rain_mm' AS c, count(*) FILTER (WHERE rain_mm IS NULL) AS n_null, count(*) AS n_rows FROM hourly GROUP BY ALL
  UNION ALL SELECT station, 'T_avg', count(*) FILTER (WHERE T_avg IS NULL), count(*) FROM hourly GROUP BY ALL
  UNION ALL SELECT station, 'T_min', count(*) FILTER (WHERE T_min IS NULL), count(*) FROM hourly GROUP BY ALL
  UNION ALL SELECT station, 'T_max', count(*) FILTER (WHERE T_max IS NULL), count(*) FROM hourly GROUP BY ALL
  UNION ALL SELECT station, 'wind_dir', count(*) FILTER (WHERE wind_dir IS NULL), count(*) FROM hourly GROUP BY ALL)""",
    HOURLY)

ORACLES["specific_rain_comparison"] = sql(f"""
SELECT coalesce(a.year, b.year) AS year, {r6('a.s')} AS specific_left, {r6('b.s')} AS specific_right,
       {r6('b.s - a.s')} AS difference
FROM (SELECT year, avg(h / 1 * 100) AS s FROM (
        SELECT year, date_trunc('hour', datetime_utc), sum(rain_mm) AS h FROM hy
        WHERE station = 'click' AND rain_mm > 0.2 GROUP BY ALL) GROUP BY year) a
FULL OUTER JOIN (SELECT year, avg(h / 2 * 100) AS s FROM (
        SELECT year, date_trunc('hour', datetime_utc), coalesce(sum(rain_mm), 0) AS h, bool_or(rain_mm > 0.2) AS w
        FROM hy WHERE station = 'view' GROUP BY ALL) WHERE w GROUP BY year) b ON a.year = b.year""", HH_Y)

ORACLES["monthly_trend_results"] = sql(f"""
SELECT station || ' ' || CAST(month AS VARCHAR) AS label, mk_tau, mk_p_value, sens_slope,
       substring(mk_trend, 1, 14) AS trend, CASE WHEN mk_sign_0_05 THEN 'Y' ELSE 'N' END AS sig_0_05,
       pt_cp_label AS cp_label
FROM ({trend_row_sql("ser", ["station", "month"])})""", DD_YM, """ser AS (
  SELECT station, month, row_number() OVER (PARTITION BY station, month ORDER BY year) - 1 AS pos,
         CAST(row_number() OVER (PARTITION BY station, month ORDER BY year) - 1 AS DOUBLE) AS x,
         total AS y, year AS label FROM mt)""")

ORACLES["seasonal_mk_detail"] = sql(f"""
SELECT station, season, n, {r6('s')} AS s, {r6('var_s')} AS var_s FROM ({_season_detail('sser')})""", DD, """sser AS (
  SELECT station, CAST(month(date) AS INTEGER) AS season,
         row_number() OVER (PARTITION BY station, month(date) ORDER BY year(date), date) - 1 AS pos, rain_mm AS y
  FROM dd WHERE rain_mm IS NOT NULL)""")


# --- the night chain and further compositions ----------------------------------

NIGHT_DAYS = NIGHTS + """,
vn AS (SELECT station, year FROM nights GROUP BY ALL HAVING count(*) FILTER (WHERE readings_count >= 8) / 21.0 >= 0.70),
days AS (SELECT station, night_date AS date, year, night_T_min AS T_min, night_T_max AS T_max FROM nights
         WHERE readings_count >= 8 AND (station, year) IN (SELECT (station, year) FROM vn))"""


def _warm(*thresholds: float) -> str:
    values = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    return f"""th(threshold) AS (VALUES {values}),
wc AS (SELECT d.station, d.year, t.threshold, count(*) FILTER (WHERE d.T_min > t.threshold) AS count
       FROM days d, th t GROUP BY ALL)"""


def _runs() -> str:
    return """marked AS (SELECT d.station, d.year, t.threshold, d.date, d.T_min > t.threshold AS above,
                  sum(CASE WHEN d.T_min > t.threshold THEN 0 ELSE 1 END)
                    OVER (PARTITION BY d.station, d.year, t.threshold ORDER BY d.date) AS resets
           FROM days d, th t),
runs AS (SELECT station, year, threshold, resets, count(*) AS len FROM marked WHERE above GROUP BY ALL),
st AS (SELECT k.station, k.year, k.threshold, coalesce(max(r.len), 0) AS longest_streak,
              count(r.len) FILTER (WHERE r.len >= 3) AS n_streaks_min
       FROM (SELECT DISTINCT station, year, threshold FROM marked) k
       LEFT JOIN runs r USING (station, year, threshold) GROUP BY ALL)"""


def _measure_ser() -> str:
    return """ym AS (
  SELECT station, 'mean_T_min' AS measure, year, avg(T_min) AS v FROM days GROUP BY ALL
  UNION ALL SELECT station, 'mean_T_max', year, avg(T_max) FROM days GROUP BY ALL
  UNION ALL SELECT station, 'count_gt_' || replace(regexp_replace(CAST(threshold AS VARCHAR), '[.]0$', ''), '.', '_'), year, CAST(count AS DOUBLE) FROM wc
  UNION ALL SELECT station, 'streak_gt_' || replace(regexp_replace(CAST(threshold AS VARCHAR), '[.]0$', ''), '.', '_'), year,
                   CAST(longest_streak AS DOUBLE) FROM st),
ser AS (SELECT station, measure, row_number() OVER (PARTITION BY station, measure ORDER BY year, v) - 1 AS pos,
               CAST(row_number() OVER (PARTITION BY station, measure ORDER BY year, v) - 1 AS DOUBLE) AS x, v AS y, year AS label
        FROM ym)"""


_NIGHT_TH = (0.5, 1.0, 2.0, 4.0)
_BOX = ORACLES["yearly_box"][ORACLES["yearly_box"].index("SELECT station, year, n, "):]
ORACLES["valid_nights"] = sql(f"SELECT station, date, year, {r6('T_min')} AS T_min, {r6('T_max')} AS T_max FROM days", NIGHT_DAYS)
ORACLES["night_warm_counts"] = sql("SELECT station, year, threshold, count FROM wc", NIGHT_DAYS, _warm(*_NIGHT_TH))
ORACLES["night_percentiles"] = sql(f"""
SELECT station, year, {r6('quantile_cont(T_min, 0.90)')} AS p90, {r6('quantile_cont(T_min, 0.95)')} AS p95,
       count(T_min) AS n FROM days GROUP BY ALL""", NIGHT_DAYS)
ORACLES["night_streaks"] = sql("SELECT station, year, threshold, longest_streak, n_streaks_min FROM st",
                               NIGHT_DAYS, _warm(*_NIGHT_TH), _runs())
ORACLES["night_box"] = sql(_BOX, NIGHT_DAYS)
ORACLES["night_trends"] = sql(trend_row_sql("ser", ["station", "measure"]), NIGHT_DAYS, _warm(*_NIGHT_TH), _runs(), _measure_ser())
ORACLES["warm_measure_trends"] = sql(trend_row_sql("ser", ["station", "measure"]), SUMMER, _warm(20.0, 22.0, 24.0, 26.0),
                                     _runs(), _measure_ser())

ORACLES["rain_period_totals"] = sql(f"""
SELECT station, CAST(sum(periods) AS BIGINT) AS periods, count(*) AS years, {r6('avg(periods)')} AS per_year FROM (
  SELECT k.station, k.year, coalesce(c.periods, 0) AS periods
  FROM (SELECT s.station, y.year FROM (SELECT DISTINCT station FROM hy) s, (SELECT DISTINCT year FROM hy) y) k
  LEFT JOIN (SELECT station, year, count(*) AS periods FROM periods GROUP BY ALL) c USING (station, year))
GROUP BY station""", RAIN_PERIODS)

MAXIMA = HH_Y + ",\n" + DD_Y + """,
mx AS (
  SELECT station, year, max(max_daily) AS max_daily, max(max_hourly) AS max_hourly, max(max_30min) AS max_30min FROM (
    SELECT station, year, max(s) AS max_daily, NULL::DOUBLE AS max_hourly, NULL::DOUBLE AS max_30min
    FROM (SELECT station, year, CAST(datetime_utc AS DATE) AS d, sum(rain_mm) AS s FROM hy GROUP BY ALL) GROUP BY ALL
    UNION ALL SELECT station, year, NULL, max(s), NULL
    FROM (SELECT station, year, date_trunc('hour', datetime_utc) AS h, sum(rain_mm) AS s FROM hy GROUP BY ALL) GROUP BY ALL
    UNION ALL SELECT station, year, NULL, NULL, max(rain_mm) FROM hy WHERE rain_mm > 0 GROUP BY ALL
    UNION ALL SELECT station, year, max(rain_mm), NULL, NULL FROM dy GROUP BY ALL) GROUP BY ALL)"""
ORACLES["yearly_maxima_all_stations"] = sql(
    f"SELECT station, year, {r6('max_daily')} AS max_daily, {r6('max_hourly')} AS max_hourly, {r6('max_30min')} AS max_30min FROM mx", MAXIMA)
ORACLES["yearly_maxima_trends"] = sql(
    f"SELECT * FROM ({mk_sql('ser', ['station', 'measure'], 3, 'local')}) WHERE n >= 4", MAXIMA, """ser AS (
  SELECT station, measure, row_number() OVER (PARTITION BY station, measure ORDER BY year) - 1 AS pos,
         CAST(year AS DOUBLE) AS x, v AS y, year AS label
  FROM (UNPIVOT mx ON max_daily, max_hourly, max_30min INTO NAME measure VALUE v))""")

ORACLES["seasonal_mk_hourly_means"] = seasonal_sql((VALID_HOURLY, """sser AS (
  SELECT station, hour AS season, row_number() OVER (PARTITION BY station, hour ORDER BY day) - 1 AS pos, y FROM (
    SELECT station, hour, day, avg(rain_mm) AS y FROM valid GROUP BY ALL))"""))

ORACLES["two_station_count_trend"] = sql(ols_sql("ser", ["station", "threshold"]), WARM, """ser AS (
  SELECT k.station, k.threshold, CAST(k.year AS DOUBLE) AS x, CAST(coalesce(wc.count, 0) AS DOUBLE) AS y
  FROM (SELECT s.station, y.year, y.threshold FROM (VALUES ('1-URGENT'), ('2-HIGH')) s(station),
               (SELECT DISTINCT year, threshold FROM wc WHERE station IN ('1-URGENT', '2-HIGH')) y) k
  LEFT JOIN wc USING (station, year, threshold))""")

ORACLES["box_on_common_years"] = sql(_BOX.replace("T_max", "T_min").replace("FROM days", "FROM cdays"), SUMMER, """cdays AS (
  SELECT * FROM days WHERE station IN ('1-URGENT', '2-HIGH') AND year IN (
    SELECT year FROM days WHERE station = '1-URGENT' INTERSECT SELECT year FROM days WHERE station = '2-HIGH'))""")

ORACLES["box_outliers"] = sql(f"""
SELECT d.station, d.year, {r6('d.T_max')} AS value, count(*) AS count, d.T_max > q3 AS is_high
FROM days d JOIN (SELECT station, year, quantile_cont(T_max, 0.25) AS q1, quantile_cont(T_max, 0.75) AS q3
                  FROM days GROUP BY ALL) q USING (station, year)
WHERE d.T_max < q1 - 1.5 * (q3 - q1) OR d.T_max > q3 + 1.5 * (q3 - q1)
GROUP BY d.station, d.year, d.T_max, q3""", SUMMER)

ORACLES["heavy_events_whole_record"] = sql(f"""
SELECT w.station, w.year, count(*) FILTER (WHERE w.rain_mm > q.p95) AS count, {r6('q.p95')} AS p95, count(*) AS n_wet
FROM wetd w JOIN (SELECT station, quantile_cont(rain_mm, 0.95) AS p95 FROM wetd GROUP BY station) q USING (station)
GROUP BY w.station, w.year, q.p95 HAVING count(*) >= 10""", HEAVY)

ORACLES["dense_columns"] = sql(f"SELECT event_id, {r6('value_with_nulls')} AS value_with_nulls FROM m", MESSY)

ORACLES["file_roundtrip"] = sql(f"""
SELECT l_returnflag AS station, CAST(l_shipdate AS DATE) AS date, CAST(year(CAST(l_shipdate AS DATE)) AS INTEGER) AS year,
       {r6('sum(l_quantity)')} AS rain_mm, {r6('min(l_quantity)')} AS T_min, {r6('max(l_quantity)')} AS T_max
FROM lineitem GROUP BY 1, 2, 3""")

_LINE = (r"^\s*\d{1,2}\s+-?\d+\.\d\s+-?\d+\.\d\s+\d{1,2}:\d{2}\s+-?\d+\.\d\s+\d{1,2}:\d{2}(?:\s+-?\d+\.\d){5}"
         r"\s+\d{1,2}:\d{2}\s+[A-Z]{1,3}\s*$")
ORACLES["document_report_lines"] = f"""
SELECT doc_id, coalesce(len(ls), 0) AS lines,
       coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '{_LINE}'))), 0) AS accepted
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"""

ORACLES["page_ledger"] = """
WITH p AS (
  SELECT page_id, url, html, lower(regexp_replace(url, '[?#].*$', '')) AS u,
         regexp_matches(html, '(?is)<(!doctype[[:space:]]+html|html|body|table)\\b') AS markup,
         regexp_matches(html, '(?i)<table\\b') AS has_table FROM pages),
f AS (
  SELECT *, CASE WHEN u LIKE '%.txt' THEN 'txt' WHEN u LIKE '%.html' OR u LIKE '%.htm' OR markup THEN 'html' ELSE 'unsupported' END AS format,
         html IS NULL OR trim(html, ' ' || chr(9) || chr(10) || chr(13)) = '' OR regexp_matches(html, '(?is)<title>[^<]*\\b(404|not found)\\b[^<]*</title>') AS gone
  FROM p)
SELECT page_id, TRY_CAST(nullif(regexp_extract(coalesce(url, ''), '/((?:19|20)[0-9]{2})/(0?[1-9]|1[0-2])(?:[^0-9]|$)', 1), '') AS INTEGER) AS year,
       TRY_CAST(nullif(regexp_extract(coalesce(url, ''), '/((?:19|20)[0-9]{2})/(0?[1-9]|1[0-2])(?:[^0-9]|$)', 2), '') AS INTEGER) AS month,
       url, format,
       CASE WHEN gone THEN 'not_found' WHEN format = 'unsupported' THEN 'unsupported_format'
            WHEN format = 'html' AND NOT has_table THEN 'no_table' ELSE 'parsed_zero_rows' END AS status,
       CASE WHEN gone THEN 'document not found' WHEN format = 'unsupported' THEN 'no report format recognised'
            WHEN format = 'html' AND NOT has_table THEN 'no table in the document' ELSE 'no report rows' END AS message,
       CAST(0 AS BIGINT) AS rows
FROM f"""

ORACLES["candidate_sources"] = sql("""
SELECT station, CAST(m AS DATE) AS month_start, CAST(p - CASE WHEN p > 1 THEN 1 ELSE 0 END AS INTEGER) AS priority, url FROM (
  SELECT station, m, 0 AS p, year(m) || '/' || ['Gener', 'Febrer', 'Mar', 'Abril', 'Maig', 'Juny', 'Juliol', 'Agost', 'Setembre',
         'Octubre', 'Novembre', 'Desembre'][month(m)] || '_' || year(m) || '_NOAA.TXT' AS url FROM mm
  UNION ALL
  SELECT station, m, 2, year(m) || '/' || ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September',
         'October', 'November', 'December'][month(m)] || year(m) || '/climatedataout' || month(m) || year(m) || '.html' FROM mm)""", DD,
    """mm AS (SELECT station, unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)),
                                            INTERVAL 1 MONTH)) AS m FROM dd GROUP BY station)""")

ORACLES["daily_all_columns"] = sql(f"""
SELECT station, CAST(datetime_utc AS DATE) AS date, {r6('avg(T_avg)')} AS T_avg, {r6('max(T_max)')} AS T_max, {r6('min(T_min)')} AS T_min,
       {r6('avg(T_avg * 5)')} AS humidity_avg, {r6('sum(rain_mm)')} AS rain_mm, {r6('avg(T_min)')} AS avg_wind_kmh,
       {r6('max(T_max)')} AS max_wind_kmh, {r6('avg(1000 + T_avg)')} AS pressure_avg, {r6('avg(T_max * 10)')} AS radiation_avg
FROM hh GROUP BY ALL""", HH)


# --- stores, ledgers, ordered files, several years ---------------------------

HH_YEARS = HH + """,
hhy AS (SELECT station, datetime_utc - to_years(CAST((day(datetime_utc) * 5 + hour(datetime_utc) // 6) % 8 AS INTEGER)) AS datetime_utc,
               T_avg, T_min, T_max, rain_mm FROM hh)"""

ORACLES["stored_reports"] = sql("""
SELECT m.station, CAST(m.m AS DATE) AS month_start,
       CASE WHEN coalesce(n, 0) = 0 OR kind = 3 THEN NULL
            WHEN kind IN (0, 2) THEN place || '/' || year(m.m) || '/' || ['Gener', 'Febrer', 'Mar', 'Abril', 'Maig', 'Juny', 'Juliol', 'Agost',
                 'Setembre', 'Octubre', 'Novembre', 'Desembre'][month(m.m)] || '_' || year(m.m) || '_NOAA.TXT'
            ELSE place || '/' || year(m.m) || '/' || strftime(m.m, '%B') || year(m.m) || '/climatedataout' || month(m.m) || year(m.m) || '.html'
       END AS picked,
       CAST(CASE WHEN coalesce(n, 0) = 0 OR kind = 3 THEN 0 WHEN kind = 2 THEN 2 ELSE 1 END AS BIGINT) AS n_available,
       CASE WHEN coalesce(n, 0) = 0 OR kind = 3 THEN NULL WHEN kind IN (0, 2) THEN 'txt' ELSE 'html' END AS format,
       CASE WHEN coalesce(n, 0) = 0 OR kind = 3 THEN 'not_found' WHEN kind IN (0, 2) AND plain = 0 THEN 'parsed_zero_rows' ELSE 'ok' END AS status,
       CAST(CASE WHEN coalesce(n, 0) = 0 OR kind = 3 THEN 0 WHEN kind IN (0, 2) THEN plain ELSE n END AS BIGINT) AS rows
FROM (SELECT *, (year(m) + month(m)) % 4 AS kind, regexp_replace(station, '[^A-Za-z0-9]+', '_', 'g') AS place FROM mm) m
LEFT JOIN (SELECT station, date_trunc('month', date) AS m, count(*) AS n, count(*) FILTER (WHERE day(date) % 9 <> 0) AS plain FROM dd GROUP BY ALL) d
  ON d.station = m.station AND d.m = m.m""", DD,
    """mm AS (SELECT station, unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)),
                                            INTERVAL 1 MONTH)) AS m FROM dd GROUP BY station)""")

ORACLES["time_ordered_sink"] = sql("""
SELECT station, strftime(datetime_utc, '%Y-%m') AS month, count(*) AS rows, min(datetime_utc) AS first_time, max(datetime_utc) AS last_time,
       true AS ascending, true AS disjoint
FROM hhy GROUP BY 1, 2""", HH_YEARS)

ORACLES["csv_reject_ledger"] = sql("""
SELECT event_id, status, CASE WHEN status = 'good' THEN TRY_CAST(raw_number AS DOUBLE) END AS value,
       CASE WHEN status <> 'good' THEN event_id || ',' || event_id || ',' ||
            CASE WHEN contains(raw_number, ',') THEN '"' || raw_number || '"' ELSE raw_number END END AS record,
       count(*) OVER (PARTITION BY status) AS of
FROM (SELECT *, CASE WHEN k < 5 OR k = 13 OR k >= 15 THEN 'good' ELSE 'rejected' END AS status FROM m)""", MESSY)

ORACLES["preview_by_time"] = sql(f"""
SELECT station, CAST(CASE WHEN up <= 3 THEN up ELSE -down END AS INTEGER) AS place, datetime_utc, {r6('T_avg')} AS T_avg FROM (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY datetime_utc) AS up,
         row_number() OVER (PARTITION BY station ORDER BY datetime_utc DESC) AS down FROM hh)
WHERE up <= 3 OR down <= 3""", HH)

ORACLES["all_station_years"] = sql(f"""
SELECT station, month, ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][month] AS label,
       max(n) FILTER (WHERE src = 1) AS first_days, max(n) FILTER (WHERE src = 2) AS second_days,
       {r6('round(100 * sum(n) / sum(sum(n)) OVER (PARTITION BY station), 1)')} AS share_pct
FROM (SELECT station, CAST(month(date) AS INTEGER) AS month, 1 AS src, count(*) AS n FROM dd GROUP BY ALL
      UNION ALL
      SELECT l_returnflag, CAST(month(l_shipdate) AS INTEGER), 2, count(DISTINCT CAST(l_shipdate AS DATE)) FROM lineitem GROUP BY 1, 2)
GROUP BY station, month""", DD)

ORACLES["hour_labels"] = sql(f"""
SELECT station, lpad(CAST(hour AS VARCHAR), 2, '0') || ':00' AS hour, {r6('avg(rain_mm)')} AS mean_rain FROM valid GROUP BY station, valid.hour""", VALID_HOURLY)

ORACLES["month_hour_over_years"] = sql("""
SELECT s.station, CAST(y.year AS INTEGER) AS year, coalesce(c.periods, 0) AS periods
FROM (SELECT DISTINCT station FROM kept) s, (SELECT DISTINCT year FROM kept) y
LEFT JOIN (SELECT station, year, count(*) AS periods FROM wet
           WHERE prev IS NULL OR datetime_utc - prev > INTERVAL 30 MINUTE GROUP BY ALL) c ON c.station = s.station AND c.year = y.year""", HH_YEARS,
    """kept AS (SELECT *, year(datetime_utc) AS year FROM hhy WHERE station <> 'click' OR year(datetime_utc) <> 2021),
wet AS (SELECT *, lag(datetime_utc) OVER (PARTITION BY station, year ORDER BY datetime_utc) AS prev FROM kept WHERE rain_mm > 0.2)""")

_NIGHTS_Y = HH_YEARS + NIGHTS[len(HH):].replace("FROM hh WHERE", "FROM hhy WHERE") + """,
vn AS (SELECT station, year FROM nights GROUP BY ALL HAVING count(*) / 21.0 >= 0.20),
days AS (SELECT station, night_date AS date, year, night_T_min AS T_min, night_T_max AS T_max FROM nights
         WHERE readings_count >= 1 AND (station, year) IN (SELECT (station, year) FROM vn))"""
ORACLES["night_trends_over_years"] = sql(trend_row_sql("ser", ["station", "measure"]), _NIGHTS_Y, _warm(*_NIGHT_TH), _runs(), _measure_ser())
