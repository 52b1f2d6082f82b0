"""Grouped aggregations.

Exact percentiles are computed from value counts: rows are first combined
into (keys, value, count) — a map-side-combined shuffle that splits a hot
key across tasks by value — then cumulative counts over the *distinct*
values of each group locate the order statistics, which are linearly
interpolated (numpy's default rule).  No group is ever collected into a
list, and the cumulative counts are two-level (blocks of distinct values).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainfold.operators.blocks import running, value_blocks
from rainfold.session import materialise


def _name(p: float, prefix: str = "p") -> str:
    txt = f"{p * 100:g}".replace(".", "_")
    return f"{prefix}{txt}"


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(keys, _v, _c): non-null values collapsed to counts (map-side combined)."""
    return (df.where(F.col(value).isNotNull())
            .groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))


def quantiles_from_counts(counts: DataFrame, by: Sequence[str], probs: Sequence[float],
                          names: Sequence[str], with_count: bool = True) -> DataFrame:
    """Linear-interpolation quantiles from a value-count table, which is
    written first: blocks, offsets and positions all read it."""
    by = list(by)
    counts = materialise(counts.select(*by, "_v", "_c"), "value-counts")
    cum = running(value_blocks(counts, by, "_v"), by, "_block", ["_v"], {"_before": F.col("_c")}, {"_n": "_before"})
    cum = cum.select(*by, "_v", (F.col("_before") + F.col("_c")).alias("_cum"), "_n")
    aggs: list[Column] = [F.first("_n").alias("_n")]
    for p, nm in zip(probs, names):
        h = (F.col("_n") - 1) * F.lit(float(p))
        aggs.append(F.min(F.when(F.col("_cum") > F.floor(h), F.col("_v"))).alias(f"_lo_{nm}"))
        aggs.append(F.min(F.when(F.col("_cum") > F.ceil(h), F.col("_v"))).alias(f"_hi_{nm}"))
    g = cum.groupBy(*by).agg(*aggs)
    outs = []
    for p, nm in zip(probs, names):
        h = (F.col("_n") - 1) * F.lit(float(p))
        frac = h - F.floor(h)
        lo_v, hi_v = F.col(f"_lo_{nm}"), F.col(f"_hi_{nm}")
        outs.append((lo_v + frac * (hi_v - lo_v)).alias(nm))
    cols = [*by, *outs]
    if with_count:
        cols.append(F.col("_n").alias("n"))
    return g.select(*cols)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str] | None = None, with_count: bool = True) -> DataFrame:
    """Exact linear-interpolation quantiles per group.

    For n non-null values and probability p, h = (n-1)p; the result is
    x[floor h] + (h - floor h)(x[ceil h] - x[floor h]) with 0-based order
    statistics x[i].
    """
    names = list(names) if names else [_name(p) for p in probs]
    return quantiles_from_counts(value_counts(df, by, value), by, probs, names, with_count)


def grouped_total(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """A5: grouped sum; an all-null group sums to 0 as in the reference."""
    return df.groupBy(*by).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(out))


def monthly_totals(daily: DataFrame, by: Sequence[str] = ("station",), date: str = "date",
                   value: str = "rain_mm") -> DataFrame:
    """A5 + Q14: total per (keys, year, month) and the mean of that month over years present."""
    by = list(by)
    t = grouped_total(daily.withColumn("year", F.year(date)).withColumn("month", F.month(date)),
                      [*by, "year", "month"], value, "total")
    w = Window.partitionBy(*by, "month")
    return t.withColumn("month_mean", F.avg("total").over(w))


def monthly_climatology(daily: DataFrame, by: Sequence[str] = ("station",), date: str = "date",
                        value: str = "rain_mm") -> DataFrame:
    """Mean of monthly totals over the years present, per (keys, month)."""
    by = list(by)
    t = grouped_total(daily.withColumn("year", F.year(date)).withColumn("month", F.month(date)),
                      [*by, "year", "month"], value, "total")
    return t.groupBy(*by, "month").agg(F.avg("total").alias("mean_total"), F.count("year").alias("n_years"))


def threshold_counts(df: DataFrame, by: Sequence[str], value: str, thresholds: Sequence[float],
                     long: bool = True) -> DataFrame:
    """Count of values strictly above each threshold, one pass.

    Thresholds become conditional aggregates of a single ``groupBy`` (no
    row replication); ``long=True`` unpivots to (keys, threshold, count).
    """
    by = list(by)
    cols = [F.count_if(F.col(value) > F.lit(float(t))).alias(f"gt_{i}") for i, t in enumerate(thresholds)]
    wide = df.groupBy(*by).agg(*cols)
    if not long:
        return wide
    stacked = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"gt_{i}").alias("count"))
                                  for i, t in enumerate(thresholds)])).alias("_s")
    return wide.select(*by, stacked).select(*by, "_s.threshold", "_s.count")


# Rain-intensity bin edges (mm per 30 min), left-closed, last bin open.
INTENSITY_EDGES = [0.0, 0.2, 1.0, 3.0, 5.0, 10.0, 20.0]
INTENSITY_LABELS = ["0-0.2", "0.2-1", "1-3", "3-5", "5-10", "10-20", "20+"]


def histogram(df: DataFrame, by: Sequence[str], value: str, edges: Sequence[float] = INTENSITY_EDGES,
              labels: Sequence[str] = INTENSITY_LABELS, where: Column | None = None,
              pct_decimals: int | None = None) -> DataFrame:
    """Left-closed bins [e_i, e_{i+1}) with an open last bin; empty bins kept.

    One aggregation with a conditional count per bin, unpivoted to long
    form; the share of the total is exact unless ``pct_decimals`` asks for
    the report's half-to-even rounding (B22).
    """
    by = list(by)
    src = df.where(where) if where is not None else df
    v = F.col(value)
    conds = []
    for i, lo in enumerate(edges):
        c = v >= F.lit(float(lo))
        if i + 1 < len(edges):
            c = c & (v < F.lit(float(edges[i + 1])))
        conds.append(F.count_if(c).alias(f"b_{i}"))
    wide = src.groupBy(*by).agg(F.count(v).alias("total"), *conds)
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(lab).alias("label"),
                                           F.col(f"b_{i}").alias("count"))
                                  for i, lab in enumerate(labels)])).alias("_s")
    pct = F.col("_s.count") / F.col("total") * 100
    if pct_decimals is not None:
        pct = F.bround(pct, pct_decimals)
    return (wide.select(*by, "total", stacked)
            .select(*by, "_s.bin", "_s.label", "_s.count", "total", pct.alias("pct")))


def heavy_event_counts(df: DataFrame, by: Sequence[str], period: str, value: str, p: float = 0.95,
                       min_wet: int = 10, whole_record: bool = False) -> DataFrame:
    """Per (keys, period): among wet rows (value > 0), count of rows above
    that period's own P95, or with ``whole_record`` above the P95 of all the
    periods of the key; periods with fewer than ``min_wet`` wet rows are skipped.
    Both the percentile and the count come from the value-count table."""
    by = list(by)
    keys = [*by, period]
    counts = value_counts(df.where(F.col(value) > 0), keys, value)
    if whole_record:
        total = counts.groupBy(*by, "_v").agg(F.sum("_c").alias("_c"))
        q = counts.groupBy(*keys).agg(F.sum("_c").alias("n")).where(F.col("n") >= min_wet) \
            .join(quantiles_from_counts(total, by, [p], ["p_thr"]).drop("n"), by)
    else:
        q = quantiles_from_counts(counts, keys, [p], ["p_thr"]).where(F.col("n") >= min_wet)
    return (counts.join(q, on=keys, how="inner")
            .groupBy(*keys)
            .agg(F.sum(F.when(F.col("_v") > F.col("p_thr"), F.col("_c")).otherwise(F.lit(0))).alias("count"),
                 F.first("p_thr").alias("p95"), F.first("n").alias("n_wet")))


def box_summary(df: DataFrame, by: Sequence[str], value: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, IQR, whisker ends (most extreme data inside the fences)
    and outlier count per group, all from the value-count table."""
    by = list(by)
    counts = value_counts(df, by, value)
    q = quantiles_from_counts(counts, by, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo_f = F.col("q1") - F.lit(whisker) * F.col("iqr")
    hi_f = F.col("q3") + F.lit(whisker) * F.col("iqr")
    v = F.col("_v")
    j = counts.join(q, on=by, how="inner")
    return (j.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), F.first("iqr").alias("iqr"),
        F.min(F.when(v >= lo_f, v)).alias("whisker_low"),
        F.max(F.when(v <= hi_f, v)).alias("whisker_high"),
        F.sum(F.when((v < lo_f) | (v > hi_f), F.col("_c")).otherwise(F.lit(0))).alias("n_outliers")))


def box_outliers(df: DataFrame, by: Sequence[str], value: str, whisker: float = 1.5) -> DataFrame:
    """The values outside the fences, with how often each occurs."""
    by = list(by)
    counts = value_counts(df, by, value)
    q = quantiles_from_counts(counts, by, [0.25, 0.75], ["q1", "q3"])
    width = F.lit(whisker) * (F.col("q3") - F.col("q1"))
    v = F.col("_v")
    return (counts.join(q, on=by, how="inner").where((v < F.col("q1") - width) | (v > F.col("q3") + width))
            .select(*by, v.alias("value"), F.col("_c").alias("count"), (v > F.col("q3")).alias("is_high")))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per column null count and percentage, long form, one scan."""
    by = list(by)
    columns = list(columns) if columns else [c for c in df.columns if c not in by]
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count_if(F.col(c).isNull()).alias(f"_n{i}")
                                                 for i, c in enumerate(columns)]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n_null"))
                                  for i, c in enumerate(columns)])).alias("_s")
    return (wide.select(*by, "_rows", stacked)
            .select(*by, "_s.column", "_s.n_null", F.col("_rows").alias("n_rows"),
                    (F.col("_s.n_null") / F.col("_rows") * 100).alias("pct_null")))


def dataset_profile(df: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """A26 + A12: rows, distinct days and first/last timestamp per key.

    The distinct count is exact: days are deduplicated per key by a
    (key, day) aggregation (a shuffle split across tasks), then counted."""
    by = list(by)
    days = (df.groupBy(*by, F.to_date(ts).alias("_d")).agg(F.count(F.lit(1)).alias("_n"),
                                                           F.min(ts).alias("_lo"), F.max(ts).alias("_hi")))
    return days.groupBy(*by).agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("days"),
                                 F.min("_lo").alias("first_ts"), F.max("_hi").alias("last_ts"))


def specific_rain(df: DataFrame, by: Sequence[str] = ("station",), ts: str = "datetime_utc",
                  value: str = "rain_mm", threshold: float = 0.2, mode: str = "filtered",
                  divisor: float | None = None) -> DataFrame:
    """Yearly mean of hourly 'specific rain' (rain / hours × 100).

    * ``filtered``: keep intervals > threshold, sum per hour, /1 × 100.
    * ``any_wet``: sum all intervals of hours where any interval > threshold,
      /2 × 100 (mean of the two half-hours).
    """
    by = list(by)
    hour_start = F.window(ts, "1 hour").start
    base = df.select(*by, F.year(ts).alias("year"), hour_start.alias("hour_start"), F.col(value).alias("_v"))
    if mode == "filtered":
        div = 1.0 if divisor is None else divisor
        hourly = (base.where(F.col("_v") > threshold)
                  .groupBy(*by, "year", "hour_start").agg(F.sum("_v").alias("_h")))
    elif mode == "any_wet":
        div = 2.0 if divisor is None else divisor
        hourly = (base.groupBy(*by, "year", "hour_start")
                  .agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("_h"),
                       F.bool_or(F.col("_v") > threshold).alias("_wet"))
                  .where("_wet"))
    else:
        raise ValueError(mode)
    return (hourly.groupBy(*by, "year")
            .agg(F.avg(F.col("_h") / F.lit(div) * 100).alias("specific_rain"),
                 F.count(F.lit(1)).alias("wet_hours")))


def yearly_summary(df: DataFrame, by: Sequence[str], period: str, cols: Sequence[str],
                   threshold_col: str, thresholds: Sequence[float]) -> DataFrame:
    """Count, medians of ``cols`` and counts above thresholds, one row per (keys, period).

    The columns are stacked into one (keys, column, value) table so that all
    medians come from a single value-count pass."""
    by = list(by)
    cols = list(cols)
    keys = [*by, period]
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(threshold_col) > F.lit(float(t))).alias(f"gt_{threshold_name(t)}") for t in thresholds])
    stacked = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_val")) for c in cols])).alias("_s"))
    stacked = stacked.select(*keys, "_s._col", "_s._val")
    med = exact_quantiles(stacked, [*keys, "_col"], "_val", [0.5], names=["_med"], with_count=False)
    wide = (med.groupBy(*keys).agg(*[F.max(F.when(F.col("_col") == c, F.col("_med"))).alias(f"{c}_median")
                                     for c in cols]))
    return base.join(wide, on=keys, how="left")


def threshold_name(t: float) -> str:
    return str(int(t)) if float(t).is_integer() else str(t).replace(".", "_")


def drop_sparse_columns(df: DataFrame, columns: Sequence[str], max_pct_null: float) -> DataFrame:
    """Q30/B2: drop the columns whose share of NULLs exceeds ``max_pct_null`` %.

    Choosing a schema needs the profile on the driver; it is one row per
    candidate column (computed in one distributed aggregation)."""
    prof = null_profile(df, columns).where(F.col("pct_null") > F.lit(float(max_pct_null)))
    sparse = [r["column"] for r in prof.select("column").collect()]
    return df.drop(*sparse)
