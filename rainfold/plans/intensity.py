"""How intense is the rain? Half-hourly intensity analyses (Q7-Q13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainfold.functions.calendar import floor_to, hours_between
from rainfold.operators.aggregates import heavy_event_counts, histogram
from rainfold.operators.trend import make_series, mann_kendall, ols


def intensity_histogram(halfhourly: DataFrame, by: Sequence[str] = ("station",),
                        value: str = "rain_mm") -> DataFrame:
    """Q7: wet half-hours (> 0) binned by intensity, empty bins kept."""
    return histogram(halfhourly, by, value, where=F.col(value) > 0)


def intensity_vs_time(halfhourly: DataFrame, by: Sequence[str] = ("station",), ts: str = "datetime_utc",
                      value: str = "rain_mm", threshold: float = 1.0) -> DataFrame:
    """Q8: hourly sums of intervals > threshold against hours elapsed since the
    series' first reading (of all rows, before the filter), with OLS trend.

    One aggregation to hours carries both the filtered sum and the first
    reading; the start of a series is the minimum over its hours (one small
    row per series, joined back), so no window runs over raw readings."""
    by = list(by)
    v = F.col(value)
    hourly = (halfhourly.groupBy(*by, floor_to(ts, "1 hour").alias("hour_start"))
              .agg(F.sum(F.when(v > threshold, v)).alias("rain_mm"), F.min(ts).alias("_first")))
    start = hourly.groupBy(*by).agg(F.min("_first").alias("_t0"))
    pts = (hourly.where(F.col("rain_mm").isNotNull()).join(start, by)
           .select(*by, "rain_mm", hours_between("_t0", "hour_start").alias("t")))
    s = pts.select(*by, F.col("t").alias("x"), F.col("rain_mm").alias("y"))
    return ols(s, by)


def yearly_maxima(halfhourly: DataFrame, by: Sequence[str] = ("station",), ts: str = "datetime_utc",
                  value: str = "rain_mm", daily: DataFrame | None = None, date: str = "date") -> DataFrame:
    """Q11: per (keys, year) max 30-min (wet rows only), max hourly and max
    daily sums, from one chain half-hour → hour → day → year.

    ``daily`` adds stations that report days only: their maximum daily value,
    the other two columns missing."""
    by = list(by)
    v = F.col(value)
    hourly = (halfhourly.groupBy(*by, floor_to(ts, "1 hour").alias("_h"))
              .agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("_s"), F.max(F.when(v > 0, v)).alias("_m")))
    days = (hourly.groupBy(*by, F.to_date("_h").alias("_d"))
            .agg(F.sum("_s").alias("_day"), F.max("_s").alias("_hour"), F.max("_m").alias("_m")))
    out = (days.groupBy(*by, F.year("_d").alias("year"))
           .agg(F.max("_day").alias("max_daily"), F.max("_hour").alias("max_hourly"), F.max("_m").alias("max_30min")))
    if daily is None:
        return out
    own = daily.groupBy(*by, F.year(date).alias("year")).agg(F.max(value).alias("max_daily"))
    both = out.unionByName(own, allowMissingColumns=True)
    return both.groupBy(*by, "year").agg(*[F.max(c).alias(c) for c in ("max_daily", "max_hourly", "max_30min")])


def yearly_maxima_trends(maxima: DataFrame, by: Sequence[str] = ("station",), min_n: int = 4,
                         columns: Sequence[str] = ("max_30min", "max_hourly", "max_daily")) -> DataFrame:
    """Q12: local Mann-Kendall variant on each column of the yearly maxima;
    years without a value are left out, series shorter than ``min_n`` skipped."""
    by = list(by)
    long = maxima.select(*by, "year", F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_c"))
    long = long.select(*by, "_c.measure", "year", "_c.value").where(F.col("value").isNotNull())
    s = make_series(long, [*by, "measure"], "year", "value", x="year")
    return mann_kendall(s, [*by, "measure"], min_n=3, variant="local").where(F.col("n") >= min_n)


def yearly_max_trend(daily: DataFrame, by: Sequence[str] = ("station",), date: str = "date",
                     value: str = "rain_mm", min_n: int = 4) -> DataFrame:
    """Q12 for stations that report days only: the trend of the yearly maximum."""
    by = list(by)
    ym = daily.groupBy(*by, F.year(date).alias("year")).agg(F.max(value).alias("max_value"))
    s = make_series(ym, by, "year", "max_value", x="year")
    return mann_kendall(s, by, min_n=3, variant="local").where(F.col("n") >= min_n)


def heavy_event_trend(daily: DataFrame, by: Sequence[str] = ("station",), date: str = "date",
                      value: str = "rain_mm") -> DataFrame:
    """Q13: yearly count of wet rows above that year's P95 and its local MK trend."""
    by = list(by)
    counts = heavy_event_counts(daily.withColumn("year", F.year(date)), by, "year", value)
    s = make_series(counts, by, "year", "count", x="year")
    return mann_kendall(s, by, min_n=3, variant="local")
