"""Resampling: half-hourly → hourly / daily (A1-A4).

Spark drops empty groups; pandas' resample emits every bucket between the
first and last reading.  The gap-filled form (A3) aggregates the readings to
hours once; every hour then looks at the next one and is exploded over the gap
between them, so the source is scanned once and no hour spine is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainfold.functions.calendar import floor_to


def circular_mean_deg(c: Column | str) -> Column:
    """A2: mean direction in [0, 360) from mean sine and cosine; all-null → NULL."""
    c = F.col(c) if isinstance(c, str) else c
    r = F.radians(c)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0))


# Daily aggregation recipe of the half-hourly report (A1): output name → (input, how).
DAILY_RECIPE = [
    ("T_avg", "T_avg", "mean"),
    ("T_max", "T_max", "max"),
    ("T_min", "T_min", "min"),
    ("humidity_avg", "humidity", "mean"),
    ("rain_mm", "rain_mm", "sum"),
    ("avg_wind_kmh", "avg_wind_kmh", "mean"),
    ("wind_dir", "wind_dir", "circular"),
    ("max_wind_kmh", "max_wind_kmh", "max"),
    ("pressure_avg", "pressure", "mean"),
    ("radiation_avg", "radiation", "mean"),
]


def _agg(how: str, col: str) -> Column:
    if how == "mean":
        return F.avg(col)
    if how == "max":
        return F.max(col)
    if how == "min":
        return F.min(col)
    if how == "sum":
        # pandas sums an all-missing group to 0; Spark gives NULL.
        return F.coalesce(F.sum(col), F.lit(0.0))
    if how == "circular":
        return circular_mean_deg(col)
    raise ValueError(how)


def daily_from_halfhourly(df: DataFrame, by: Sequence[str] = ("station",), ts: str = "datetime_utc",
                          recipe=DAILY_RECIPE) -> DataFrame:
    """A1: one row per (keys, date) with the recipe's aggregates for columns present."""
    aggs = [_agg(how, src).alias(out) for out, src, how in recipe if src in df.columns]
    return df.groupBy(*by, F.to_date(ts).alias("date")).agg(*aggs)


def hourly_sum(df: DataFrame, by: Sequence[str] = ("station",), ts: str = "datetime_utc",
               value: str = "rain_mm", out: str = "rain_mm") -> DataFrame:
    """A4: sparse hourly sums (no gap fill); an hour without any value sums to 0."""
    return (df.groupBy(*by, floor_to(ts, "1 hour").alias("hour_start"))
            .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(out)))


def resample_hourly(df: DataFrame, by: Sequence[str] = ("station",), ts: str = "datetime_utc",
                    rain: str = "rain_mm", mean_cols: Sequence[str] | None = None,
                    fill_gaps: bool = True) -> DataFrame:
    """A3: hourly resample — rain summed, other columns averaged.

    ``fill_gaps=True`` (reference behaviour) emits every hour from each
    series' first to last reading; an empty hour has rain 0 and NULL means.
    ``fill_gaps=False`` keeps observed hours only.

    The next hour is found inside (series, year); the last hour of a year and
    the first of the next one with readings meet in a second window over the
    years' first and last hours only.
    """
    by = list(by)
    if mean_cols is None:
        mean_cols = [c for c, t in df.dtypes
                     if c not in set(by) | {ts, rain} and t in ("double", "float", "int", "bigint")]
    hour_col = floor_to(ts, "1 hour").alias("datetime_utc")
    readings = df.select(*by, hour_col, F.col(rain).alias("_rain"), *[F.col(c) for c in mean_cols])
    out = (readings.groupBy(*by, "datetime_utc")
           .agg(F.coalesce(F.sum("_rain"), F.lit(0.0)).alias(rain),
                *[F.avg(c).alias(c) for c in mean_cols]))
    if fill_gaps:
        out = out.where(F.col("datetime_utc").isNotNull()).withColumn("_year", F.year("datetime_utc"))
        w = Window.partitionBy(*by, "_year").orderBy("datetime_utc")
        out = out.withColumns({"_next": F.lead("datetime_utc").over(w), "_first": F.row_number().over(w) == 1})
        edge = F.when(F.col("_first") | F.col("_next").isNull(), F.lit(None)).otherwise(F.col("_year"))
        over_years = Window.partitionBy(*by, edge).orderBy("datetime_utc")
        out = out.withColumn("_next", F.coalesce("_next", F.lead("datetime_utc").over(over_years)))
        hours = F.when(F.col("_next").isNull(), F.array("datetime_utc")).otherwise(
            F.expr("sequence(datetime_utc, _next - INTERVAL 1 HOUR, INTERVAL 1 HOUR)"))
        out = out.select(*by, F.posexplode(hours).alias("_gap", "_hour"), rain, *mean_cols)
        read = F.col("_gap") == 0
        out = out.select(*by, F.col("_hour").alias("datetime_utc"), F.when(read, F.col(rain)).otherwise(0.0).alias(rain),
                         *[F.when(read, F.col(c)).alias(c) for c in mean_cols])
    return out.select(*by, "datetime_utc", rain, *mean_cols,
                      F.hour("datetime_utc").alias("hour"),
                      F.year("datetime_utc").alias("year"),
                      F.month("datetime_utc").alias("month"))
