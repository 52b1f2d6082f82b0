"""Streaming hourly sums and rain periods.

Watermarks require a zoned TIMESTAMP event time, while station readings
are naive UTC (TIMESTAMP_NTZ): the event time is converted with the
session zone (UTC) and results are converted back to NTZ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _event_time(readings: DataFrame, ts: str, watermark: str) -> DataFrame:
    return readings.withColumn("_et", F.col(ts).cast("timestamp")).withWatermark("_et", watermark)


def hourly_rain_stream(readings: DataFrame, by: Sequence[str] = ("station",), ts: str = "datetime_utc",
                       value: str = "rain_mm", watermark: str = "2 hours") -> DataFrame:
    """A4 on a stream: rain summed per (keys, hour); rows are final once the
    watermark passes the hour (append mode)."""
    by = list(by)
    return (_event_time(readings, ts, watermark)
            .groupBy(*by, F.window("_et", "1 hour").alias("_w"))
            .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
            .select(*by, F.col("_w.start").cast("timestamp_ntz").alias("hour_start"), value))


def rain_periods_stream(readings: DataFrame, by: Sequence[str] = ("station",), ts: str = "datetime_utc",
                        value: str = "rain_mm", threshold: float = 0.2, gap: str = "30 minutes",
                        watermark: str = "2 hours") -> DataFrame:
    """W1 on a stream: wet readings (> threshold) grouped into session windows
    of the given gap, per key and calendar year."""
    by = list(by)
    wet = readings.where(F.col(value) > threshold).withColumn("year", F.year(ts))
    return (_event_time(wet, ts, watermark)
            .groupBy(*by, "year", F.session_window("_et", gap).alias("_s"))
            .agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("intervals"),
                 F.sum(value).alias("total"), F.max(value).alias("peak")))
