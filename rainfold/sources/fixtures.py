"""Adapters that stand station tables up on the driver's parquet tables.

Each adapter is an ordinary Spark aggregation over a given table, so its
work grows with the table.  The mapping (see FIXTURES.md §2):

* half-hourly station readings  ← ``events``: station = event_type,
  30-minute slot of ``ts``; rain = Σvalue/100, temperatures = value/10.
* daily station series          ← ``orders``: station = o_orderpriority,
  day of ``o_orderdate``; rain = Σprice/1e4, temperatures = price/1e4.
* a second daily source         ← ``lineitem``: station = l_returnflag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.functions.calendar import floor_to
from rainfold.session import table_path


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def halfhourly_from_events(events: DataFrame) -> DataFrame:
    """F2-shaped half-hourly readings: station, datetime_utc, T_avg, T_min, T_max, rain_mm, wind_dir."""
    return (events
            .groupBy(F.col("event_type").alias("station"),
                     floor_to("ts", "30 minutes").alias("datetime_utc"))
            .agg((F.avg("value") / 10).alias("T_avg"),
                 (F.min("value") / 10).alias("T_min"),
                 (F.max("value") / 10).alias("T_max"),
                 (F.sum("value") / 100).alias("rain_mm"),
                 F.pmod(F.max("value") * 7, F.lit(360.0)).alias("wind_dir")))


def daily_from_orders(orders: DataFrame, station_col: str = "o_orderpriority") -> DataFrame:
    """F3-shaped daily series: station, date, T_avg, T_min, T_max, rain_mm."""
    return (orders
            .groupBy(F.col(station_col).alias("station"),
                     F.to_date("o_orderdate").alias("date"))
            .agg((F.avg("o_totalprice") / 1e4).alias("T_avg"),
                 (F.min("o_totalprice") / 1e4).alias("T_min"),
                 (F.max("o_totalprice") / 1e4).alias("T_max"),
                 (F.sum("o_totalprice") / 1e4).alias("rain_mm")))


def daily_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Second daily source: station = l_returnflag, rain = Σ quantity."""
    return (lineitem
            .groupBy(F.col("l_returnflag").alias("station"),
                     F.to_date("l_shipdate").alias("date"))
            .agg(F.sum("l_quantity").alias("rain_mm"),
                 F.min("l_quantity").alias("T_min"),
                 F.max("l_quantity").alias("T_max")))


def messy_text_view(events: DataFrame) -> DataFrame:
    """Report-style messy text derived from ``events`` (FIXTURES.md §2).

    ``event_id % 20`` selects the kind of raw token: compass points in mixed
    case and padding, plain and comma decimals, approximate marks, dash
    sentinels, 'O'-for-zero misreads, times with ';' typos, and blanks.
    """
    k = F.pmod(F.col("event_id"), F.lit(20))
    v = F.col("value")
    compass = F.array(*[F.lit(x) for x in
                        ["N", " nne", "NE ", "ene", "E", "ESE", "se", "SSE",
                         "5", "SSW", "sw", "WSW", "W", "wnw", "NW", "NNW"]])
    raw_dir = (F.when(k < 16, F.get(compass, k.cast("int")))
               .when(k == 16, F.format_string("%.2f", v))
               .when(k == 17, F.lit("---"))
               .when(k == 18, F.lit(""))
               .otherwise(F.lit("calm")))
    raw_num = (F.when(k < 5, F.format_string("%.2f", v))
               .when(k < 8, F.replace(F.format_string("%.2f", v), F.lit("."), F.lit(",")))
               .when(k < 10, F.concat(F.lit("~"), F.format_string("%.2f", v)))
               .when(k == 10, F.lit("-----"))
               .when(k == 11, F.lit("---"))
               .when(k == 12, F.concat(F.lit("O"), F.format_string("%d", F.floor(v))))
               .when(k == 13, F.lit(" "))
               .when(k == 14, F.lit("12abc"))
               .otherwise(F.format_string("%d", F.floor(v * 10))))
    hh = F.pmod(F.col("event_id"), F.lit(26))
    mm = F.pmod(F.col("event_id") * 7, F.lit(61))
    raw_time = (F.when(k < 10, F.format_string("%d:%02d", hh, mm))
                .when(k < 15, F.format_string("%d;%02d", hh, mm))
                .otherwise(F.format_string("%02d%02d", hh, mm)))
    return events.select(
        "event_id", "ts",
        raw_dir.alias("raw_wind_dir"),
        raw_num.alias("raw_number"),
        raw_time.alias("raw_time"),
        F.when(F.pmod(F.col("event_id"), F.lit(17)) == 0, None).otherwise(v).alias("value_with_nulls"),
        F.when(F.pmod(F.col("event_id"), F.lit(13)) == 0, None).otherwise(F.col("user_id")).alias("user_with_nulls"),
        F.when(F.pmod(F.col("event_id"), F.lit(11)) == 0, None).otherwise(F.col("event_type")).alias("type_with_nulls"),
    )


def spread_over_years(readings: DataFrame, years: int = 8) -> DataFrame:
    """The readings of one month spread over several years: each (station,
    slot) moves by whole years, by its hour and day (no row is copied or
    dropped)."""
    t = F.col("datetime_utc")
    shift = F.pmod(F.dayofmonth(t) * 5 + F.floor(F.hour(t) / 6), F.lit(years)).cast("int")
    return readings.withColumn("datetime_utc", (t + F.make_ym_interval(-shift)).cast("timestamp_ntz"))
