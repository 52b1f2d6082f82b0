"""The analysis entry points under their familiar names, as DataFrame functions.

Each function takes DataFrames and column names (plus ``by`` keys, so many
stations / series run in one pass) and returns a DataFrame; nothing is
collected.  They are thin compositions of the operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.operators import aggregates as _agg
from rainfold.operators import coverage as _cov
from rainfold.operators import periods as _per
from rainfold.operators import resample as _res
from rainfold.operators import trend as _trend
from rainfold.operators.theil_sen import theil_sen as _theil_sen
from rainfold.plans import rain_hours as _rh
from rainfold.plans import trends as _trends
from rainfold.sources import files as _files

HOURS_PER_YEAR = _rh.HOURS_PER_YEAR


def resample_hourly(df: DataFrame, by: Sequence[str] = ("station",), ts: str = "datetime_utc",
                    rain: str = "rain_mm", fill_gaps: bool = True) -> DataFrame:
    """Half-hourly → hourly: rain summed (empty hours 0), other columns averaged; hour/year/month added."""
    return _res.resample_hourly(df, by, ts, rain, fill_gaps=fill_gaps)


def check_year_coverage(hourly: DataFrame, by: Sequence[str] = ("station",), threshold: float = 0.70,
                        expected: float = HOURS_PER_YEAR, count_col: str = "rain_mm") -> DataFrame:
    """Per (keys, year): hours present, share of the expected hours, status, validity."""
    return _cov.coverage(hourly, by, "year", count_col, expected, threshold)


def hour_month_heatmap(hourly_valid: DataFrame, by: Sequence[str] = ("station",)) -> DataFrame:
    """Data behind the month × hour heatmap: mean rain per (keys, month) with one column per hour."""
    return _rh.month_hour_means(hourly_valid, by)


def load_station_data(spark: SparkSession, paths, schema=None, date: str = "date") -> DataFrame:
    """CSV daily tables (one per station) → one table with station, year, month, day."""
    df = _files.read_station_csv(spark, paths, schema)
    d = F.to_date(F.col(date))
    return df.withColumn("year", F.year(d)).withColumn("month", F.month(d)).withColumn("day", F.dayofmonth(d))


def get_monthly_series(daily: DataFrame, by: Sequence[str] = ("station",), date: str = "date",
                       value: str = "rain_mm") -> DataFrame:
    """Monthly totals per (keys, year, month) with the month's mean over years."""
    return _agg.monthly_totals(daily, by, date, value)


def monthly_average(daily: DataFrame, by: Sequence[str] = ("station",), date: str = "date",
                    value: str = "rain_mm") -> DataFrame:
    """Mean monthly total per (keys, month) over the years present."""
    return _agg.monthly_climatology(daily, by, date, value)


def count_rain_periods(halfhourly: DataFrame, by: Sequence[str] = ("station",), ts: str = "datetime_utc",
                       value: str = "rain_mm", threshold: float = 0.2) -> DataFrame:
    """Rain periods per (keys, year), zero-filled over the years in the data."""
    return _per.rain_period_counts(halfhourly, by, ts, value, threshold)


def count_above_threshold(data: DataFrame, col: str, threshold: float, by: Sequence[str] = ("station",),
                          period: str = "year") -> DataFrame:
    """Per (keys, period): number of values strictly above ``threshold``."""
    return (_agg.threshold_counts(data, [*by, period], col, [threshold])
            .select(*by, period, "count"))


def compute_streaks(data: DataFrame, col: str, threshold: float, by: Sequence[str] = ("station",),
                    order: str = "date", period: str = "year", calendar: bool = False) -> DataFrame:
    """Per (keys, period): longest run above ``threshold`` and number of runs of ≥ 3."""
    s = _per.streaks(data, by, period, order, col, [threshold], calendar=calendar)
    return s.select(*by, period, "longest_streak", F.col("n_streaks_min").alias("n_streaks_3plus"))


def trend_line(data: DataFrame, x: str, y: str, by: Sequence[str] = ("station",)) -> DataFrame:
    """Least-squares line with r, r² and the slope's p-value (n ≥ 3)."""
    s = data.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return _trend.ols(s.where(F.col("y").isNotNull()), list(by))


def _series(df, by, order, value, x=None):
    return _trend.make_series(df, list(by), order, value, x=x)


def mann_kendall(df: DataFrame, value: str, order: str = "year", by: Sequence[str] = ("station",)) -> DataFrame:
    """Kendall τ of position vs value with two-sided p, trend label and flags (n ≥ 4)."""
    return _trend.mann_kendall(_series(df, by, order, value), list(by))


def sens_slope(df: DataFrame, value: str, order: str = "year", by: Sequence[str] = ("station",),
               x: str | None = None) -> DataFrame:
    """Theil-Sen slope, intercept and 95 % interval (n ≥ 4).

    ``x=None`` measures the slope per position step (the reference's
    definition: a skipped year does not widen the step); ``x="year"`` uses the
    period values instead."""
    return _theil_sen(_series(df, by, order, value, x), list(by))


def pettitt_test(df: DataFrame, value: str, order: str = "year", by: Sequence[str] = ("station",)) -> DataFrame:
    """Pettitt change point: index, period label, U, p and significance (n ≥ 4)."""
    return _trend.pettitt(_series(df, by, order, value), list(by))


def seasonal_mann_kendall(df: DataFrame, value_col: str, month_col: str = "month", year_col: str = "year",
                          by: Sequence[str] = ("station",)) -> tuple[DataFrame, DataFrame]:
    """Seasonal MK with seasons = ``month_col`` ordered by ``year_col``; returns (overall, per season)."""
    s = _trend.make_series(df.withColumn("season", F.col(month_col)), [*by, "season"], year_col, value_col)
    return _trend.seasonal_mann_kendall(s, list(by), "season")


def mk_analysis_series(df: DataFrame, value: str, order: str = "year", by: Sequence[str] = ("station",),
                       x: str | None = None) -> DataFrame:
    """Mann-Kendall + Sen's slope + Pettitt in one row per series (``x`` as in :func:`sens_slope`)."""
    return _trends.trend_row(_series(df, by, order, value, x), list(by))


def mk_table(trend_rows: DataFrame, by: Sequence[str] = ("station",)) -> DataFrame:
    """The compact results table (label, τ, p, slope, trend, Y/N, change-point label)."""
    return _trends.results_table(trend_rows, list(by))
