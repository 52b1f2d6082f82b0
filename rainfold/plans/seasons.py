"""Monthly rainfall climatology and trends (Q14-Q18)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainfold.functions.calendar import month_label
from rainfold.operators.aggregates import grouped_total, monthly_climatology
from rainfold.operators.ranking import top_k
from rainfold.operators.trend import make_series, seasonal_mann_kendall
from rainfold.plans.trends import trend_row


def wettest_months(daily: DataFrame, by: Sequence[str] = ("station",), k: int = 3) -> DataFrame:
    """Q15 (O2): the k months with the highest mean monthly total per station."""
    clim = monthly_climatology(daily, by).withColumn("month_name", month_label("month"))
    return top_k(clim, by, "mean_total", "month", k)


def seasonal_mk_daily(daily: DataFrame, by: Sequence[str] = ("station",), date: str = "date",
                      value: str = "rain_mm") -> DataFrame:
    """Q16: seasonal MK fed daily rows, each month a season ordered by (year, date)."""
    by = list(by)
    d = daily.withColumn("year", F.year(date)).withColumn("season", F.month(date))
    s = make_series(d, [*by, "season"], ["year", date], value)
    overall, _ = seasonal_mann_kendall(s, by, "season")
    return overall


def seasonal_mk_monthly_means(daily: DataFrame, by: Sequence[str] = ("station",), date: str = "date",
                              value: str = "rain_mm") -> DataFrame:
    """Q6: seasonal MK on the monthly mean (season = month, ordered by year)."""
    by = list(by)
    m = (daily.groupBy(*by, F.year(date).alias("year"), F.month(date).alias("season"))
         .agg(F.avg(value).alias("mean_value")))
    s = make_series(m, [*by, "season"], "year", "mean_value")
    overall, _ = seasonal_mann_kendall(s, by, "season")
    return overall


def seasonal_mk_hourly_means(valid_hours: DataFrame, by: Sequence[str] = ("station",), value: str = "rain_mm",
                             season: str = "month", period: str = "year") -> DataFrame:
    """Q6: seasonal MK on the mean of gap-filled, well-covered hours per
    (season, period): each month over the years, or for a short record each
    hour of the day over the days."""
    by = list(by)
    m = (valid_hours.groupBy(*by, F.col(season).alias("season"), F.col(period).alias("_period"))
         .agg(F.avg(value).alias("mean_value")))
    overall, _ = seasonal_mann_kendall(make_series(m, [*by, "season"], "_period", "mean_value"), by, "season")
    return overall


def monthly_trend_table(daily: DataFrame, by: Sequence[str] = ("station",), date: str = "date",
                        value: str = "rain_mm") -> DataFrame:
    """Q17: MK + Sen + Pettitt for each calendar month's yearly totals (12 series per station)."""
    by = list(by)
    t = grouped_total(daily.withColumn("year", F.year(date)).withColumn("month", F.month(date)),
                      [*by, "year", "month"], value, "total")
    s = make_series(t, [*by, "month"], "year", "total")
    return trend_row(s, [*by, "month"])


def annual_trend_table(daily: DataFrame, by: Sequence[str] = ("station",), date: str = "date",
                       value: str = "rain_mm") -> DataFrame:
    """Q18: MK + Sen + Pettitt on annual totals, change point as a year."""
    by = list(by)
    t = grouped_total(daily.withColumn("year", F.year(date)), [*by, "year"], value, "total")
    s = make_series(t, by, "year", "total")
    return trend_row(s, by)
