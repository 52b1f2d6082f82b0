"""When does it rain? Hour-of-day profiles on gap-filled hourly data (Q1-Q6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainfold.operators.combine import two_way_compare
from rainfold.operators.coverage import filter_covered, first_last_periods
from rainfold.operators.ranking import arg_extremes, top_k
from rainfold.operators.resample import resample_hourly
from rainfold.session import materialise

# Hours expected per calendar year (365.25 × 24) and per day.
HOURS_PER_YEAR = 8766
HOURS_PER_DAY = 24


def valid_hourly(halfhourly: DataFrame, by: Sequence[str] = ("station",), period: str = "year",
                 expected: float = HOURS_PER_YEAR, threshold: float = 0.70,
                 fill_gaps: bool = True) -> DataFrame:
    """A3 → A18 → P5: gap-filled hourly rows restricted to well-covered periods.

    ``period`` is 'year' (reference) or 'day' (for short records).
    """
    by = list(by)
    hourly = resample_hourly(halfhourly, by, fill_gaps=fill_gaps)
    if period == "day":
        hourly = hourly.withColumn("day", F.to_date("datetime_utc"))
    return filter_covered(hourly, by, period, "rain_mm", expected, threshold)


def hour_profile(valid: DataFrame, by: Sequence[str] = ("station",), value: str = "rain_mm") -> DataFrame:
    """Mean per hour of day."""
    return valid.groupBy(*by, "hour").agg(F.avg(value).alias("mean_rain"))


def hour_profile_top3(halfhourly: DataFrame, by: Sequence[str] = ("station",), k: int = 3,
                      **valid_kw) -> DataFrame:
    """Q1: the k wettest hours of the day per station, over valid periods."""
    prof = hour_profile(valid_hourly(halfhourly, by, **valid_kw), by)
    return top_k(prof, by, "mean_rain", "hour", k)


def hour_profile_extremes(halfhourly: DataFrame, by: Sequence[str] = ("station",), **valid_kw) -> DataFrame:
    """Q1 (O3): wettest and driest hour per station with their means."""
    prof = hour_profile(valid_hourly(halfhourly, by, **valid_kw), by)
    return arg_extremes(prof, by, "mean_rain", "hour")


def station_hour_comparison(halfhourly: DataFrame, left: str, right: str, station: str = "station",
                            **valid_kw) -> DataFrame:
    """Q2: two stations' hour profiles side by side with right − left."""
    prof = hour_profile(valid_hourly(halfhourly, [station], **valid_kw), [station])
    return two_way_compare(prof, ["hour"], station, left, right, "mean_rain",
                           names=("mean_left", "mean_right"))


def month_hour_means(valid: DataFrame, by: Sequence[str] = ("station",)) -> DataFrame:
    """Mean rain per (keys, month), one column per hour; fixed pivot values avoid a distinct pass."""
    wide = valid.groupBy(*by, "month").pivot("hour", list(range(24))).agg(F.avg("rain_mm"))
    return wide.select(*by, "month", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])


def month_hour_matrix(halfhourly: DataFrame, by: Sequence[str] = ("station",), **valid_kw) -> DataFrame:
    """Month × hour matrix of mean rain over valid periods."""
    return month_hour_means(valid_hourly(halfhourly, by, **valid_kw), by)


def early_late_samples(valid: DataFrame, by: Sequence[str], period: str, k: int = 5) -> DataFrame:
    """Rows of the first k and last k valid periods per key, tagged
    'early'/'late' (a row is in both samples when there are < 2k periods).

    Only the distinct (key, period) rows are ranked, few per key; the tags are
    joined back to the rows."""
    by = list(by)
    periods = valid.groupBy(*by, period).agg(F.lit(True).alias("is_valid"))
    marks = first_last_periods(periods, by, period, k)
    tags = F.array_compact(F.array(F.when(F.col("is_early"), F.lit("early")), F.when(F.col("is_late"), F.lit("late"))))
    marks = marks.select(*by, period, tags.alias("_tags"))
    return valid.join(marks, [*by, period]).withColumn("sample", F.explode("_tags")).drop("_tags")


#: Readings each sample needs before the two are compared.
MIN_SAMPLE = 10


def distribution_shift(halfhourly: DataFrame, by: Sequence[str] = ("station",), k: int = 5, min_n: int = MIN_SAMPLE,
                       **valid_kw) -> DataFrame:
    """Q5: KS two-sample test and pooled t test of hourly rain, first k vs
    last k valid periods; statistics are missing if a sample has fewer than
    ``min_n`` readings (P8).  Both tests read one table of value counts."""
    from rainfold.operators.trend import two_sample_tests
    by = list(by)
    period = valid_kw.get("period", "year")
    valid = materialise(valid_hourly(halfhourly, by, **valid_kw).select(*by, period, "rain_mm"), "valid-hours")
    both = early_late_samples(valid, by, period, k)
    out = two_sample_tests(both, by, "sample", "rain_mm")
    enough = (F.col("n1") >= min_n) & (F.col("n2") >= min_n)
    return out.select(*by, "n1", "n2", *[F.when(enough, F.col(c)).alias(c) for c in ("ks_d", "ks_p_value", "ks_method")], "mean1", "mean2",
                      *[F.when(enough, F.col(c)).alias(c) for c in ("t", "t_p_value")])


def hourly_rain_trend(halfhourly: DataFrame, by: Sequence[str] = ("station",), period: str = "year", **valid_kw) -> DataFrame:
    """Q4: mean hourly rain of each valid period → MK + Sen + Pettitt."""
    from rainfold.operators.trend import make_series
    from rainfold.plans.trends import trend_row
    by = list(by)
    m = valid_hourly(halfhourly, by, period=period, **valid_kw).groupBy(*by, period).agg(F.avg("rain_mm").alias("mean_rain"))
    return trend_row(make_series(m, by, period, "mean_rain"), by)
