"""Are summer nights getting warmer? Night attribution, warm counts, streaks (Q19-Q28)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainfold.functions.calendar import in_season, is_night, night_date
from rainfold.operators.aggregates import box_summary, exact_quantiles, threshold_counts, threshold_name, yearly_summary
from rainfold.operators.combine import common_keys, two_way_compare
from rainfold.operators.coverage import filter_covered, keep_valid
from rainfold.operators.periods import streaks
from rainfold.operators.trend import make_series, ols
from rainfold.plans.trends import trend_row
from rainfold.session import materialise

# The reference's summer (21 Jun - 21 Sep, 93 days), night
# (23:00-05:30, 14 half-hours, complete at 11) and warm-night thresholds (°C).
SUMMER = (621, 921)
SUMMER_DAYS = 93
NIGHT_HOURS = (23, 5)
NIGHT_COMPLETE = 11
WARM_THRESHOLDS = [20.0, 22.0, 24.0, 26.0]


def night_table(halfhourly: DataFrame, by: Sequence[str] = ("station",), ts: str = "datetime_utc",
                season: tuple[int, int] = SUMMER, complete_at: int = NIGHT_COMPLETE) -> DataFrame:
    """One row per (keys, night): min T_min, max T_max, readings
    (non-null T_avg), year of the first reading, completeness.  The season
    test applies to the night's date (early hours belong to the previous day)."""
    by = list(by)
    nd = night_date(ts, NIGHT_HOURS[1])
    rows = (halfhourly.where(is_night(ts, *NIGHT_HOURS))
            .withColumn("night_date", nd)
            .where(in_season("night_date", *season)))
    nights = rows.groupBy(*by, "night_date").agg(
        F.min("T_min").alias("night_T_min"), F.max("T_max").alias("night_T_max"),
        F.count("T_avg").alias("readings_count"), F.year(F.min(ts)).alias("year"))
    return (nights.withColumn("is_complete", F.col("readings_count") >= complete_at)
            .where(F.col("night_T_min").isNotNull() & F.col("night_T_max").isNotNull()))


def night_coverage(nights: DataFrame, by: Sequence[str] = ("station",), expected: float = SUMMER_DAYS,
                   threshold: float = 0.70) -> DataFrame:
    """Complete nights per year over the expected number."""
    by = list(by)
    g = nights.groupBy(*by, "year").agg(F.count("night_date").alias("total"),
                                        F.count_if("is_complete").alias("complete"))
    pct = F.col("complete") / F.lit(float(expected))
    return g.select(*by, "year", "total", "complete", pct.alias("pct"), (pct >= threshold).alias("is_valid"))


def valid_nights(nights: DataFrame, by: Sequence[str] = ("station",), **cov_kw) -> DataFrame:
    """Complete nights of valid years."""
    cov = night_coverage(nights, by, **cov_kw)
    return keep_valid(nights.where("is_complete"), cov, by, "year")


def summer_days(daily: DataFrame, by: Sequence[str] = ("station",), date: str = "date",
                season: tuple[int, int] = SUMMER, expected: float = SUMMER_DAYS,
                threshold: float = 0.70, value: str = "T_min") -> DataFrame:
    """A20 + coverage: daily rows inside the season (calendar date) with a
    non-null value, restricted to years with enough such days."""
    by = list(by)
    d = (daily.where(in_season(date, *season) & F.col(value).isNotNull())
         .withColumn("year", F.year(date)))
    return filter_covered(d, by, "year", date, expected, threshold)


def warm_counts(days: DataFrame, by: Sequence[str] = ("station",), value: str = "T_min",
                thresholds: Sequence[float] = WARM_THRESHOLDS) -> DataFrame:
    """Per (keys, year, threshold) number of values above it."""
    return threshold_counts(days, [*by, "year"], value, thresholds)


def warm_count_trend(days: DataFrame, by: Sequence[str] = ("station",), value: str = "T_min",
                     thresholds: Sequence[float] = WARM_THRESHOLDS) -> DataFrame:
    """Least-squares trend of the yearly counts, per threshold."""
    by = list(by)
    c = warm_counts(days, by, value, thresholds)
    s = c.select(*by, "threshold", F.col("year").cast("double").alias("x"), F.col("count").cast("double").alias("y"))
    return ols(s, [*by, "threshold"])


def warm_streaks(days: DataFrame, by: Sequence[str] = ("station",), date: str = "date", value: str = "T_min",
                 thresholds: Sequence[float] = WARM_THRESHOLDS) -> DataFrame:
    """Q22/W2."""
    return streaks(days, by, "year", date, value, thresholds)


def warm_percentiles(days: DataFrame, by: Sequence[str] = ("station",), value: str = "T_min") -> DataFrame:
    """P90 and P95 per (keys, year)."""
    return exact_quantiles(days, [*by, "year"], value, [0.90, 0.95], names=["p90", "p95"])


def yearly_box(days: DataFrame, by: Sequence[str] = ("station",), value: str = "T_max") -> DataFrame:
    """Q23/A24."""
    return box_summary(days, [*by, "year"], value)


def summary_table(days: DataFrame, by: Sequence[str] = ("station",)) -> DataFrame:
    """Q27/A25."""
    return yearly_summary(days, by, "year", ["T_min", "T_max"], "T_min", WARM_THRESHOLDS)


def two_station_counts(days: DataFrame, left: str, right: str, station: str = "station",
                       thresholds: Sequence[float] = WARM_THRESHOLDS) -> DataFrame:
    """Yearly warm counts of two stations aligned, missing → 0."""
    c = warm_counts(days, [station], "T_min", thresholds)
    return two_way_compare(c, ["year", "threshold"], station, left, right, "count", fill=0,
                           names=("count_left", "count_right"))


def two_station_streaks(days: DataFrame, left: str, right: str, station: str = "station",
                        thresholds: Sequence[float] = WARM_THRESHOLDS) -> DataFrame:
    """Longest streaks of two stations aligned, missing → 0."""
    s = warm_streaks(days, [station], thresholds=thresholds)
    return two_way_compare(s, ["year", "threshold"], station, left, right, "longest_streak", fill=0,
                           names=("longest_left", "longest_right"))


def median_trend_common_years(days: DataFrame, left: str, right: str, station: str = "station",
                              value: str = "T_min") -> DataFrame:
    """Q26: years valid at both stations (U3) → yearly medians (A16) → OLS per station."""
    sel = days.where(F.col(station).isin(left, right))
    a = sel.where(F.col(station) == left).select("year")
    b = sel.where(F.col(station) == right).select("year")
    common = common_keys(a, b, ["year"])
    kept = sel.join(common, "year", "left_semi")
    med = exact_quantiles(kept, [station, "year"], value, [0.5], names=["median"])
    s = med.select(station, F.col("year").cast("double").alias("x"), F.col("median").alias("y"))
    return ols(s, [station])


def yearly_mean_trend(days: DataFrame, by: Sequence[str] = ("station",), value: str = "T_min") -> DataFrame:
    """Q28: MK + Sen + Pettitt on the yearly mean."""
    by = list(by)
    m = days.groupBy(*by, "year").agg(F.avg(value).alias("mean_value"))
    return trend_row(make_series(m, by, "year", "mean_value"), by)


def box_on_common_years(days: DataFrame, left: str, right: str, station: str = "station",
                        value: str = "T_min") -> DataFrame:
    """Q26: yearly boxes of two stations over the years valid at both."""
    sel = days.where(F.col(station).isin(left, right))
    common = common_keys(sel.where(F.col(station) == left).select("year"), sel.where(F.col(station) == right).select("year"), ["year"])
    return box_summary(sel.join(common, "year", "left_semi"), [station, "year"], value)


def two_station_count_trend(days: DataFrame, left: str, right: str, station: str = "station",
                            thresholds: Sequence[float] = WARM_THRESHOLDS) -> DataFrame:
    """Least-squares trend of each station's aligned yearly counts."""
    both = two_station_counts(days, left, right, station, thresholds)
    side = F.explode(F.array(F.struct(F.lit(left).alias(station), F.col("count_left").alias("count")),
                             F.struct(F.lit(right).alias(station), F.col("count_right").alias("count")))).alias("_s")
    s = both.select("year", "threshold", side).select(f"_s.{station}", "threshold", F.col("year").cast("double").alias("x"),
                                                      F.col("_s.count").cast("double").alias("y"))
    return ols(s, [station, "threshold"])


def as_days(nights: DataFrame, by: Sequence[str] = ("station",)) -> DataFrame:
    """Valid nights in the shape of the daily table (date, year, T_min, T_max),
    so that every daily analysis runs on nights too."""
    return nights.select(*by, F.col("night_date").alias("date"), "year", F.col("night_T_min").alias("T_min"),
                         F.col("night_T_max").alias("T_max"))


def yearly_measures(days: DataFrame, by: Sequence[str] = ("station",), date: str = "date", value: str = "T_min",
                    thresholds: Sequence[float] = WARM_THRESHOLDS) -> DataFrame:
    """Q28: (keys, measure, year, value): yearly means of T_min and T_max,
    counts above each threshold and the longest streak above it."""
    by = list(by)
    means = days.groupBy(*by, "year").agg(F.avg("T_min").alias("mean_T_min"), F.avg("T_max").alias("mean_T_max"))
    means = means.select(*by, "year", F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("mean_T_min", "mean_T_max")])).alias("_m"))
    means = means.select(*by, "_m.measure", "year", "_m.value")

    def label(kind: str):
        named = F.lit(None).cast("string")
        for t in thresholds:
            named = F.when(F.col("threshold") == F.lit(float(t)), F.lit(kind + threshold_name(t))).otherwise(named)
        return named.alias("measure")

    counts = warm_counts(days, by, value, thresholds).select(*by, label("count_gt_"), "year", F.col("count").cast("double").alias("value"))
    longest = warm_streaks(days, by, date, value, thresholds).select(
        *by, label("streak_gt_"), "year", F.col("longest_streak").cast("double").alias("value"))
    return means.unionByName(counts).unionByName(longest).where(F.col("value").isNotNull())


def measure_trends(days: DataFrame, by: Sequence[str] = ("station",), **kw) -> DataFrame:
    """MK + Sen + Pettitt on every yearly measure.  The days are
    written once; means, counts and streaks read them from there."""
    by = [*by, "measure"]
    return trend_row(make_series(yearly_measures(materialise(days, "days"), by[:-1], **kw), by, "year", "value"), by)
