"""Runs over ordered rows: rain periods and warm streaks.

Both are gaps-and-islands problems solved with window functions
partitioned by (series, year): a series-year is bounded by the calendar
(≤ 17,568 half-hours or 366 days), whatever the data volume, so these
partitions stay small while the number of series scales out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainfold.functions.calendar import seconds_between
from rainfold.session import materialise


def rain_periods(df: DataFrame, by: Sequence[str] = ("station",), ts: str = "datetime_utc",
                 value: str = "rain_mm", threshold: float = 0.2, max_gap_minutes: int = 30) -> DataFrame:
    """Runs of rows with value > threshold, split when the gap to the
    previous wet row exceeds ``max_gap_minutes`` (strictly), reset each year.

    One row per period: keys, year, period_no, start, end, intervals,
    total and peak.
    """
    by = list(by)
    wet = df.where(F.col(value) > threshold).select(*by, F.year(ts).alias("year"), F.col(ts).alias("_t"),
                                                     F.col(value).alias("_v"))
    w = Window.partitionBy(*by, "year").orderBy("_t")
    wet = wet.withColumn("_prev", F.lag("_t").over(w))
    gap = seconds_between("_prev", "_t")
    flagged = wet.withColumn("_new", F.when(gap.isNull() | (gap > max_gap_minutes * 60), 1).otherwise(0))
    numbered = flagged.withColumn("period_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (numbered.groupBy(*by, "year", "period_no")
            .agg(F.min("_t").alias("start"), F.max("_t").alias("end"),
                 F.count(F.lit(1)).alias("intervals"), F.sum("_v").alias("total"),
                 F.max("_v").alias("peak")))


def reindex_fill(counts: DataFrame, keys: DataFrame, by: Sequence[str], period: str,
                 periods_from: DataFrame, fill_cols: Sequence[str]) -> DataFrame:
    """Every key gets every period seen in ``periods_from``; missing → 0.

    The period list (bounded by the calendar) is a scalar subquery, so the
    spine is built by ``explode`` per key instead of a cross join.
    """
    by = list(by)
    period_list = periods_from.select(F.sort_array(F.collect_set(period))).scalar()
    spine = keys.select(*by).distinct().select(*by, F.explode(period_list).alias(period))
    out = spine.join(counts, on=[*by, period], how="left")
    return out.fillna(0, subset=list(fill_cols))


def rain_period_counts(df: DataFrame, by: Sequence[str] = ("station",), ts: str = "datetime_utc",
                       value: str = "rain_mm", threshold: float = 0.2, max_gap_minutes: int = 30) -> DataFrame:
    """Q9: number of rain periods per (keys, year), zero-filled over all years in the data.

    One pass over the readings: a wet one opens a period if the wet one before
    it in its year is missing or too long ago.  The small table of keys and
    years (dry years included) is written, and read for keys, years and counts."""
    by = list(by)
    w = Window.partitionBy(*by, "year").orderBy("_t")
    rows = df.select(*by, F.year(ts).alias("year"), F.col(ts).alias("_t"), (F.col(value) > threshold).alias("_wet"))
    rows = rows.withColumn("_before", F.last(F.when(F.col("_wet"), F.col("_t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    gap = seconds_between("_before", "_t")
    opens = F.col("_wet") & (gap.isNull() | (gap > max_gap_minutes * 60))
    counts = materialise(rows.groupBy(*by, "year").agg(F.count_if(opens).alias("periods")), "period-counts")
    return reindex_fill(counts, counts, by, "year", counts, ["periods"])


def rain_period_totals(counts: DataFrame, by: Sequence[str] = ("station",)) -> DataFrame:
    """Q9: all rain periods of each key, and its mean per year."""
    return counts.groupBy(*by).agg(F.sum("periods").alias("periods"), F.count(F.lit(1)).alias("years"),
                                   F.avg("periods").alias("per_year"))


def streaks(df: DataFrame, by: Sequence[str], period: str, order: str, value: str,
            thresholds: Sequence[float], min_len: int = 3, calendar: bool = False) -> DataFrame:
    """Per (keys, period, threshold): longest run of rows with value >
    threshold and number of runs of at least ``min_len``.

    Runs count adjacent *rows* in ``order`` (a missing day does not break a
    run), as the reference does; ``calendar=True`` requires consecutive
    dates instead.  Periods without any run report 0.
    """
    by = list(by)
    keys = [*by, period]
    th = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    rows = df.select(*keys, F.col(order).alias("_o"), F.col(value).alias("_v"), th)
    part = [*keys, "threshold"]
    above = F.col("_v") > F.col("threshold")
    if calendar:
        island = F.date_diff(F.col("_o"), F.lit("1970-01-01").cast("date")) - \
            F.row_number().over(Window.partitionBy(*part, above).orderBy("_o"))
    else:
        island = F.row_number().over(Window.partitionBy(*part).orderBy("_o")) - \
            F.row_number().over(Window.partitionBy(*part, above).orderBy("_o"))
    tagged = rows.select(*part, above.alias("_above"), island.alias("_island"))
    # runs of rows not above the threshold have length 0: every key stays, without a second look at the rows
    runs = tagged.groupBy(*part, "_above", "_island").agg(F.count_if("_above").alias("_len"))
    return runs.groupBy(*part).agg(F.max("_len").alias("longest_streak"),
                                   F.count_if((F.col("_len") > 0) & (F.col("_len") >= min_len)).alias("n_streaks_min"))
