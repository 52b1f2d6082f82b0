"""Coverage checks and valid-period filtering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainfold.functions.clean import status_label


def coverage(df: DataFrame, by: Sequence[str], period: str, count_col: str,
             expected: float, threshold: float = 0.70,
             ok_label: str = "OK", bad_label: str = "Incomplete") -> DataFrame:
    """present = non-null count per (keys, period); pct = present/expected."""
    by = list(by)
    agg = df.groupBy(*by, period).agg(F.count(count_col).alias("present"))
    pct = F.col("present") / F.lit(float(expected))
    return agg.select(*by, period, "present",
                      F.lit(float(expected)).alias("expected"),
                      pct.alias("pct"),
                      status_label(pct, threshold, ok_label, bad_label).alias("status"),
                      (pct >= threshold).alias("is_valid"))


def valid_periods(cov: DataFrame, by: Sequence[str], period: str) -> DataFrame:
    return cov.where("is_valid").select(*by, period)


def keep_valid(df: DataFrame, cov: DataFrame, by: Sequence[str], period: str) -> DataFrame:
    """P5: semi-join on valid (keys, period).  The valid set stays a DataFrame
    (never a driver list); AQE turns the join into a broadcast at runtime
    when the set is measured small."""
    return df.join(valid_periods(cov, by, period), on=[*by, period], how="left_semi")


def valid_range(cov: DataFrame, by: Sequence[str], period: str) -> DataFrame:
    """First and last valid period per key."""
    return (cov.where("is_valid").groupBy(*by)
            .agg(F.min(period).alias("first_valid"), F.max(period).alias("last_valid"),
                 F.count(period).alias("n_valid")))


def first_last_periods(cov: DataFrame, by: Sequence[str], period: str, k: int = 5) -> DataFrame:
    """Mark the first k and last k valid periods per key (sets overlap when < 2k)."""
    by = list(by)
    v = valid_periods(cov, by, period)
    asc = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(period).asc()))
    desc = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(period).desc()))
    return (v.select(*by, period, (asc <= k).alias("is_early"), (desc <= k).alias("is_late"))
            .where("is_early OR is_late"))


def filter_covered(df: DataFrame, by: Sequence[str], period: str, count_col: str,
                   expected: float, threshold: float = 0.70) -> DataFrame:
    """P5 in one pass: keep rows of (keys, period) groups whose non-null
    count reaches ``threshold × expected``.

    Equivalent to ``keep_valid(df, coverage(df, ...))`` but the input is
    computed once: the count is a window over (keys, period).  Applied to
    aggregated tables (one row per hour or day), each window partition is
    bounded by the calendar whatever the data volume.
    """
    by = list(by)
    present = F.count(count_col).over(Window.partitionBy(*by, period))
    return (df.withColumn("_present", present)
            .where(F.col("_present") / F.lit(float(expected)) >= F.lit(threshold))
            .drop("_present"))
