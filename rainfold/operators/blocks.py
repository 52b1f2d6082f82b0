"""Two-level prefix sums: running totals of a series of any length.

A window over a whole series puts one key into one task.  Here a series is cut
into blocks that ascend with the order column; the running total of a row is
the total of the blocks before its block (a window over one row a block) plus
the running total inside its block (a window over the block).  No window ever
holds more than a block.

Blocks of calendar columns and whole numbers follow from the value itself
(:func:`natural_block`).  For any other values (:func:`value_blocks`) the
splits are values picked by their hash, so they are the same whenever they are
computed, and only series with more than ``BLOCK`` different values have any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``; null keys are equal."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


#: Rows of a block, about.
BLOCK = 4096
#: Splits of one series at most (its blocks then grow with it).
SPLITS = 1024


def natural_block(df: DataFrame, column: str, alone: bool = True) -> Column | None:
    """Block of a calendar or whole-number column: the year of a date or time,
    runs of ``BLOCK`` of a number, or the number itself if it orders the rows
    together with other columns.  None for other types."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.year(column).cast("long")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.floor(F.col(column).cast("long") / (BLOCK if alone else 1)).cast("long")
    return None


def value_blocks(values: DataFrame, by: Sequence[str], value: str, block: str = "_block") -> DataFrame:
    """``values`` (one row for each different ``value`` of a series) plus
    ``block``, ascending with the value.

    A series of n > ``BLOCK`` values is split at about n / ``BLOCK`` of them
    (``SPLITS`` at most), those with the smallest hashes."""
    by = list(by)
    sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK)
    share = F.least(F.col("_n") / BLOCK, F.lit(float(SPLITS))) / F.col("_n")
    unit = F.pmod(F.xxhash64(value), F.lit(1 << 40)) / F.lit(float(1 << 40))
    splits = (join_keys(values.select(*by, value), sizes, by).where(unit < share)
              .groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("_splits")))
    out = join_keys(values, splits, by, "left")
    at = F.size(F.filter("_splits", lambda s: s <= F.col(value)))
    return out.withColumn(block, F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(at).cast("long")).drop("_splits")


def running(df: DataFrame, by: Sequence[str], block: str, order: Sequence[str], sums: dict[str, Column],
            totals: dict[str, str] | None = None) -> DataFrame:
    """``df`` plus, for each name in ``sums``, the total of that column over
    all rows of the series before the row (exclusive), and for each name in
    ``totals`` (new column -> name in ``sums``) the total of the whole series."""
    by, order, totals = list(by), list(order), totals or {}
    whole, parts = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(block)
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*by, block).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    blocks = blocks.select(*by, block, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
                           *[F.sum(f"_t_{n}").over(whole).alias(new) for new, n in totals.items()])
    inside = Window.partitionBy(*by, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = join_keys(df, blocks, [*by, block])
    return rows.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_b_{n}") for n, c in sums.items()}) \
        .drop(*[f"_b_{n}" for n in sums])
