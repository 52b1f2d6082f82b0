"""Top-k, arg-max, first and last rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainfold.operators.blocks import natural_block


def top_k(df: DataFrame, by: Sequence[str], value: str, key: str, k: int = 3,
          largest: bool = True, rank_col: str = "rank") -> DataFrame:
    """O2: k largest (or smallest) rows per group; ties → smaller key first.

    Used on aggregated tables (one row per hour or month per station), so
    each window partition is bounded by the key domain.
    """
    order = F.col(value).desc_nulls_last() if largest else F.col(value).asc_nulls_last()
    w = Window.partitionBy(*by).orderBy(order, F.col(key).asc())
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def arg_extremes(df: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """O3: key and value of the maximum and of the minimum per group in one
    aggregation; ties go to the smaller (numeric) key, as the first
    occurrence in a key-sorted index would.
    """
    v, k = F.col(value), F.col(key)
    hi = F.max(F.struct(v.alias("v"), (-k).alias("nk")))
    lo = F.min(F.struct(v.alias("v"), k.alias("k")))
    return (df.where(v.isNotNull()).groupBy(*by).agg(hi.alias("_hi"), lo.alias("_lo"))
            .select(*by,
                    (-F.col("_hi.nk")).alias(f"max_{key}"), F.col("_hi.v").alias(f"max_{value}"),
                    F.col("_lo.k").alias(f"min_{key}"), F.col("_lo.v").alias(f"min_{value}")))


def head_tail(df: DataFrame, by: Sequence[str], order: str, k: int = 5) -> DataFrame:
    """The first and the last ``k`` rows of each group by ``order``, with
    their place (1 the first, -1 the last); rows in both count as first.

    First every block of a group (its years, or runs of whole numbers, or 64
    hash parts) keeps its own 2k candidates, then the group picks among these,
    so no window holds a whole group.  Rows that ``order`` does not tell apart
    are taken by their other columns; rows whose ``order`` is null are left
    out."""
    rest = [c for c in df.columns if c not in (*by, order)]
    block = natural_block(df, order)
    rows = df.where(F.col(order).isNotNull()).withColumn("_block", F.pmod(F.xxhash64(*df.columns), F.lit(64)) if block is None else block)

    def places(rows: DataFrame, part: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*part)
        return rows.withColumns({"_up": F.row_number().over(w.orderBy(order, *rest)),
                                 "_down": F.row_number().over(w.orderBy(F.col(order).desc(), *[F.col(c).desc() for c in rest]))}) \
            .where((F.col("_up") <= k) | (F.col("_down") <= k))

    out = places(places(rows, [*by, "_block"]).drop("_up", "_down"), by)
    place = F.when(F.col("_up") <= k, F.col("_up")).otherwise(-F.col("_down"))
    return out.select(*by, place.alias("place"), order, *rest)
