"""Joins and set operations.

Several per-key metric tables are merged with one union + group-by
instead of a chain of full outer joins (one shuffle instead of one per
join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outer_merge(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Equivalent of chained full outer joins on ``on`` when each frame
    has at most one row per key and its own value columns."""
    on = list(on)
    value_cols = []
    for f in frames:
        value_cols += [c for c in f.columns if c not in on]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.groupBy(*on).agg(*[F.max(c).alias(c) for c in value_cols])


def two_way_compare(df: DataFrame, key: Sequence[str], side_col: str, left: str, right: str,
                    value: str, fill: float | None = None, names: tuple[str, str] | None = None) -> DataFrame:
    """Align two members of ``side_col`` on ``key`` (full outer) and
    add right − left.  ``fill=0`` reproduces the reference's fillna(0)."""
    key = list(key)
    ln, rn = names or (f"{value}_{left}", f"{value}_{right}")
    side = F.col(side_col)
    g = (df.where(side.isin(left, right)).groupBy(*key)
         .agg(F.max(F.when(side == left, F.col(value))).alias(ln),
              F.max(F.when(side == right, F.col(value))).alias(rn)))
    if fill is not None:
        g = g.fillna(fill, subset=[ln, rn])
    return g.withColumn("difference", F.col(rn) - F.col(ln))


def union_eras(frames: Sequence[DataFrame], key: Sequence[str] | None = None,
               dedupe: str | None = None) -> DataFrame:
    """Union by column name, missing columns → NULL.  The first frame
    is the oldest era.  ``dedupe='prefer_new'`` keeps one row per key from the
    newest era that has it (the reference keeps both copies)."""
    tagged = [f.withColumn("_era", F.lit(i)) for i, f in enumerate(frames)]
    u = tagged[0]
    for f in tagged[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    if dedupe == "prefer_new" and key:
        w = Window.partitionBy(*key).orderBy(F.col("_era").desc())
        u = u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return u.drop("_era")


def common_keys(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keys present in both."""
    return a.select(*cols).intersect(b.select(*cols))


def all_keys(frames: Sequence[DataFrame], cols: Sequence[str]) -> DataFrame:
    """Every key that any of the frames has, once.  Each frame is reduced
    to its own keys before the union, and the union again."""
    keys = [f.select(*cols).distinct() for f in frames]
    out = keys[0]
    for f in keys[1:]:
        out = out.unionByName(f)
    return out.distinct()
