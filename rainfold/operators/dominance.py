"""Pair-order counting without materialising pairs.

For a series ordered by position, the number of pairs i < j whose keys
satisfy key_i ≤ key_j is needed by Mann-Kendall (concordant pairs).  Listing the
n(n-1)/2 pairs is quadratic; instead every element is replicated once per
*level* L = 0..⌈log2 n⌉-1.  At level L the positions are cut into parent
blocks of 2^(L+1); the left half of a block precedes its right half, so
every pair i < j is counted at exactly one level — the one where i and j
sit in the two halves of the same parent block.  Within a parent block, a
running count of left-half rows in key order (RANGE frame, so equal keys
are included) gives, for each right-half row, the number of earlier keys
≤ its own.  Rows processed: n·⌈log2 n⌉, all native window work.

The top level of that is one window over the whole series, so series longer
than a block are decomposed in two dimensions first, by position block and
value block.  A pair i < j with key_i ≤ key_j lies

* in one position block: counted by levels inside the block;
* in one value block, but different position blocks: counted by levels over
  the position blocks inside the value block;
* in different blocks of both kinds, the earlier with the smaller values:
  counted from the histogram of block pairs, without looking at its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainfold.operators import blocks
from rainfold.session import materialise


def levels_for(size: Column) -> Column:
    """Array of levels 0..⌈log2 size⌉-1 (an extra level is harmless)."""
    top = F.greatest(F.ceil(F.log2(F.greatest(size.cast("double"), F.lit(2.0)))), F.lit(1)).cast("int")
    return F.sequence(F.lit(0), top - 1)


def leveled(df: DataFrame, pos: str, size: Column) -> DataFrame:
    """Replicate rows per level and tag parent block and side (0 = left, 1 = right)."""
    out = df.withColumn("_lvl", F.explode(levels_for(size)))
    p = f"CAST(`{pos}` AS BIGINT)"
    return (out.withColumn("_parent", F.expr(f"shiftright({p}, _lvl + 1)"))
               .withColumn("_side", F.expr(f"shiftright({p}, _lvl) & 1")))


def right_le_counts(lev: DataFrame, part: Sequence[str], key: str) -> Column:
    """For each right-half row: number of left-half rows of its parent block
    with key ≤ its key (0 for left-half rows)."""
    w = (Window.partitionBy(*part, "_lvl", "_parent").orderBy(F.col(key))
         .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    left_le = F.sum(F.lit(1) - F.col("_side")).over(w)
    return F.when(F.col("_side") == 1, left_le).otherwise(F.lit(0))


def _by_levels(rows: DataFrame, sid: Sequence[str], part: Sequence[str], pos: str, key: str, size: Column) -> DataFrame:
    """(sid, _c): for rows in groups (sid, part), pairs of a group in order of
    ``pos`` with ascending or equal keys; equal positions make no pair."""
    lev = leveled(rows.select(*sid, *part, pos, key, size.alias("_size")), pos, F.col("_size"))
    return lev.select(*sid, right_le_counts(lev, [*sid, *part], key).alias("_c"))


def pairs_le(series: DataFrame, sid: Sequence[str], pos: str, key: str, size: str, longest: int | None = None) -> DataFrame:
    """Per series: Σ_j #{i < j : key_i ≤ key_j} as column ``pairs_le``.

    ``longest`` (at least the points of the longest series) says whether any
    series needs blocks; without it all are decomposed."""
    sid = list(sid)
    if longest is not None and longest <= blocks.BLOCK:
        counted = _by_levels(series, sid, [], pos, key, F.col(size))
        return counted.groupBy(*sid).agg(F.sum("_c").alias("pairs_le"))
    values = blocks.value_blocks(series.select(*sid, key).distinct(), sid, key, "_vb")
    rows = series.select(*sid, pos, key).join(values, [*sid, key])
    rows = rows.withColumn("_pb", F.floor(F.col(pos) / blocks.BLOCK).cast("long"))
    rows = materialise(rows.withColumn("_in", F.pmod(pos, F.lit(blocks.BLOCK))), "dominance")   # four readers
    ends = rows.groupBy(*sid).agg((F.max("_pb") + 1).alias("_pbs"))
    inside = _by_levels(rows, sid, ["_pb"], "_in", key, F.lit(blocks.BLOCK))
    across = _by_levels(rows.join(ends, sid), sid, ["_vb"], "_pb", key, F.col("_pbs"))
    cells = rows.groupBy(*sid, "_pb", "_vb").agg(F.count(F.lit(1)).alias("_n"))
    counted = inside.unionAll(across).groupBy(*sid).agg(F.sum("_c").alias("_c")).unionAll(_cell_pairs(cells, sid))
    return counted.groupBy(*sid).agg(F.sum("_c").alias("pairs_le"))


def _cell_pairs(cells: DataFrame, sid: Sequence[str]) -> DataFrame:
    """(sid, _c): pairs of rows whose position blocks and value blocks both
    ascend strictly, from the counts ``_n`` of the cells.

    Levels over the position blocks once more, on cells instead of rows: a
    cell of a right half takes the counts of the left half's cells with a
    smaller value block."""
    ends = cells.groupBy(*sid).agg((F.max("_pb") + 1).alias("_pbs"))
    lev = leveled(cells.join(ends, list(sid)), "_pb", F.col("_pbs"))
    w = Window.partitionBy(*sid, "_lvl", "_parent").orderBy("_vb").rangeBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.when(F.col("_side") == 0, F.col("_n")).otherwise(0)).over(w)
    return lev.select(*sid, F.when(F.col("_side") == 1, F.col("_n") * F.coalesce(left, F.lit(0))).otherwise(0).alias("_c"))
