"""Theil-Sen slope, intercept and confidence interval (T2), exact.

Order statistics of the pairwise slopes (y_j - y_i) / (x_j - x_i), taken over
all pairs with different x.

A series of at most ``SHORT`` points is one small group: all its slopes are
listed once and the wanted ranks taken from them.  A longer series is cut into
blocks of ``SHORT`` points in x order, and every pair of blocks is a row of
work, dealt by (series, block, block); no task gets a series.  The slopes below
a pivot m are the inversions of y - m x, so a pair of blocks counts them by
sorting, without forming slopes.  Each round draws a sample of the slopes
that may still hold a wanted rank, counts below two pivots around that rank and
narrows the bracket; when few slopes are left, they are listed.  All four ranks
of all series advance together, and the driver gets one number a round.

The counts are exact for the slopes as they are rounded: where y - m x differs
by less than its rounding error, the slope itself is formed and compared.

Targets follow the library definition: the median (mean of the two middle
slopes when the count N is even) and the interval ranks
Ru = min(round((N + z s)/2), N-1), Rl = max(round((N - z s)/2) - 1, 0)
(0-based, round half to even), s^2 = [n(n-1)(2n+5) - sum t(t-1)(2t+5)]/18
over values of x and of y that occur t times; intercept =
median(y) - slope median(x).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainfold.functions.numeric import Z_975
from rainfold.operators import blocks
from rainfold.operators.aggregates import exact_quantiles
from rainfold.operators.blocks import join_keys, running, value_blocks
from rainfold.session import materialise

#: Points of a block, and of a series that is one group.
SHORT = 2048
#: Slopes of one rank that are listed, and those sampled in a round, about.
LISTED, SAMPLED = 200_000, 4096


def slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All slopes of pairs with different x, each pair once (``x`` sorted)."""
    n = len(x)
    i, j = np.triu_indices(n, 1)
    dx = x[j] - x[i]
    later = dx > 0
    return (y[j] - y[i])[later] / dx[later]


def select_slopes(x: np.ndarray, y: np.ndarray, ranks: Sequence[int]) -> list[float]:
    """The slopes of the given 0-based ranks of a short series."""
    order = np.argsort(x, kind="stable")
    s = slopes(x[order], y[order])
    return [float(v) for v in np.partition(s, sorted(set(ranks)))[list(ranks)]]


def _tie_sum(v: np.ndarray) -> float:
    t = np.unique(v, return_counts=True)[1].astype(float)
    return float((t * (t - 1) * (2 * t + 5)).sum())


def wanted_ranks(n: int, pairs: int, ties: float, z: float) -> tuple[int, int, int, int]:
    """Ranks of the two middle slopes and of the interval's ends."""
    sigma = np.sqrt(max(0.0, (n * (n - 1) * (2 * n + 5) - ties) / 18.0))
    upper = min(int(np.round((pairs + z * sigma) / 2)), pairs - 1)
    lower = max(int(np.round((pairs - z * sigma) / 2)) - 1, 0)
    return (pairs - 1) // 2, pairs // 2, lower, upper


def sen_statistics(x: np.ndarray, y: np.ndarray, z: float = Z_975) -> tuple[float, float, float, float] | None:
    """(slope, intercept, lower, upper) of a short series; None without two
    different x."""
    n = len(x)
    t = np.unique(x, return_counts=True)[1].astype(np.int64)
    pairs = n * (n - 1) // 2 - int((t * (t - 1) // 2).sum())
    if pairs < 1:
        return None
    a, b, lo, hi = select_slopes(x, y, wanted_ranks(n, pairs, _tie_sum(x) + _tie_sum(y), z))
    slope = a if pairs % 2 else (a + b) / 2
    return slope, float(np.median(y) - slope * np.median(x)), lo, hi


# ------------------------------------------------------------ pairs of blocks

class BlockPair:
    """Points of two blocks, the first before the second in x order (or the
    same block twice)."""

    def __init__(self, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], same: bool):
        (self.x0, self.y0), (self.x1, self.y1), self.same = left, right, same
        # equal x in both blocks (or one block) make pairs that have no slope
        self.plain = not same and self.x0[-1] < self.x1[0]
        self.reach = max(np.abs(self.y0).max(), np.abs(self.y1).max()), max(np.abs(self.x0).max(), np.abs(self.x1).max())

    def slopes_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes from all first points to the given second points, and which
        of these are slopes (later x; each pair once)."""
        dx = self.x1[rows, None] - self.x0[None, :]
        dy = self.y1[rows, None] - self.y0[None, :]
        later = dx > 0
        return np.divide(dy, dx, out=np.zeros_like(dy), where=later), later

    def _band(self, m: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per second point: how many first points surely give a slope below
        ``m``, how many may give one at most ``m``; the first points' order."""
        u0, u1 = self.y0 - m * self.x0, self.y1 - m * self.x1
        slack = 2.0 ** -47 * (self.reach[0] + abs(m) * self.reach[1])
        order = np.argsort(u0, kind="stable")
        ranked = u0[order]
        sure = len(ranked) - np.searchsorted(ranked, u1 + slack, side="right")
        maybe = len(ranked) - np.searchsorted(ranked, u1 - slack, side="left")
        return sure, maybe, order

    def below(self, m: float) -> tuple[int, int]:
        """Slopes less than ``m``, and slopes at most ``m``."""
        if not self.plain:
            less = upto = 0
            for rows in np.array_split(np.arange(len(self.x1)), max(1, len(self.x1) * len(self.x0) >> 20)):
                s, real = self.slopes_of(rows)
                less, upto = less + int((real & (s < m)).sum()), upto + int((real & (s <= m)).sum())
            return less, upto
        sure, maybe, order = self._band(m)
        less = upto = int(sure.sum())
        open_ = np.flatnonzero(maybe > sure)
        for rows in np.array_split(open_, max(1, int((maybe - sure)[open_].sum()) >> 20)):
            if len(rows):   # the first points ranked between the two counts
                counts = (maybe - sure)[rows]
                ends = np.cumsum(counts)
                place = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(len(order) - maybe[rows], counts)
                i, j = order[place], np.repeat(rows, counts)
                s = (self.y1[j] - self.y0[i]) / (self.x1[j] - self.x0[i])
                less, upto = less + int((s < m).sum()), upto + int((s <= m).sum())
        return less, upto

    def possible(self, lo: float, hi: float) -> np.ndarray:
        """Per second point, at least as many as its slopes inside (lo, hi)."""
        if not self.plain:
            return np.full(len(self.x1), len(self.x0))
        upto = np.full(len(self.x1), len(self.x0)) if hi == np.inf else self._band(hi)[1]
        return upto - (0 if lo == -np.inf else self._band(lo)[0])

    def inside(self, lo: float, hi: float) -> np.ndarray:
        """All slopes inside (lo, hi)."""
        found = [np.zeros(0)]
        rows = np.flatnonzero(self.possible(lo, hi) > 0)
        for part in np.array_split(rows, max(1, len(rows) * len(self.x0) >> 20)):
            if len(part):
                s, real = self.slopes_of(part)
                found.append(s[real & (s > lo) & (s < hi)])
        return np.concatenate(found)

    def draw(self, lo: float, hi: float, share: float, rng: np.random.Generator) -> np.ndarray:
        """A sample of the slopes inside (lo, hi): second points are drawn by
        their possible slopes, then one of the first points each."""
        weight = self.possible(lo, hi)
        n = rng.poisson(share * weight.sum())
        if not n:
            return np.zeros(0)
        rows = rng.choice(len(weight), n, p=weight / weight.sum())
        s, real = self.slopes_of(rows)
        fits = real & (s > lo) & (s < hi)
        # as often as the second point was drawn for slopes that are there
        kept = rng.random(n) * weight[rows] < fits.sum(axis=1)
        pick = np.array([rng.choice(np.flatnonzero(f)) for f in fits[kept]], dtype=int)
        return s[kept][np.arange(len(pick)), pick]


def _pairs(points: DataFrame, sid: Sequence[str], state: DataFrame) -> DataFrame:
    """A row for each pair of blocks of a series (block <= other), with the
    series' state; blocks are copied to their pairs, then joined by pair."""
    left = points.select(*sid, F.col("_b").alias("_i"), F.explode(F.sequence("_b", F.col("_k") - 1)).alias("_j"),
                         F.col("xs").alias("x0"), F.col("ys").alias("y0"))
    right = points.select(*sid, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"),
                          F.col("xs").alias("x1"), F.col("ys").alias("y1"))
    return join_keys(join_keys(left, right, [*sid, "_i", "_j"]), state, sid)


def _work(pairs: DataFrame, sid: Sequence[str], columns: str, job) -> DataFrame:
    """``job(pair, state row, number of the pair)`` yields result rows."""
    types = {f.name: f.dataType for f in pairs.schema.fields}
    schema = T.StructType([T.StructField(k, types[k]) for k in sid] + list(T._parse_datatype_string(columns).fields))
    names = [f.name for f in schema.fields][len(sid):]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            rows = batch.to_pylist()
            at, out = [], []
            for k, r in enumerate(rows):
                pair = BlockPair((np.array(r["x0"]), np.array(r["y0"])), (np.array(r["x1"]), np.array(r["y1"])), r["_i"] == r["_j"])
                for values in job(pair, r):
                    at.append(k)
                    out.append(values)
            if kinds is None:
                kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64() for f in schema.fields[len(sid):]]
            cols = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at, pa.int64())) for c in sid]
                                             + [pa.array(c, t) for c, t in zip(cols, kinds)], [*sid, *names])

    return pairs.mapInArrow(run, schema)


def _long_series(rows: DataFrame, sid: Sequence[str], z: float) -> DataFrame:
    """(sid..., n, slope, intercept, ci_lower, ci_upper) of series of any
    length."""
    sid = list(sid)
    t = F.col("_t")

    def ties(column: str) -> DataFrame:
        counts = rows.groupBy(*sid, column).agg(F.count(F.lit(1)).alias("_t"))
        return counts.groupBy(*sid).agg(F.sum(t).alias("n"), F.sum(t * (t - 1) / 2).cast("long").alias("equal"),
                                        F.sum(t * (t - 1) * (2 * t + 5)).cast("double").alias("ties"))

    of_y = ties("y").select(*sid, F.col("ties").alias("y_ties"))
    n, z_ = F.col("n"), F.lit(z)
    stats = join_keys(ties("x"), of_y, sid).withColumn("slopes", (n * (n - 1) / 2).cast("long") - F.col("equal"))
    sigma = F.sqrt(F.greatest(F.lit(0.0), (n * (n - 1) * (2 * n + 5) - F.col("ties") - F.col("y_ties")) / 18))
    total = F.col("slopes")
    ranks = F.array(F.floor((total - 1) / 2), F.floor(total / 2),
                    F.greatest(F.bround((total - z_ * sigma) / 2).cast("long") - 1, F.lit(0).cast("long")),
                    F.least(F.bround((total + z_ * sigma) / 2).cast("long"), total - 1))
    stats = materialise(stats.where("slopes > 0").select(*sid, "n", "slopes", ranks.alias("ranks")), "sen-stats")

    firsts = value_blocks(rows.select(*sid, "x").distinct(), sid, "x")
    placed = running(join_keys(rows.select(*sid, "x", "y"), firsts, [*sid, "x"]), sid, "_block", ["x", "y"], {"_at": F.lit(1)})
    points = placed.groupBy(*sid, F.floor(F.col("_at") / SHORT).alias("_b")).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("p"))
    points = join_keys(points, stats.select(*sid, F.ceil(n / SHORT).alias("_k")), sid)
    points = materialise(points.select(*sid, "_b", "_k", F.col("p.x").alias("xs"), F.col("p.y").alias("ys")), "sen-blocks")

    # per series and rank: the answer is inside (lo, hi); ``upto`` slopes are <= lo, ``under`` are < hi
    state = stats.select(*sid, F.posexplode("ranks").alias("which", "rank"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"),
                         F.lit(0).cast("long").alias("upto"), F.col("slopes").alias("under"), F.lit(None).cast("double").alias("found"))
    state = materialise(state, "sen-state")
    many = (F.col("under") - F.col("upto") > LISTED) & F.col("found").isNull()

    def packed(which: DataFrame, *names: str) -> DataFrame:
        return which.groupBy(*sid).agg(F.collect_list(F.struct("which", *names)).alias("ask"))

    rounds = 0
    while state.where(many).limit(1).count():   # one number
        rounds += 1
        seed = rounds

        def sample(pair: BlockPair, row: dict):
            rng = np.random.default_rng([seed, row["_i"], row["_j"]])
            for q in row["ask"]:
                for s in pair.draw(q["lo"], q["hi"], SAMPLED / (q["under"] - q["upto"]), rng):
                    yield q["which"], float(s)

        asked = packed(state.where(many), "lo", "hi", "upto", "under")
        drawn = _work(_pairs(points, sid, asked), sid, "which long, s double", sample)
        drawn = drawn.groupBy(*sid, "which").agg(F.sort_array(F.collect_list("s")).alias("sample"))
        size = F.size("sample")
        middle = (F.col("rank") - F.col("upto")) * size / (F.col("under") - F.col("upto"))
        slack = F.ceil(4 * F.sqrt(size))

        def at(place: Column) -> Column:
            return F.get("sample", F.least(F.greatest(F.floor(place), F.lit(0)), size - 1).cast("int"))

        pivots = join_keys(state.where(many), drawn, [*sid, "which"]).select(*sid, "which", at(middle - slack).alias("a"), at(middle + slack).alias("b"))
        pivots = materialise(pivots, "sen-pivots")

        def count(pair: BlockPair, row: dict):
            for q in row["ask"]:
                yield (q["which"], *pair.below(q["a"]), *pair.below(q["b"]))

        counted = _work(_pairs(points, sid, packed(pivots, "a", "b")), sid, "which long, a0 long, a1 long, b0 long, b1 long", count)
        counted = join_keys(counted.groupBy(*sid, "which").agg(*[F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")]), pivots, [*sid, "which"])
        r, a, b = F.col("rank"), F.col("a"), F.col("b")
        before, hit_a, between, hit_b = r < F.col("a0"), r < F.col("a1"), r < F.col("b0"), r < F.col("b1")
        met = F.col("a").isNotNull()
        lo = F.when(~met | before, F.col("lo")).when(between, a).otherwise(b)
        upto = F.when(~met | before, F.col("upto")).when(between, F.col("a1")).otherwise(F.col("b1"))
        hi = F.when(met & before, a).when(met & between, b).otherwise(F.col("hi"))
        under = F.when(met & before, F.col("a0")).when(met & between, F.col("b0")).otherwise(F.col("under"))
        hit = F.when(met & ~before & hit_a, a).when(met & ~before & ~between & hit_b, b).otherwise(F.col("found"))
        state = materialise(join_keys(state, counted, [*sid, "which"], "left").select(
            *sid, "which", "rank", lo.alias("lo"), hi.alias("hi"), upto.alias("upto"), under.alias("under"), hit.alias("found")), "sen-state")

    def listed(pair: BlockPair, row: dict):
        for q in row["ask"]:
            for s in pair.inside(q["lo"], q["hi"]):
                yield q["which"], float(s)

    left = packed(state.where("found IS NULL"), "lo", "hi")
    values = _work(_pairs(points, sid, left), sid, "which long, s double", listed)
    values = values.groupBy(*sid, "which").agg(F.sort_array(F.collect_list("s")).alias("all"))
    final = join_keys(state, values, [*sid, "which"], "left")
    final = final.withColumn("found", F.coalesce("found", F.get("all", (F.col("rank") - F.col("upto")).cast("int"))))
    four = final.groupBy(*sid).agg(*[F.max(F.when(F.col("which") == k, F.col("found"))).alias(f"r{k}") for k in range(4)])
    slope = F.when(F.col("slopes") % 2 == 1, F.col("r0")).otherwise((F.col("r0") + F.col("r1")) / 2)
    out = join_keys(stats, four, sid)
    for column in ("x", "y"):
        out = join_keys(out, exact_quantiles(rows, sid, column, [0.5], names=[f"{column}_mid"], with_count=False), sid)
    return out.select(*sid, "n", slope.alias("slope"), (F.col("y_mid") - slope * F.col("x_mid")).alias("intercept"),
                      F.col("r2").alias("ci_lower"), F.col("r3").alias("ci_upper"))


def theil_sen(series: DataFrame, sid: Sequence[str], min_n: int = 4, z: float = Z_975) -> DataFrame:
    """Per series (sid..., x, y[, n]): n, slope, intercept, ci_lower, ci_upper.

    Series with fewer than two points give no row; with fewer than ``min_n``
    points or a single x, null statistics.  Points may be in any order and x
    may repeat.  Without a column ``n`` the points are counted first.
    """
    sid = list(sid)
    fields = [f for f in series.schema.fields if f.name in sid]
    names = ["slope", "intercept", "ci_lower", "ci_upper"]
    schema = T.StructType([*sorted(fields, key=lambda f: sid.index(f.name)), T.StructField("n", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in names]])
    if "n" not in series.columns:
        series = materialise(series.select(*sid, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "sen-series")
        series = join_keys(series, series.groupBy(*sid).agg(F.count(F.lit(1)).alias("n")), sid)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = len(rows)
        found = sen_statistics(rows["x"].to_numpy(float), rows["y"].to_numpy(float), z) if n >= min_n else None
        return pd.DataFrame([[*key, n, *(found or [None] * 4)]], columns=[*sid, "n", *names])

    rows = series.select(*sid, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("n").cast("long").alias("n"))
    out = rows.where(F.col("n").between(2, SHORT)).groupBy(*sid).applyInPandas(run, schema)
    if (rows.agg(F.max("n")).first()[0] or 0) <= SHORT:
        return out
    many = rows.where(F.col("n") > SHORT)
    found = _long_series(many, sid, z)
    counted = many.select(*sid, "n").distinct()   # a single x has no slope
    found = join_keys(counted, found.drop("n"), sid, "left").select(*sid, "n", *names)
    return out.unionByName(found)
