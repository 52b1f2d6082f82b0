"""Embedding near-dedup: spherical k-means cells, blocked cosines (operator 3).

1. Equal vectors are one node (with the number of its copies), so copies are
   never compared with each other.
2. Spherical k-means, fitted on a bounded sample of nodes, gives cells; a
   node belongs to the cell of its nearest centre.
3. A node is also put into every other cell that can hold a neighbour: with
   unit vectors x, y at an angle of at most acos(s) and centres a (of x), c
   (of y), y lies on c's side of the plane between the centres, so x is at
   most sin(acos(s)) beyond it.  This bound makes the result exact: no link is
   lost, whatever the centres.  A pair from two cells is compared in one of
   them only.
4. Cells are cut into blocks; each pair of blocks is one task whose cosines
   are matrix products in double precision.  It emits the number of links of
   each node and a spanning forest of the links, never the pairs.
5. Components of the forest; one representative (the smallest id) is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.llm.common import connected_components, hash_sample, materialise, table
from rainfold.llm.linking import TILE, column, forest, whole_groups


@dataclass(frozen=True)
class DedupParams:
    """Production parameters."""

    min_cosine: float = 0.95
    sample: int = 8192       # nodes the centres are fitted on
    max_cells: int = 2048
    rounds: int = 8
    block: int = 8192        # nodes of a cell on one side of a task


def unit_rows(column_: pa.Array) -> np.ndarray:
    """Matrix of unit vectors from a list column of equal, usable vectors."""
    flat = np.asarray(column_.flatten(), dtype=np.float64)
    m = flat.reshape(len(column_), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)   # squares of any finite vector stay finite and above zero
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 5) -> np.ndarray:
    """k unit centres of the unit rows ``x``; an emptied cell keeps its old
    centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def _usable(vec: str) -> str:
    return (f"{vec} IS NOT NULL AND size({vec}) > 0 AND NOT exists({vec}, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
            f" AND exists({vec}, x -> x <> 0)")


def _cells(nodes: DataFrame, centres: dict[int, np.ndarray], p: DedupParams) -> DataFrame:
    """(dim, cell, home, node, n, vec): every node in its cell (home) and in
    each cell where a neighbour may live and the pair is to be compared."""
    sent = nodes.sparkSession.sparkContext.broadcast(centres)
    reach = math.sqrt(max(0.0, 1.0 - p.min_cosine ** 2)) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                dims = part.column("dim").to_numpy()
                for dim in np.unique(dims):
                    rows = part.filter(pa.array(dims == dim))
                    x = unit_rows(rows.column("vec"))
                    c = sent.value.get(int(dim), np.eye(1, int(dim)))
                    sims = x @ c.T
                    home = sims.argmax(axis=1)
                    gaps = np.sqrt(np.maximum(0, 2 - 2 * np.clip(c @ c.T, -1, 1)))[home]
                    margin = sims[np.arange(len(x)), home][:, None] - sims
                    cells = np.arange(len(c))[None, :]
                    lower, higher = np.minimum(cells, home[:, None]), np.maximum(cells, home[:, None])
                    meets = np.where((lower + higher) % 2 == 0, lower, higher)  # where two cells' pairs are compared
                    other = (margin <= reach * gaps) & (meets == cells) & (cells != home[:, None])
                    i, cell = np.nonzero(other)
                    i, cell = np.concatenate([np.arange(len(x)), i]), np.concatenate([home, cell])
                    out = rows.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays(
                        [out.column("dim"), pa.array(cell.astype(np.int32)), pa.array(cell == home[i]), out.column("node"),
                         out.column("n"), out.column("vec")], ["dim", "cell", "home", "node", "n", "vec"])

    kind = nodes.schema["vec"].dataType.simpleString()
    return nodes.mapInArrow(run, f"dim int, cell int, home boolean, node long, n long, vec {kind}")


def _block_links(cells: DataFrame, p: DedupParams) -> DataFrame:
    """(a, b, n): for each node a its links found (n, weighted by copies; b
    null) and forest edges a - b (n null)."""
    sizes = cells.groupBy("dim", "cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.sum((~F.col("home")).cast("long")).alias("guests"))
    sizes = sizes.select("dim", "cell", F.greatest(F.ceil(F.col("homes") / p.block), F.lit(1)).alias("home_blocks"),
                         F.ceil(F.col("guests") / p.block).alias("guest_blocks"))
    rows = cells.join(sizes, ["dim", "cell"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("home_blocks")).otherwise(F.col("guest_blocks"))))
    rows = rows.withColumnRenamed("n", "copies")
    # tasks: home block i against home block j >= i, and against each guest block (numbered after the home blocks)
    last = F.col("home_blocks") + F.col("guest_blocks") - 1
    first = F.transform(F.sequence(F.col("block"), last), lambda j: F.struct(F.col("block").alias("lo"), j.alias("hi")))
    second = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("home_blocks") - 1), lambda i: i < F.col("block")),
                         lambda i: F.struct(i.alias("lo"), F.col("block").alias("hi")))
    as_guest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("home_blocks") - 1),
                           lambda i: F.struct(i.alias("lo"), (F.col("home_blocks") + F.col("block")).alias("hi")))
    tasks = F.when(F.col("home"), F.concat(first, second)).otherwise(as_guest)
    own = F.when(F.col("home"), F.col("block")).otherwise(F.col("home_blocks") + F.col("block"))
    dealt = rows.select("dim", "cell", own.alias("own"), "node", "copies", "vec", tasks.alias("tasks")) \
        .select("dim", "cell", "own", "node", "copies", "vec", F.explode("tasks").alias("t")) \
        .select("dim", "cell", "t.lo", "t.hi", (F.col("own") != F.col("t.lo")).cast("int").alias("side"), "node",
                F.col("copies").alias("n"), "vec")
    keys = ["dim", "cell", "lo", "hi"]
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, *keys).sortWithinPartitions(*keys, "side", "node")
    least = p.min_cosine

    def run(batches):
        for rows_, begins in whole_groups(batches, keys):
            for i, j in zip(begins[:-1], begins[1:]):
                if j - i > 1:
                    yield from _task(rows_.slice(i, j - i), least)

    return dealt.mapInArrow(run, "a long, b long, n long")


def _task(rows: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    node, n, side = column(rows, "node"), column(rows, "n"), column(rows, "side")
    x = unit_rows(rows.column("vec").combine_chunks())
    same = rows.column("lo")[0] == rows.column("hi")[0]
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    count, edges = np.zeros(len(node), np.int64), []
    for i in range(0, len(left), TILE):
        for j in range(i if same else 0, len(right), TILE):
            r, c = left[i:i + TILE], right[j:j + TILE]
            mask = x[r] @ x[c].T >= least
            square = same and i == j
            if square:
                np.fill_diagonal(mask, False)
            if not mask.any():
                continue
            count[r] += mask @ n[c]
            if not square:
                count[c] += mask.T @ n[r]
            edges += [(node[r[a]], node[c[b]]) for a, b in forest(mask, square)]
    some = np.flatnonzero(count)
    if len(some):
        a = np.concatenate([node[some], np.array([e[0] for e in edges], np.int64)])
        b = pa.array(np.concatenate([np.zeros(len(some), np.int64), np.array([e[1] for e in edges], np.int64)]),
                     mask=np.arange(len(a)) < len(some))
        k = pa.array(np.concatenate([count[some], np.zeros(len(edges), np.int64)]), mask=np.arange(len(a)) >= len(some))
        yield pa.RecordBatch.from_arrays([pa.array(a), b, k], ["a", "b", "n"])


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", p: DedupParams = DedupParams()) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per input row.

    Null, empty or zero vectors and vectors with null or non-finite components
    have no links and are their own component; vectors of different lengths
    are not linked.  Repeated rows are linked to each other like any two equal
    vectors.  ``kept`` compares the id with the smallest of its component; a
    null id is never kept unless the component has null ids only (then its
    component_id is null).  An empty table gives an empty result; other
    columns are ignored.
    """
    spark = df.sparkSession
    # single-precision vectors travel as such; every computation is in double precision
    kind = "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"))
    vectors = vectors.withColumn("usable", F.coalesce(F.expr(_usable("vec")), F.lit(False)))
    nodes = vectors.where("usable").groupBy("vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("node"), F.size("vec").alias("dim"), "vec", "n", "least"), "embed-nodes")
    total = nodes.count()
    sample = hash_sample(nodes, ["least", "node"], p.sample, total, "embeddings").select("dim", "vec").collect()
    centres: dict[int, np.ndarray] = {}
    for dim in {r.dim for r in sample}:
        x = np.array([r.vec for r in sample if r.dim == dim])
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        k = max(1, min(p.max_cells, math.ceil(math.sqrt(total * len(x) / len(sample)) / 16)))
        centres[dim] = spherical_kmeans(x, k, p.rounds)
    found = materialise(_block_links(_cells(nodes, centres, p), p), "embed-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    state = nodes.select("node", "vec", "n", "least").join(counts, "node", "left").join(roots, "node", "left") \
        .withColumn("root", F.coalesce("root", "node"))
    least = state.groupBy("root").agg(F.min("least").alias("component_id"))
    state = state.join(least, "root").select("vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = vectors.where("usable").join(state, "vec").select("vec_id", "n_links", "component_id")
    alone = vectors.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.expr("vec_id <=> component_id"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
