"""Merkle dataset manifest by cogrouped subtree exchange (operator 11).

Every row is a leaf; the leaves of one tree (here: one language) are numbered
in key order and cut into superblocks of ``2**LEVELS``.

* Up: a superblock is reduced to its top node, the tops of a tree are the
  leaves of the next stage, and so on until every tree is one node.  The tops
  of all trees, in tree order, are the leaves of one more tree, whose top is
  the root.  A stage has a ``2**LEVELS``-th of the rows of the stage below.
* Down: a superblock of a stage needs, besides its own leaves, only the
  siblings on the way from its top to the root (its *outer nodes*: one row).
  Both are cogrouped by superblock in ``applyInPandas``, which rebuilds the
  local subtree, joins local and outer siblings to each leaf's proof and, at
  the lowest stage, folds the proofs.

No task ever holds more than one superblock and one outer row; a tree that
holds all rows is spread over as many superblocks as it needs.

Inner nodes are the SHA-256 of their children's hex digests; a run of one node
at the end of a level is hashed alone.  A proof entry is ``L`` or ``R`` (the
side of the sibling) and its digest, or empty where there is no sibling.

Null columns are marked in the leaf; a null key sorts first; rows of equal
keys are ordered by their digest (equal rows are equal leaves, so their order
does not matter); empty text is a value of length 0; a text of any length is
hashed in its row and never shuffled; an empty table gives no row (there is no
root).  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rainfold.llm.common import materialise, table

#: Levels of a superblock: 1,024 leaves.
LEVELS = 10
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def node_hash(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_hash(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each ``-`` if null, else ``bytes:value``."""
    marked = []
    for v in values:
        v = v.cast("string")
        marked.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*marked).cast("binary"), 256)


def reduce_levels(nodes: list[str], steps: int) -> list[list[str]]:
    """The levels above ``nodes``, itself first."""
    levels = [nodes]
    for _ in range(steps):
        below = levels[-1]
        levels.append([node_hash(below[k:k + 2]) for k in range(0, len(below), 2)])
    return levels


def siblings(levels: list[list[str]], k: int) -> list[str]:
    """Proof entries of leaf ``k`` up to the last of the ``levels``."""
    out = []
    for level in levels[:-1]:
        other = k ^ 1
        out.append(("L" if other < k else "R") + level[other] if other < len(level) else "")
        k >>= 1
    return out


def fold(node: str, proof: Sequence[str]) -> str:
    """The top that ``node`` leads to with the siblings of ``proof``."""
    for entry in proof:
        if entry:
            node = node_hash((entry[1:], node) if entry[0] == "L" else (node, entry[1:]))
        else:
            node = node_hash((node,))
    return node


def proof_digest(proof: Sequence[str]) -> str:
    return node_hash([entry[1:] for entry in proof])


def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` plus ``pos`` (0-based place in its ``tree``, by ``order``)
    and ``height`` (levels of that tree).

    The rows are dealt by range of (tree, order, a row number for repeated
    rows), numbered in their task and written; the tasks' counts per tree give
    the offsets, so no tree is ever in one task."""
    spark = nodes.sparkSession
    names = nodes.columns
    keys = ["tree", *order, "_tie"]
    dealt = nodes.withColumn("_tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)

    def number(batches):
        from pyspark import TaskContext
        task, tree, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column("tree"), run_end_type=pa.int64())
            ends = np.asarray(runs.run_ends)
            begins = np.concatenate([[0], ends[:-1]])
            first, last = runs.values[0].as_py(), runs.values[-1].as_py()
            place = np.arange(batch.num_rows) - np.repeat(begins, ends - begins)
            if first == tree:
                place[:ends[0]] += seen
            tree, seen = last, int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(np.full(batch.num_rows, task)), pa.array(place)], [*names, "_task", "_place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields) + ", _task long, _place long"
    rows = materialise(dealt.mapInArrow(number, schema), "merkle-numbered")
    counts = rows.groupBy("tree", "_task").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("tree").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("tree", "_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"),
                           F.ceil(F.log2(F.sum("n").over(W.partitionBy("tree")).cast("double"))).cast("int").alias("height"))
    return rows.join(counts, ["tree", "_task"]).withColumn("pos", F.col("_before") + F.col("_place")).select(*names, "pos", "height")


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", LEVELS))


def build(nodes: DataFrame, order: Sequence[str]) -> list[DataFrame]:
    """Stages of the trees of ``nodes`` (tree, node, ...), lowest first, each
    (tree, pos, block, height, node); the last holds one node a tree."""

    def up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        height = int(rows["height"].iloc[0])
        steps = min(LEVELS, height)
        top = reduce_levels(rows.sort_values("pos")["node"].tolist(), steps)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "node": [top], "pos": [key[1]], "height": [height - steps]})

    stages = [materialise(_blocked(numbered(nodes, order)), "merkle-stage")]
    while True:
        most = stages[-1].agg(F.max("height")).first()[0]   # one number
        if not most:
            return stages
        tops = stages[-1].groupBy("tree", "block").applyInPandas(up, "tree string, node string, pos long, height int")
        stages.append(materialise(_blocked(tops), "merkle-stage"))


Finish = Callable[[pd.DataFrame, list[list[str]], pd.Series], pd.DataFrame]


def exchange(stage: DataFrame, outer: DataFrame, finish: Finish, schema: str) -> DataFrame:
    """Cogroup the leaves of a stage with their superblock's outer row and let
    ``finish`` turn both, with every leaf's proof to the root, into rows."""

    def down(rows: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        levels = reduce_levels(rows["node"].tolist(), min(LEVELS, int(rows["height"].iloc[0])))
        return finish(rows, [siblings(levels, k) for k in range(len(rows))], out.iloc[0])

    return stage.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(down, schema)


OUTER = "tree string, block long, proof array<string>, subroot string, root string"


def _as_outer(rows: pd.DataFrame, local: list[list[str]], out: pd.Series) -> pd.DataFrame:
    """Each node of a stage is a superblock's top of the stage below."""
    above = list(out["proof"])
    return pd.DataFrame({"tree": rows["tree"], "block": rows["pos"], "proof": [p + above for p in local],
                         "subroot": out["subroot"], "root": out["root"]})


def _as_trees(rows: pd.DataFrame, local: list[list[str]], out: pd.Series) -> pd.DataFrame:
    """Each leaf of the uppermost tree is a tree's top."""
    above = list(out["proof"])
    return pd.DataFrame({"tree": rows["name"], "block": 0, "proof": [p + above for p in local],
                         "subroot": rows["node"], "root": out["root"]})


def manifest(leaves: DataFrame, order: Sequence[str], finish: Finish, schema: str) -> DataFrame:
    """Trees of ``leaves`` (tree, node and the columns that ``finish`` reads)
    and over them the tree of their tops; ``finish`` gets the leaves of a
    superblock, their local proofs and the outer row (proof, subroot, root)."""
    stages = build(leaves, order)
    tops = stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    upper = build(tops, ["name"])
    outer = upper[-1].select("tree", F.col("pos").alias("block"), F.array().cast("array<string>").alias("proof"),
                             F.lit("").alias("subroot"), F.col("node").alias("root"))
    for stage in reversed(upper[1:]):
        outer = materialise(exchange(stage, outer, _as_outer, OUTER), "merkle-outer")
    outer = materialise(exchange(upper[0], outer, _as_trees, OUTER), "merkle-outer")
    for stage in reversed(stages[1:]):
        outer = materialise(exchange(stage, outer, _as_outer, OUTER), "merkle-outer")
    return exchange(stages[0], outer, finish, schema)


PROVED = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean, lang string, pos long")


def _prove(rows: pd.DataFrame, local: list[list[str]], out: pd.Series) -> pd.DataFrame:
    """Proof digests, and the root that each (tampered) leaf folds to.  The
    way above the superblock is folded once for each distinct local top."""
    above = list(out["proof"])
    tops: dict[str, str] = {}
    digests, folded = [], []
    for node, other, proof in zip(rows["node"], rows["tampered"], local):
        digests.append(proof_digest(proof + above))
        top = fold(other or node, proof)
        if top not in tops:
            tops[top] = fold(top, above)
        folded.append(tops[top])
    return pd.DataFrame({"doc_id": rows["doc_id"], "leaf": rows["node"], "subroot": out["subroot"], "root": out["root"],
                         "proof_sha256": digests, "folded_root": folded, "verified": [f == out["root"] for f in folded],
                         "lang": rows["lang"], "pos": rows["pos"]})


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(tree, doc_id, lang, node, tampered): one leaf a row, and the leaf with
    ``n_chars`` one higher where ``tampered`` holds (null: elsewhere, and where
    ``n_chars`` is null).  The tree is the language, null first."""
    values = [F.col(c) for c in FIELDS]
    raised = [F.col(c) if c != "n_chars" else F.col(c).cast("decimal(38,0)") + 1 for c in FIELDS]
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered & F.col("n_chars").isNotNull(), leaf_hash(raised))
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       leaf_hash(values).alias("node"), other.alias("tampered"))


def dataset_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: its leaf, the top of its language's tree, the
    root, the digest of its proof and the root its leaf folds to (see the
    module for nulls, ties and empty tables)."""
    leaves = materialise(document_leaves(docs, tampered), "merkle-leaves")  # texts are hashed once
    return manifest(leaves, ["doc_id", "node"], _prove, PROVED)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents``; a row without id is never tampered."""
    every_seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    docs = table(spark, sf_dir, "documents")
    return dataset_manifest(docs, F.coalesce(every_seventh, F.lit(False)))
