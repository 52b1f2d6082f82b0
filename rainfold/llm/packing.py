"""Conflict-constrained best-fit packing (operator 9).

Texts are packed into sequences (bins) of ``capacity`` tokens.  A text longer
than a bin fills whole bins; what remains of it is packed with the others.
Two pieces of one source, or of one duplicate cluster, never share a bin.

Bins are kept in the order of their residual space.  For a piece the search
starts at the tightest bin that it fits into and goes on to the next larger
residual until a bin is compatible; if none is, it opens a bin.  A bin
carries a bitmap of its sources and one of its clusters: a clear bit proves
compatibility, a set one is looked up in the bin's members, so the answer is
exact for any number of sources and clusters.

Pieces are dealt by hash to groups of bounded size, each packed on its own
(best-fit decreasing).  The number of groups follows the number of pieces, so
the work of a task does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.llm.common import chunks, materialise, raw_texts, table
from rainfold.llm.linking import column, whole_groups


@dataclass(frozen=True)
class PackParams:
    """Production parameters; tokens are the words of a text and one end."""

    capacity: int = 2048
    group: int = 4096     # pieces packed together, about


def pack(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each piece, in the order of the given pieces (longest
    first is the caller's choice).  Sources and clusters are 64-bit numbers;
    a piece is never longer than ``capacity``.

    Bins sit in arrays sorted by residual (ties: the older bin first)."""
    residual = np.zeros(0, np.int64)         # sorted
    bins = np.zeros(0, np.int64)             # bin number at each place
    source_bits, cluster_bits = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    members: list[tuple[set[int], set[int]]] = []
    out = np.zeros(len(lengths), np.int64)
    known, code = np.unique(sources, return_inverse=True)
    exact = len(known) <= 64  # one bit for each source: a set bit is a conflict
    sbit = np.uint64(1) << (code.astype(np.uint64) % np.uint64(64))
    cbit = np.uint64(1) << (clusters.astype(np.int64).view(np.uint64) % np.uint64(64))
    for k in range(len(lengths)):
        n, s, c = int(lengths[k]), int(sources[k]), int(clusters[k])
        at = int(np.searchsorted(residual, n))
        place = -1
        clear = (source_bits[at:] & sbit[k]) == 0
        sure = clear & ((cluster_bits[at:] & cbit[k]) == 0)
        first = int(sure.argmax()) if sure.any() else len(sure)
        for j in np.flatnonzero(clear[:first]) if exact else range(first):  # a bit is set: look the members up
            own = members[bins[at + j]]
            if s not in own[0] and c not in own[1]:
                place = at + int(j)
                break
        if place < 0 and first < len(sure):
            place = at + first
        if place < 0:
            number, left = len(members), capacity - n
            members.append(({s}, {c}))
            sb, cb = sbit[k], cbit[k]
        else:
            number, left = int(bins[place]), int(residual[place]) - n
            members[number][0].add(s)
            members[number][1].add(c)
            sb, cb = source_bits[place] | sbit[k], cluster_bits[place] | cbit[k]
            residual, bins = np.delete(residual, place), np.delete(bins, place)
            source_bits, cluster_bits = np.delete(source_bits, place), np.delete(cluster_bits, place)
        out[k] = number
        if left > 0:
            to = int(np.searchsorted(residual, left))
            while to < len(residual) and residual[to] == left and bins[to] < number:
                to += 1
            residual, bins = np.insert(residual, to, left), np.insert(bins, to, number)
            source_bits, cluster_bits = np.insert(source_bits, to, sb), np.insert(cluster_bits, to, cb)
    return out


def pieces(docs: DataFrame, p: PackParams, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           cluster_col: str | None = None) -> DataFrame:
    """(key, doc_id, source_key, cluster_key, n_tokens): a row per input row.
    Without ``cluster_col`` equal texts (up to white space and the case of
    A-Z) are one cluster."""
    given = cluster_col is not None
    cols = [F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"),
            F.col(text_col).cast("string").alias("text"),
            F.xxhash64(F.lit("source"), F.col(source_col).cast("string")).alias("source_key"),
            (F.xxhash64(F.lit("cluster"), F.col(cluster_col)) if given else F.lit(0).cast("long")).alias("cluster_key")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in chunks(batches):
            words = [t.lower().split() for t in raw_texts(batch.column("text"))]
            cluster = batch.column("cluster_key") if given else pa.array(
                np.array([xxhash.xxh64_intdigest(b" ".join(w)) for w in words], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), batch.column("source_key"), cluster,
                 pa.array([len(w) + 1 for w in words], pa.int64())], ["key", "doc_id", "source_key", "cluster_key", "n_tokens"])

    return docs.select(*cols).mapInArrow(run, "key long, doc_id long, source_key long, cluster_key long, n_tokens long")


def best_fit(docs: DataFrame, p: PackParams = PackParams(), **columns) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_group, bin, offset): a row for
    each piece of each input row; ``start`` is the piece's first token in its
    text, ``offset`` its place in the bin.  Bins are numbered within their
    group; full bins of long texts come after the packed ones.

    Null and empty texts are one token (the end).  Null sources are one source
    of their own.  Repeated rows are one cluster, so they never share a bin.
    Pieces of equal length are taken in the order of id, then of row.  An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    own = materialise(pieces(docs, p, **columns), "pack-pieces")
    groups = max(1, -(-own.count() // p.group))
    own = own.withColumn("bin_group", F.pmod(F.xxhash64("key", F.lit("group")), F.lit(groups)))
    n = min(groups, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))
    dealt = own.withColumn("rest", F.col("n_tokens") % p.capacity) \
        .repartition(n, "bin_group").sortWithinPartitions("bin_group", F.desc("rest"), "doc_id", "key")
    capacity = p.capacity

    def run(batches):
        for rows, begins in whole_groups(batches, ["bin_group"]):
            for i, j in zip(begins[:-1], begins[1:]):
                yield from _pack_group(rows.slice(i, j - i), capacity)

    return dealt.select("bin_group", "doc_id", "n_tokens", "rest", "source_key", "cluster_key").mapInArrow(
        run, "doc_id long, piece int, start long, n_tokens long, bin_group long, bin long, offset long")


def _pack_group(rows: pa.Table, capacity: int) -> Iterator[pa.RecordBatch]:
    rest, total = column(rows, "rest").astype(np.int64), column(rows, "n_tokens").astype(np.int64)
    some = np.flatnonzero(rest)
    where = pack(rest[some], column(rows, "source_key")[some], column(rows, "cluster_key")[some], capacity)
    full = total // capacity
    # full bins first, then the rest as the last piece
    source_row = np.concatenate([np.repeat(np.arange(len(rest)), full), some])
    piece = np.concatenate([np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full), full[some]])
    size = np.concatenate([np.full(full.sum(), capacity), rest[some]]).astype(np.int64)
    used = int(where.max()) + 1 if len(where) else 0
    number = np.concatenate([used + np.arange(full.sum()), where])
    order = np.argsort(where, kind="stable")
    offset = np.zeros(len(some), np.int64)
    if len(some):
        run = np.cumsum(rest[some][order]) - rest[some][order]
        first = np.concatenate([[True], where[order][1:] != where[order][:-1]])
        offset[order] = run - np.repeat(run[first], np.diff(np.append(np.flatnonzero(first), len(some))))
    doc = rows.column("doc_id").combine_chunks().take(pa.array(source_row))
    group = rows.column("bin_group")[0].as_py()
    yield pa.RecordBatch.from_arrays(
        [doc if isinstance(doc, pa.Array) else doc.combine_chunks(), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(size),
         pa.array(np.full(len(size), group, np.int64)), pa.array(number.astype(np.int64)),
         pa.array(np.concatenate([np.zeros(full.sum(), np.int64), offset]))],
        ["doc_id", "piece", "start", "n_tokens", "bin_group", "bin", "offset"])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
