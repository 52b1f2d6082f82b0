"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.session import ensure_checkpoint_dir

#: White space that separates words in every contract: space and \x09-\x0D.
WORD_SEPARATORS = "[\\x20\\x09-\\x0D]+"
#: Text handed to a vectorised step at once (bytes); a longer text goes alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    survives lost executors and computes the plan exactly once."""
    path = workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_remainder(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id counts as empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(k))


def hash_sample(df: DataFrame, cols: list[str], most: int, total: int, salt: str) -> DataFrame:
    """About ``most`` of the ``total`` rows (all if there are no more): those
    whose columns' hash is below the share.  No sort and no gathering; the
    number is binomial, so a few per cent beyond ``most`` at the very most for
    samples of thousands."""
    unit = F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return df.where(unit < F.lit(min(1.0, most / max(1, total))))


def free_name(base: str, columns: list[str]) -> str:
    """A column name that ``columns`` doesn't have (names differ by more than
    case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def hash_unit(column: str, salt: str) -> Column:
    """A number in 0..1 for each value, by hash: the order in which samples of
    rows are taken, whatever file they lie in."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(column)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        start = 0
        while start < len(sizes):
            total = np.cumsum(sizes[start:])
            stop = start + max(1, int(np.searchsorted(total, limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _fmix(h: np.ndarray) -> np.ndarray:
    """Final avalanche of a 64-bit hash (fixed public constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def mix_pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return _fmix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(salt)))


_BASE = 0x100000001B3
_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.cumprod(np.concatenate([[1], np.full(size - 1, _BASE)]).astype(np.uint64), dtype=np.uint64)
    return _powers


_CODES = np.arange(256)
_LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
#: Letters, digits and all non-ASCII bytes make words here.
_IN_WORD = ((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)


def word_hashes(text: bytes, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit hashes of the words (runs of letters, digits and non-ASCII
    bytes, A-Z lower-cased) of one text, in order; then, for each length in
    ``prefixes``, hashes of the words cut to so many bytes."""
    out = []
    start, n = 0, len(text)
    while start < n:
        stop = min(n, start + CHUNK_BYTES)
        while stop < n and _IN_WORD[_LOWER[text[stop]]]:
            stop += 1
        out.append(_piece_hashes(np.frombuffer(text, np.uint8, stop - start, start), prefixes)[1])
        start = stop
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.uint64)] * (1 + len(prefixes))


def _piece_hashes(raw: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where the words begin, and their hashes as in ``word_hashes``."""
    b = _LOWER[raw]
    inside = _IN_WORD[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, [np.zeros(0, np.uint64)] * (1 + len(prefixes))
    lens = np.flatnonzero(edge == -1) - starts
    chars = b[inside].astype(np.uint64) + np.uint64(1)
    firsts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    place = np.arange(len(chars)) - np.repeat(firsts, lens)
    terms = chars * _power_table(int(lens.max()))[place]
    return starts, [_fmix(np.add.reduceat(terms, firsts))] + [
        _fmix(np.add.reduceat(np.where(place < n, terms, np.uint64(0)), firsts) + np.uint64(n)) for n in prefixes]


def batch_word_hashes(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all texts' words, as in ``word_hashes``, and where each
    text's words begin (one entry more than there are texts)."""
    if sum(map(len, texts)) <= 2 * CHUNK_BYTES:  # one pass over the texts joined by a separator
        begins, hashes = _piece_hashes(np.frombuffer(b"\n".join(texts), np.uint8), prefixes)
        return hashes, np.searchsorted(begins, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    parts = [word_hashes(t, prefixes) for t in texts]
    return [np.concatenate(x) for x in zip(*parts)], np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b: long),
    root being the smallest node reachable.

    Alternating large-star and small-star steps: each round is two joins with
    a per-node minimum (map-side combined), so a hub with any number of
    neighbours is never gathered in one task; the number of rounds is
    logarithmic.  Every round is written to the shared folder.  Loops and
    repeated edges are allowed; null ends are ignored.
    """
    spark = edges.sparkSession
    e = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = materialise(e.distinct(), "cc")
    e, nodes = e.where("a > b"), e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    before = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                                             F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s"))
        e = materialise(small.select("s.a", "s.b").where("a > b").distinct(), "cc")
        # a sum of hashes tells whether the edge set changed; two long values, nothing else
        state = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "node", "left") \
        .select("node", F.coalesce("root", "node").alias("root"))
