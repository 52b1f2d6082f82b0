"""SimHash near-duplicates by the general pigeonhole principle (operator 4).

A fingerprint has 64 bits, a bit being the majority over the hashes of a
text's shingles.  Fingerprints within ``max_distance`` bits are linked; a
group is what links connect.

Search: the 64 bits are split into m parts (bits that go together in the
same part) and each part gets a threshold of its own, possibly 0 or -1 (part
unused), with sum ``max_distance - m + 1``.  By the general pigeonhole
principle two fingerprints within ``max_distance`` are within the threshold
in at least one part.  Thresholds come from dynamic programming over
estimated candidate counts; so does the number of parts.  The estimates only
decide the cost: every choice finds every link.  Each fingerprint is put
under its value in each used part, and probes the values within the part's
threshold; every candidate is verified on all 64 bits.

Only distinct fingerprints take part (copies share theirs), and large buckets
are cut into blocks of which each pair is compared on its own, so that
neither a group of copies nor a frequent value lands in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.llm.common import chunks, connected_components, free_name, hash_sample, materialise, raw_texts, table
from rainfold.llm.linking import TILE, column, forest, whole_groups

BITS = 64
#: Fingerprints of the sample from which candidate counts are estimated.
SAMPLE = 4096
#: Rows of a bucket compared in one task; larger buckets are cut into blocks.
BLOCK = 512


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned fingerprint of a text (A-Z lower-cased; words between space
    and \\x09-\\x0D; ``shingle`` words joined by spaces, repeats included;
    fewer words: the whole sequence; none: 0)."""
    import xxhash
    words = text.lower().split()  # bytes: lower() and split() are ASCII only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    ones = np.zeros(BITS, np.int64)
    n = len(words) - shingle + 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, 1 << 14):
        some = words[at:min(n, at + (1 << 14)) + shingle - 1]
        h = np.array([digest(join(s), 42) for s in zip(*(some[k:] for k in range(shingle)))], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp: long) of every row; null text as empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            fps = np.array([fingerprint(t, shingle) for t in raw_texts(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Part:
    """Bit numbers of a part and its threshold."""

    bits: tuple[int, ...]
    threshold: int


def part_values(fps: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The chosen bits of each fingerprint (uint64), packed."""
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def flips(width: int, threshold: int) -> np.ndarray:
    """Masks of up to ``threshold`` flipped bits, the empty mask first."""
    masks = [0]
    for t in range(1, threshold + 1):
        masks += [sum(1 << b for b in c) for c in combinations(range(width), t)]
    return np.array(masks, dtype=np.uint64)


def group_bits(sample: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """Split the bits into m parts of nearly equal width, each grown from the
    free bit with the most correlation by the bits most correlated with it."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    centred = bits - bits.mean(axis=0) if len(bits) else bits
    spread = np.sqrt((centred ** 2).sum(axis=0)) + 1e-9
    corr = np.abs((centred.T @ centred) / spread[:, None] / spread[None, :])
    np.fill_diagonal(corr, 0)
    constant = spread < 1e-6  # a bit that never changes goes with the others of its kind
    corr[np.ix_(constant, constant)] = 1.0
    free, parts = list(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        part = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < width:
            nxt = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(nxt)
            free.remove(nxt)
        parts.append(tuple(sorted(part)))
    return parts


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (from -1 up) with the given sum and the least cost.
    ``costs[i][t + 1]`` is the cost of threshold t in part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t, c in enumerate(part, start=-1):
                if s + t not in grown or cost + c < grown[s + t][0]:
                    grown[s + t] = (cost + c, chosen + [t])
        best = grown
    return best[total]


def plan(sample: np.ndarray, n: int, max_distance: int) -> list[Part]:
    """Parts and thresholds with the least estimated cost for n fingerprints.

    The cost of a threshold is its signatures and probes (rows that move) plus
    the candidate pairs it brings (a comparison, some hundred times cheaper),
    estimated from the pairs of the sample."""
    compare = 0.005
    pairs_per_sample_pair = (n / max(2, len(sample))) ** 2
    best: tuple[float, list[Part]] | None = None
    for m in range(2, max_distance + 2) if max_distance else (1,):
        parts, costs = group_bits(sample, m), []
        for bits in parts:
            v = part_values(sample, bits)
            near = np.zeros(max_distance + 1)
            for at in range(0, len(v), TILE):
                d = np.bitwise_count(v[at:at + TILE, None] ^ v[None, :])
                near += np.bincount(d.ravel(), minlength=BITS + 1)[:max_distance + 1]
            near[0] -= len(v)
            pairs = np.cumsum(near) / 2 * pairs_per_sample_pair
            rows = [n * (1.0 + (len(flips(len(bits), t)) if t else 0)) for t in range(max_distance + 1)]
            costs.append([0.0] + [rows[t] + compare * pairs[t] for t in range(max_distance + 1)])
        cost, thresholds = allocate(costs, max_distance - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [Part(b, t) for b, t in zip(parts, thresholds) if t >= 0])
    return best[1]


def _signatures(fps: DataFrame, parts: list[Part]) -> DataFrame:
    """(part, value, fp, own): each fingerprint under its own value of each
    part (own = 1) and under each value within the threshold (own = 0)."""
    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            for k, part in enumerate(parts):
                v = part_values(fp, part.bits)
                for at, mask in enumerate(flips(len(part.bits), part.threshold)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(fp), k, np.int32)), pa.array((v ^ mask).view(np.int64)), pa.array(fp.view(np.int64)),
                         pa.array(np.full(len(fp), at == 0))], ["part", "value", "fp", "own"])
    return fps.mapInArrow(run, "part int, value long, fp long, own boolean")


def links(fps: DataFrame, parts: list[Part], max_distance: int) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct ``fps`` (fp) which links
    connect."""
    sigs = _signatures(fps, parts)
    size = sigs.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    size = materialise(size.select("part", "value", F.ceil(F.col("n") / BLOCK).alias("blocks")), "simhash-large")
    dealt = sigs.join(size, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select(
        "part", "value", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "fp", "own")
    keys = ["part", "value", "lo", "hi"]
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, *keys).sortWithinPartitions(*keys, "block", "fp")

    def run(batches):
        for rows, begins in whole_groups(batches, keys):
            a, b = _group_links(column(rows, "fp").astype(np.int64).view(np.uint64), column(rows, "own"), column(rows, "block"),
                                begins, max_distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


#: Groups up to this size are compared together, distance by distance.
SMALL = 32


def _group_links(fp: np.ndarray, own: np.ndarray, block: np.ndarray, begins: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(begins)
    group = np.repeat(np.arange(len(size)), size)
    small = size[group] <= SMALL
    out_a, out_b = [], []
    f, g, o = fp[small], group[small], own[small]
    for gap in range(1, SMALL):
        same = (g[:-gap] == g[gap:]) if len(g) > gap else np.zeros(0, bool)
        if not same.any():
            break
        i = np.flatnonzero(same)
        i = i[(o[i] | o[i + gap]) & (f[i] != f[i + gap])]
        i = i[np.bitwise_count(f[i] ^ f[i + gap]) <= most]
        out_a.append(f[i])
        out_b.append(f[i + gap])
    for k in np.flatnonzero(size > SMALL):
        rows = slice(begins[k], begins[k + 1])
        for a, b in _large_links(fp[rows], own[rows], block[rows], most):
            out_a.append(a)
            out_b.append(b)
    if not out_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _large_links(fp, own, block, most):
    """Forest of a large group.  Of two blocks only the pairs between them are
    compared; pairs of two probes are no candidates."""
    lo = block == block[0]
    one = bool(lo.all())
    left, right = (np.flatnonzero(lo), np.flatnonzero(lo if one else ~lo))
    for i in range(0, len(left), TILE):
        for j in range(i if one else 0, len(right), TILE):
            r, c = left[i:i + TILE], right[j:j + TILE]
            mask = np.bitwise_count(fp[r][:, None] ^ fp[c][None, :]) <= most
            mask &= own[r][:, None] | own[c][None, :]
            if one and i == j:
                np.fill_diagonal(mask, False)
            edges = forest(mask, one and i == j)
            if edges:
                e = np.array(edges)
                keep = fp[r[e[:, 0]]] != fp[c[e[:, 1]]]
                yield fp[r[e[:, 0]]][keep], fp[c[e[:, 1]]][keep]


def components(own: DataFrame, max_distance: int) -> DataFrame:
    """(fp, root, component_id) for the distinct fingerprints of ``own``
    (doc_id, fp)."""
    distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    total = distinct.count()
    sample = np.array(sorted(r.fp for r in hash_sample(distinct.select("fp"), ["fp"], SAMPLE, total, "simhash").collect()), dtype=np.int64)
    parts = plan(sample.view(np.uint64), total, max_distance)
    root = connected_components(links(distinct.select("fp"), parts, max_distance))
    rooted = distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per input row.

    ``component_id`` is the smallest id among the rows whose fingerprints the
    links connect (null only if all of them are null).  Null and wordless
    texts have fingerprint 0, linked like any other; texts of any length are
    read whole.  Repeated rows share a component; an empty table gives an empty result; other columns are
    ignored.
    """
    own = materialise(fingerprints(df, id_col, text_col, shingle), "simhash-fp")
    return own.join(components(own, max_distance), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """One row of ``docs`` for each group, columns as given: the one with the
    smallest doc_id (null ids last, then the smallest fingerprint).  Rows that
    share an id are told apart by their fingerprints, equal rows are one."""
    own = materialise(fingerprints(docs, shingle=shingle), "simhash-fp")
    grouped = own.join(components(own, max_distance), "fp")
    chosen = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")).alias("c"))
    id_, fp, row_fp = (free_name(n, docs.columns) for n in ("_id", "_fp", "_row_fp"))
    chosen = chosen.select(F.col("c.doc_id").alias(id_), F.col("c.fp").alias(fp))
    shared = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias(id_))
    shared = materialise(shared, "simhash-shared")
    same_id = docs["doc_id"].cast("long").eqNullSafe(F.col(id_))
    if shared.isEmpty():
        return docs.join(chosen, docs["doc_id"].cast("long") == F.col(id_), "left_semi")
    alone = chosen.join(shared, id_, "left_anti").where(F.col(id_).isNotNull())
    single = docs.join(alone, docs["doc_id"].cast("long") == F.col(id_), "left_semi")
    several = docs.join(shared, same_id, "left_semi")

    def run(batches):
        for batch in chunks(batches):
            fps = np.array([fingerprint(t, shingle) for t in raw_texts(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], [*batch.schema.names, row_fp])

    from pyspark.sql import types as T
    marked = several.mapInArrow(run, T.StructType([*several.schema.fields, T.StructField(row_fp, T.LongType())]))
    marked = marked.join(chosen, marked["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.col(row_fp) == F.col(fp)), "left_semi")
    return single.unionByName(marked.dropDuplicates(["doc_id", row_fp]).drop(row_fp))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
