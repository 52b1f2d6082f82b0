"""Quality classifier: hashed word n-grams, logistic regression (operator 13).

A word is a run of other than white space.  Its shape is what is left when
letters become ``a`` or ``A``, digits ``0`` and runs of one class a single
character (``Rewh.###`` is ``Aa.#``).  The features of a text are its hashed 1-, 2- and
3-grams of words, those of shapes, and for every word whether it equals one of
the two words before it, all modulo ``2**bits``; the value of a feature is its
share of the text's features times ``SCALE``, so that length alone says
nothing.

Weights come from follow-the-regularised-leader updates (per-coordinate rates,
L1 and L2) on a bounded sample of labelled rows: at most about
``max_train_docs`` documents and ``max_train_features`` features, both taken in
hash order by lowering the hash share, never by reading order.  A score is the
sigmoid of the sparse dot product of a text's values with the non-zero weights
(at most ``2**bits``, the only thing broadcast).  Scoring reads every text
whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainfold.llm.common import CHUNK_BYTES, _fmix, _power_table, chunks, free_name, hash_unit, id_remainder, materialise, mix_pair, raw_texts, table


@dataclass(frozen=True)
class Params:
    """Production parameters."""

    bits: int = 20
    max_train_docs: int = 16_000
    #: features of the sample held by the driver at most (8 bytes each)
    max_train_features: int = 12_000_000
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.05
    threshold: float = 0.5


#: Sum of a text's feature values.
SCALE = 20.0

_CODES = np.arange(256)
#: Space and \x09-\x0D separate words.
_SPACE = (_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13))
_SHAPE = _CODES.astype(np.uint8)
_SHAPE[(_CODES >= 97) & (_CODES <= 122) | (_CODES >= 128)] = ord("a")
_SHAPE[(_CODES >= 65) & (_CODES <= 90)] = ord("A")
_SHAPE[(_CODES >= 48) & (_CODES <= 57)] = ord("0")


def _run_hashes(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Hash of each owner's values, in order (owners ascend, each has some)."""
    counts = np.bincount(owner, minlength=n)
    firsts = np.cumsum(counts) - counts
    place = np.arange(len(values)) - np.repeat(firsts, counts)
    terms = (values.astype(np.uint64) + np.uint64(1)) * _power_table(int(counts.max()))[place]
    return _fmix(np.add.reduceat(terms, firsts) + counts.astype(np.uint64))


def word_and_shape_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of the bytes begin, their hashes and their shapes'."""
    inside = ~_SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    owner = np.cumsum(edge == 1)[inside] - 1
    letters, shapes = raw[inside], _SHAPE[raw[inside]]
    words = _run_hashes(letters, owner, len(starts))
    changes = np.ones(len(shapes), bool)
    changes[1:] = (shapes[1:] != shapes[:-1]) | (owner[1:] != owner[:-1])
    return starts, words, _run_hashes(shapes[changes], owner[changes], len(starts)) ^ np.uint64(0x5AFE)


def _batch_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, shape hashes and the text each word belongs to.  A long
    text is read in pieces that end between words."""
    found = []
    if sum(map(len, texts)) <= 2 * CHUNK_BYTES:
        starts, words, shapes = word_and_shape_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
        ends = np.cumsum([len(t) + 1 for t in texts])
        return words, shapes, np.searchsorted(ends, starts, side="right")
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            stop = min(len(text), at + CHUNK_BYTES)
            while stop < len(text) and not _SPACE[text[stop]]:
                stop += 1
            _, words, shapes = word_and_shape_hashes(np.frombuffer(text, np.uint8, stop - at, at))
            found.append((words, shapes, np.full(len(words), k)))
            at = stop
    return tuple(np.concatenate(x) for x in zip(*found))


def features(words: np.ndarray, shapes: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts' words and the text of each; n-grams never
    cross texts."""
    mask = np.uint64((1 << bits) - 1)
    keys, owner = [words & mask, shapes & mask], [doc, doc]
    again = np.zeros(len(words), np.uint64)
    for gap in (1, 2):
        again[gap:] |= ((words[gap:] == words[:-gap]) & (doc[gap:] == doc[:-gap])).astype(np.uint64)
    keys.append(_fmix(again + np.uint64(77)) & mask)
    owner.append(doc)
    for h, salt in ((words, 11), (shapes, 12)):
        same = doc[1:] == doc[:-1]
        pairs = mix_pair(h[:-1], h[1:], salt)
        keys.append(pairs[same] & mask)
        owner.append(doc[1:][same])
        same = doc[2:] == doc[:-2]
        keys.append(mix_pair(pairs[:-1], h[2:], salt + 2)[same] & mask)
        owner.append(doc[2:][same])
    return np.concatenate(keys).astype(np.int64), np.concatenate(owner)


@dataclass(frozen=True)
class Model:
    """Sparse weights, sorted by feature number, and the bias."""

    bits: int
    keys: np.ndarray
    weights: np.ndarray
    bias: float


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], p: Params = Params(), seed: int = 13) -> Model:
    """Follow the regularised leader over examples (feature numbers, values,
    label) in seeded orders.

    A coordinate keeps ``z`` (the sum of its gradients less the proximal terms)
    and ``n`` (of their squares).  Its weight is the minimiser of the
    regularised sum: 0 while abs(z) <= l1, else
    (sign(z) l1 - z) / ((beta + sqrt(n)) / alpha + l2).  The bias is a
    coordinate of value 1 without L1.  Without examples every score is 0.5.
    """
    size = (1 << p.bits) + 1      # the last coordinate is the bias
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    l1 = np.full(size, p.l1)
    l1[-1] = 0.0
    rng = np.random.default_rng(seed)
    for _ in range(p.epochs):
        for k in rng.permutation(len(examples)):
            keys, values, label = examples[k]
            keys, values = np.append(keys, size - 1), np.append(values, 1.0)
            weight = w[keys]
            gradient = (_sigmoid(weight @ values) - label) * values
            squares = n[keys]
            n[keys] = grown = squares + gradient * gradient
            rate = (np.sqrt(grown) - np.sqrt(squares)) / p.alpha
            z[keys] = lead = z[keys] + gradient - rate * weight
            bound = l1[keys]
            w[keys] = np.where(np.abs(lead) <= bound, 0.0, (np.sign(lead) * bound - lead) / ((p.beta + np.sqrt(grown)) / p.alpha + p.l2))
    keys = np.flatnonzero(w[:-1])
    return Model(p.bits, keys, w[keys].astype(np.float32), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, p: Params = Params(), label_col: str = "quality") -> Model:
    """Fit on labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    Rows without label or id are no examples; null text has no features;
    conflicting labels of one id both count; a repeated label row counts
    again.  The tasks hash the texts of the sampled rows (about
    ``max_train_docs``) and write their features; if these are more than
    ``max_train_features``, the hash share is lowered in proportion, so that
    every label keeps its share of the sample.  The driver reads the sample in
    hash order."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL")
    known = known.where(id_remainder("doc_id", 3) != 1).withColumn("u", hash_unit("doc_id", "quality"))
    share = min(1.0, p.max_train_docs / max(1, known.count()))
    bits = p.bits

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words, shapes, doc = _batch_hashes(raw_texts(batch.column("text")))
            keys, owner = features(words, shapes, doc, bits)
            pairs, counts = np.unique((owner << 32) | keys, return_counts=True)
            at = np.searchsorted(pairs, np.arange(batch.num_rows + 1, dtype=np.int64) << 32)
            totals = np.bincount(owner, minlength=batch.num_rows)
            x = [(pairs[i:j] & 0xFFFFFFFF).astype("<i4").tobytes() for i, j in zip(at[:-1], at[1:])]
            v = [(counts[i:j] * (SCALE / max(1, t))).astype("<f4").tobytes() for i, j, t in zip(at[:-1], at[1:], totals)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("u"), batch.column("y"), pa.array(x, pa.binary()), pa.array(v, pa.binary())], ["u", "y", "x", "v"])

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .join(known.where(F.col("u") < share), "doc_id").select("u", "y", "text")
    sample = materialise(sample.mapInArrow(hashed, "u double, y int, x binary, v binary"), "quality-sample")
    total = sample.agg(F.sum(F.octet_length("x") / 4)).first()[0] or 0
    sample = sample.where(F.col("u") < share * min(1.0, p.max_train_features / max(1, total)))
    rows = sample.orderBy("u", "y", "x").toLocalIterator()
    return fit([(np.frombuffer(r.x, "<i4").astype(np.int64), np.frombuffer(r.v, "<f4").astype(np.float64), r.y) for r in rows], p)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` plus ``out_col``: probability of label 1, in 0..1.

    Null, empty and wordless texts score by the bias alone; a text of any
    length is read whole, in pieces; equal texts have equal scores.  An input
    column named like the result is replaced; any other names may occur."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out_col]
    hidden = free_name("_text", [*docs.columns, out_col])
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias(hidden))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        weights = np.zeros(1 << m.bits, np.float32)
        weights[m.keys] = m.weights
        for batch in chunks(batches, hidden):
            sums, totals = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            keys, owner = features(*_batch_hashes(raw_texts(batch.column(hidden))), m.bits)
            sums += np.bincount(owner, weights[keys], minlength=batch.num_rows)
            totals += np.bincount(owner, minlength=batch.num_rows)
            p = _sigmoid(SCALE * sums / np.maximum(totals, 1) + m.bias)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], kept + [out_col])

    return source.mapInArrow(run, schema)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Params()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), p)
    return score(docs, model).select(
        "doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= p.threshold).cast("int").alias("predicted"))
