"""Toxicity: FTRL-proximal logistic regression (operator 7).

Features of a text are the distinct hashes of its words, of its words cut to
their first bytes (truncation stems, so that an unseen inflection still has a
known feature), of its word pairs and of its skip-grams (pairs with one word
between), modulo ``2**bits``.
Per-coordinate learning rates and L1 give a sparse weight vector: the non-zero
weights (at most ``2**bits`` pairs, in practice a few thousand) are the whole
model and the only thing broadcast.

The classifier is fitted on a bounded sample of labelled rows
(about ``max_train_docs``, chosen by id hash); scoring reads
every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.llm.common import batch_word_hashes, chunks, free_name, hash_unit, id_remainder, materialise, mix_pair, raw_texts, table


@dataclass(frozen=True)
class Ftrl:
    """Production parameters."""

    bits: int = 20
    max_train_docs: int = 12_000
    #: features of the sample held by the driver at most (4 bytes each)
    max_train_features: int = 24_000_000
    epochs: int = 6
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    least_gradient: float = 0.002
    threshold: float = 0.7


#: Lengths of the truncation stems in bytes.
STEMS = (4, 5, 7)


def features(words: list[np.ndarray], bits: int) -> np.ndarray:
    """Distinct feature numbers of one text's word and stem hashes."""
    w = words[0]
    parts = [*words, mix_pair(w[:-1], w[1:], 1), mix_pair(w[:-2], w[2:], 2)]
    return np.unique(np.concatenate(parts) & np.uint64((1 << bits) - 1)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Sparse weights, sorted by feature number, and the bias."""

    bits: int
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.keys] = self.weights
        return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_ftrl(examples: list[tuple[np.ndarray, int]], p: Ftrl, seed: int = 7) -> Model:
    """FTRL-proximal over the examples (features, label) in seeded orders.

    For each coordinate: n sums squared gradients, z the gradients less the
    proximal shift; the weight is 0 while abs(z) <= l1, else
    -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2).  The bias has no L1.
    Examples whose error is below ``least_gradient`` change nothing.
    Without examples the model scores 0.5 everywhere, with one class only it
    approaches that class.
    """
    size = 1 << p.bits
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    zb = nb = bias = 0.0
    rng = np.random.default_rng(seed)
    for _ in range(p.epochs):
        for k in rng.permutation(len(examples)):
            x, y = examples[k]
            wi = w[x]
            g = float(_sigmoid(wi.sum() + bias)) - y
            if abs(g) < p.least_gradient:
                continue
            ni = n[x]
            grown = np.sqrt(ni + g * g)
            zi = z[x] + g - (grown - np.sqrt(ni)) / p.alpha * wi
            z[x], n[x] = zi, ni + g * g
            w[x] = np.where(np.abs(zi) <= p.l1, 0.0, (np.sign(zi) * p.l1 - zi) / ((p.beta + grown) / p.alpha + p.l2))
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / p.alpha * bias
            nb += g * g
            bias = -zb / ((p.beta + np.sqrt(nb)) / p.alpha + p.l2)
    keys = np.flatnonzero(w)
    return Model(p.bits, keys.astype(np.int32), w[keys].astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), label_col: str = "toxic") -> Model:
    """Fit on labelled rows whose crc32(doc_id as text) mod 3 is not 1,
    about ``max_train_docs`` of them, by id hash; if these have more than
    ``max_train_features`` features, the hash share is lowered in proportion,
    so no id or file is preferred.  Rows without label or id are no
    examples; null text has no features; conflicting labels of one id both
    count.  The texts are hashed to features by the tasks; the driver gets
    feature numbers of the bounded sample only."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL")
    known = known.where(id_remainder("doc_id", 3) != 1).withColumn("u", hash_unit("doc_id", "toxicity"))
    share = min(1.0, p.max_train_docs / max(1, known.count()))
    bits = p.bits

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words, at = batch_word_hashes(raw_texts(batch.column("text")), STEMS)
            rows = [features([w[i:j] for w in words], bits).tobytes() for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("y"), pa.array(rows, pa.binary())], ["u", "y", "x"])

    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known.where(F.col("u") < share)), "doc_id") \
        .select("u", "y", "text").mapInArrow(hashed, "u double, y int, x binary")
    sample = materialise(sample, "toxicity-sample")
    held = sample.agg(F.sum(F.octet_length("x") / 4)).first()[0] or 0
    sample = sample.where(F.col("u") < share * min(1.0, p.max_train_features / max(1, held)))
    return fit_ftrl([(np.frombuffer(r.x, np.int32), r.y) for r in sample.orderBy("u", "y", "x").toLocalIterator()], p)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` plus ``out_col``: probability of the label, in 0..1.

    Null, empty and wordless texts score by the bias alone.  A text of any
    length is read whole.  An input column named like the result is replaced.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out_col]
    from pyspark.sql import types as T
    hidden = free_name("_tox_text", [*docs.columns, out_col])
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias(hidden))
    schema = T.StructType(source.schema.fields[:-1] + [T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        weights, mask = m.dense(), np.uint64((1 << m.bits) - 1)
        for batch in chunks(batches, hidden):
            words, at = batch_word_hashes(raw_texts(batch.column(hidden)), STEMS)
            sums = _active_sums(words, at, weights, mask)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(_sigmoid(sums + m.bias).astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, kept + [out_col])

    return source.mapInArrow(run, schema)


def _active_sums(hashes: list[np.ndarray], at: np.ndarray, weights: np.ndarray, mask: np.uint64) -> np.ndarray:
    """Sum of the weights of each text's distinct features.  Only features
    with a weight are made distinct: few, whatever the text's length."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    words = hashes[0]
    keys, owner = [w & mask for w in hashes], [doc] * len(hashes)
    for gap, salt in ((1, 1), (2, 2)):
        same = doc[:-gap] == doc[gap:]
        keys.append(mix_pair(words[:-gap][same], words[gap:][same], salt) & mask)
        owner.append(doc[gap:][same])
    keys, owner = np.concatenate(keys).astype(np.int64), np.concatenate(owner)
    active = weights[keys] != 0
    pairs = np.unique((owner[active].astype(np.int64) << 32) | keys[active])
    return np.bincount(pairs >> 32, weights[pairs & 0xFFFFFFFF], minlength=len(at) - 1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Ftrl()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), p)
    return score(docs, model).select(
        "doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, p: Ftrl = Ftrl()) -> DataFrame:
    """Rows of ``docs`` that the model does not call toxic, columns as given."""
    name = free_name("_toxic_score", docs.columns)
    return score(docs, model, out_col=name).where(F.col(name) < p.threshold).select(*[f"`{c}`" for c in docs.columns])
