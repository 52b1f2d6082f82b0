"""Operator 13: definitions by plain Python, held-out accuracy, edge cases."""

import math

import numpy as np
from docs_fixture import frame
from pyspark.sql import functions as F

from rainfold.llm import quality_classifier as qc
from rainfold.llm.common import table

SF = "/root/testdata/sf0.01"


def plain_shape(word):
    out = []
    for b in word:
        c = "a" if 97 <= b <= 122 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b)
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out)


def test_hashes_tell_words_and_shapes_apart():
    text = "Rewh.### the THE!! the a1 é漢 \t Rewh.###\nqq99 x".encode()
    starts, words, shapes = qc.word_and_shape_hashes(np.frombuffer(text, np.uint8))
    tokens = text.split()
    assert len(starts) == len(tokens) == len(words)
    for x, y in ((words, tokens), (shapes, [plain_shape(t) for t in tokens])):
        for i in range(len(tokens)):
            for j in range(len(tokens)):
                assert (x[i] == x[j]) == (y[i] == y[j])


def test_features_by_definition():
    """Each text's features equal those of the text alone, in any batch, and
    their number is 3 a word and 2 n - 3 pairs and triples of each kind."""
    texts = [b"a b c d", b"", b"one", b"x x x y", b"  ", b"two words"]
    keys, owner = qc.features(*qc._batch_hashes(texts), 20)
    for k, text in enumerate(texts):
        n = len(text.split())
        if n:
            alone, _ = qc.features(*qc._batch_hashes([text]), 20)
            assert sorted(alone) == sorted(keys[owner == k])
        assert (owner == k).sum() == 3 * n + 2 * (max(0, n - 1) + max(0, n - 2))


def test_long_text_in_pieces(monkeypatch):
    text = (b"word%d " * 3000) % tuple(range(3000))
    whole = qc._batch_hashes([text])
    monkeypatch.setattr(qc, "CHUNK_BYTES", 1000)
    for a, b in zip(whole, qc._batch_hashes([text])):
        assert (a == b).all()


def test_updates_by_definition():
    """The vectorised fit equals the textbook updates, one coordinate at a
    time."""
    p = qc.Params(bits=4, epochs=3, l1=4.0)
    rnd = np.random.default_rng(1)
    examples = [(np.sort(rnd.choice(16, 5, replace=False)), rnd.random(5) * 3, int(rnd.random() < 0.5)) for _ in range(30)]
    z, n, w = [0.0] * 17, [0.0] * 17, [0.0] * 17
    order = np.random.default_rng(13)
    for _ in range(p.epochs):
        for k in order.permutation(len(examples)):
            x, v, y = examples[k]
            row = [*zip(x.tolist(), v.tolist()), (16, 1.0)]
            error = 1 / (1 + math.exp(-sum(w[i] * a for i, a in row))) - y
            for i, a in row:
                g = error * a
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
                z[i] += g - s * w[i]
                n[i] += g * g
            for i, _ in row:
                l1 = 0.0 if i == 16 else p.l1
                w[i] = 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)
    model = qc.fit(examples, p)
    dense = np.zeros(16)
    dense[model.keys] = model.weights
    assert np.allclose(dense, w[:16], atol=1e-6) and math.isclose(model.bias, w[16])
    assert 0 < len(model.keys) < 16


def test_scores_are_dot_products(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(30)
    model = qc.Model(12, np.arange(0, 4096, 3), np.random.default_rng(2).normal(size=1366).astype(np.float32), 0.25)
    dense = np.zeros(4096)
    dense[model.keys] = model.weights
    for row in qc.score(docs, model).collect():
        keys, _ = qc.features(*qc._batch_hashes([(row.text or "").encode()]), 12)
        x = qc.SCALE * dense[keys].sum() / max(1, len(keys)) + 0.25
        assert math.isclose(row.score, 1 / (1 + math.exp(-x)), rel_tol=1e-5)


def test_held_out_documents(spark):
    got = qc.op13_quality_classifier(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert len(got) > 80
    for r in got:
        assert r.predicted == r.quality, r
        assert 0 <= r.score <= 1


def test_only_text_and_training_labels_matter(spark):
    """Held-out labels, other columns and the order of rows change nothing."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("quality", F.when(qc.id_remainder("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = qc.train(docs, labels)
    b = qc.train(docs.withColumn("lang", F.lit("x")).repartition(5, "text"), flipped.orderBy(F.desc("doc_id")))
    assert a.bias == b.bias and (a.keys == b.keys).all() and (a.weights == b.weights).all()


def test_sample_bounds_keep_both_labels(spark):
    p = qc.Params(max_train_docs=150, max_train_features=30_000)
    model = qc.train(table(spark, SF, "documents"), table(spark, SF, "labels"), p)
    assert (model.weights > 0).any() and (model.weights < 0).any()


def test_awkward_rows(spark):
    docs = frame(spark).withColumn("_text", F.lit(1)).withColumn("`odd", F.lit(2)).withColumnRenamed("`odd", "u")
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (5, 1), (None, 1), (7, None), (999, 0)], "doc_id BIGINT, quality INT")
    model = qc.train(docs, labels)
    rows = qc.score(docs, model).collect()
    assert len(rows) == docs.count() and set(rows[0].asDict()) == set(docs.columns)
    bias = 1 / (1 + math.exp(-model.bias))
    assert {round(r.score, 9) for r in rows if not (r.text or "").split()} == {round(bias, 9)}
    assert len({r.score for r in rows if r.doc_id in (0, 1)}) == 1


def test_empty_tables(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT")
    model = qc.train(docs, labels)
    assert {r.score for r in qc.score(docs, model).collect()} == {0.5}
    assert qc.score(docs.limit(0), model).count() == 0
