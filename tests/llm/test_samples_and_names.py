"""Samples don't depend on files or id order; helper names never clash;
propagation settles; extreme vectors are vectors."""

import random

import numpy as np
import pytest
from docs_fixture import VOCAB, frame
from pyspark.sql import functions as F

from rainfold.llm import embedding_dedup, language_id, mixing, quality_classifier, simhash, toxicity, url_filter
from rainfold.llm.common import free_name

HELPERS = ["_text", "_tox_text", "_TOX_TEXT", "_lid_text", "_toxic_score", "_id", "_fp", "_row_fp", "u", "y", "x", "n", "root", "share"]


def with_helpers(docs):
    names, out = {c.lower() for c in docs.columns}, docs
    for c in HELPERS:
        if c.lower() not in names:
            out, names = out.withColumn(c, F.lit("mine")), names | {c.lower()}
    return out


def test_free_name():
    assert free_name("_a", ["_A", "_a_", "b"]) == "_a__" and free_name("c", []) == "c"


def test_helper_names_as_input_columns(spark):
    plain, docs = frame(spark), with_helpers(frame(spark))
    labels = spark.createDataFrame([(0, 1, 1), (5, 0, 0), (7, 1, 0)], "doc_id BIGINT, toxic INT, quality INT")
    model = toxicity.train(docs, labels)
    a, b = (sorted(toxicity.score(d, model).select("doc_id", "score").collect(), key=str) for d in (docs, plain))
    assert a == b
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    models = language_id.train(docs)
    assert language_id.identify(docs, models).count() == plain.count()
    good = quality_classifier.train(docs, labels)
    assert quality_classifier.score(docs, good).count() == plain.count()
    kept, want = simhash.keep_one(docs), simhash.keep_one(plain)
    assert kept.columns == docs.columns

    def key(rows):
        return sorted((str(r.doc_id), r.text or "") for r in rows)
    assert key(kept.collect()) == key(want.collect())
    assert {r["_fp"] for r in kept.collect()} == {"mine"}


def prose(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n))


def labelled(spark, parts, order):
    """Documents of three languages; layouts that differ in files and order."""
    rnd = random.Random(9)
    alphabets = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr"}
    words = {k: ["".join(rnd.choice(a) for _ in range(rnd.randint(2, 6))) for _ in range(80)] for k, a in alphabets.items()}
    rows = [(i, prose(rnd, words[k], 40), k) for i, k in enumerate(["aa"] * 300 + ["bb"] * 60 + ["cc"] * 8)]
    rows[0] = (0, prose(rnd, words["aa"], 60_000), "aa")      # one very long text
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING").orderBy(order).repartition(parts, "lang")


@pytest.fixture(scope="module")
def layouts(spark):
    return labelled(spark, 1, F.col("lang")), labelled(spark, 7, F.desc("doc_id"))


def test_language_sample_is_the_same_in_any_layout(spark, layouts):
    p = language_id.LanguageIdParams(max_docs_per_lang=60, max_chars_per_lang=4000)
    a, b = (language_id.train(d, p) for d in layouts)
    assert a.langs == b.langs == ["aa", "bb", "cc"]
    assert all((x == y).all() for x, y in zip(a.logp, b.logp)) and (a.limits == b.limits).all()
    pred = language_id.identify(layouts[0], a).where("doc_id > 0").collect()
    assert sum(r.lang_pred == r.lang for r in pred) / len(pred) > 0.99
    with pytest.raises(ValueError):
        language_id.train(layouts[0], language_id.LanguageIdParams(max_langs=2))


def test_mixing_sample_keeps_rare_domains_in_any_layout(spark, layouts):
    p = mixing.MixParams(max_train_docs=60, max_train_words=5000, least_train_docs=5)
    a, b = (mixing.train(d.withColumn("domain", F.col("lang")), p) for d in layouts)
    assert list(a.domains) == list(b.domains) == ["aa", "bb", "cc"]
    assert (a.logp == b.logp).all() and (a.prior == b.prior).all() and a.sharpness == b.sharpness
    assert np.allclose(np.exp(a.prior), np.array([301, 61, 9]) / 371)      # true shares, whatever the sample


def test_toxic_forms_in_high_ids_are_learnt(spark):
    """The bound is reached long before the last ids; only these are toxic."""
    rnd = random.Random(3)
    rows = [(i, prose(rnd, VOCAB, 60) + (" vilething" if i >= 500 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i >= 500)) for i in range(600)], "doc_id BIGINT, toxic INT")
    p = toxicity.Ftrl(max_train_features=60_000, l1=1.0)
    models = [toxicity.train(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(k, "text"), labels, p) for k in (1, 6)]
    assert (models[0].keys == models[1].keys).all() and (models[0].weights == models[1].weights).all()
    probe = spark.createDataFrame([(1, prose(rnd, VOCAB, 60) + " vilething"), (2, prose(rnd, VOCAB, 60))], "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.score for r in toxicity.score(probe, models[0]).collect()}
    assert got[1] > 0.5 > got[2]


def test_distrust_reaches_the_end_of_a_chain(spark):
    """A chain of 17 hosts before a blocked one, and a cycle; exact scores."""
    rows = [(i, f"http://h{i}.net/p", f'<a href="http://h{i + 1}.net/">x</a>' if i < 17 else '<a href="http://bad.example.org/es/1">x</a>') for i in range(1, 18)]
    rows += [(50, "http://bad.example.org/es/1", '<a href="http://c1.net/">x</a>'), (51, "http://c1.net/", '<a href="http://c2.net/">x</a>'),
             (52, "http://c2.net/", '<a href="http://c1.net/">x</a><a href="http://bad.example.org/q">y</a>')]
    p = url_filter.Propagation()
    got = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")).collect()}
    handed = {"bad": {"h17": 0.5, "c2": 0.5}, "c2": {"c1": 1.0}, "c1": {"c2": 0.5, "bad": 0.5}, **{f"h{k}": {f"h{k - 1}": 1.0} for k in range(2, 18)}}
    score = {"bad": 0.15}
    for _ in range(600):
        new = {"bad": 0.15}
        for a, out in handed.items():
            for b, share in out.items():
                new[b] = new.get(b, 0) + p.damping * score.get(a, 0) * share
        score = new
    for k in range(1, 18):
        assert abs(got[k].distrust - score[f"h{k}"]) < 1e-7
        assert got[k].verdict == ("block" if score[f"h{k}"] >= p.min_distrust else "allow")
    assert got[4].verdict == "block" or score["h4"] < p.min_distrust
    assert abs(got[51].distrust - score["c1"]) < 1e-7 and got[51].verdict == "block"
    with pytest.raises(RuntimeError):
        url_filter.url_filter(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING"), p=url_filter.Propagation(rounds=3)).collect()


def test_vectors_of_any_finite_size_link(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1.0, 1.0]), (4, [5e-324, 0.0]), (5, [0.0, 0.0]), (6, [1e308, 0.0]),
            (7, [float("inf"), 1.0]), (8, None), (9, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 6: (1, 4), 5: (0, 5), 7: (0, 7), 8: (0, 8), 9: (0, 9)}
