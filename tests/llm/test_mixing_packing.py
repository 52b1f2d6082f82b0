"""Mixing rates against a direct solver; packing against a plain best fit."""

from collections import defaultdict

import numpy as np
import pytest
from docs_fixture import documents, frame, words
from pyspark.sql import functions as F

from rainfold.llm import mixing as mx
from rainfold.llm import packing as pk
from rainfold.llm.common import materialise


def _solve(post, n, wanted, budget, p):
    """Projected gradient on the whole problem at once, many plain steps."""
    q, r = n / n.sum(), np.ones(len(n))
    base = q @ post
    target = wanted / wanted.sum() * budget
    for _ in range(20_000):
        err = ((q * r) @ post - target) / base
        r = np.maximum(0, r - (post @ err + p.ridge * (r - 1)) / (1 + p.ridge))
    return r


@pytest.mark.parametrize("budget", [None, 0.7])
def test_rates_minimise_the_objective(spark, budget):
    r = np.random.default_rng(1)
    post = r.dirichlet([0.6, 0.5, 0.4], 300)
    n = r.integers(1, 500, 300)
    members = materialise(spark.createDataFrame([(i, i, int(n[i]), post[i].tolist()) for i in range(300)],
                                                "key BIGINT, doc_id BIGINT, n_tokens BIGINT, post ARRAY<DOUBLE>"), "test-mix")
    p = mx.MixParams(budget=budget, rounds=400, tolerance=1e-10, ridge=1e-2)
    targets = {"a": 0.5, "b": 0.1, "c": 0.4}
    errors = mx.solve(members, ["a", "b", "c"], targets, p)
    got = {x.doc_id: x.rate for x in mx.with_rates(members, errors, p).collect()}
    wanted = np.array([0.5, 0.1, 0.4])
    base = (n / n.sum()) @ post
    want = _solve(post, n, wanted, budget or (base / wanted).max(), p)
    assert np.allclose([got[i] for i in range(300)], want, atol=2e-3)


def test_targets_are_met_and_nothing_is_lost(spark):
    rated = mx.op8_mixing(spark, "/root/testdata/sf0.01").collect()
    total = {d: sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in rated) for d in mx.TARGETS}
    whole = sum(total.values())
    for d, share in mx.TARGETS.items():
        assert total[d] / whole == pytest.approx(share, abs=2e-3)
    assert all(r.copies >= 1 for r in rated)                  # without a budget no domain shrinks
    assert sum(r.copies for r in rated) == pytest.approx(sum(r.rate for r in rated), rel=0.05)


@pytest.mark.parametrize("budget", [None, 0.7])
def test_a_domain_without_a_target_keeps_its_tokens(spark, budget):
    rows = [(100 * j + i, " ".join(f"{d}{(i * 7 + w) % 40}" for w in range(30 + i)), d)
            for j, (d, n) in enumerate({"en": 80, "de": 20, "it": 15}.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    labelled, lang = docs.withColumn("domain", F.col("lang")), {r[0]: r[2] for r in rows}
    p = mx.MixParams(budget=budget)
    rated = mx.mix(docs, labelled, {"en": 0.5, "de": 0.5}, p)[0].collect()
    assert all(r.rate == pytest.approx(1, abs=0.02) for r in rated if lang[r.doc_id] == "it")
    total = {d: sum(r.n_tokens * r.rate for r in rated if lang[r.doc_id] == d) for d in ("en", "de")}
    assert total["en"] / total["de"] == pytest.approx(1, abs=0.05)
    kept = {r.doc_id for r in mx.repeat_rows(docs, labelled, {"en": 0.5, "de": 0.5}, p).collect()}
    assert {i for i in lang if lang[i] == "it"} - kept == set()


def test_mixed_posteriors_drop_nothing_without_a_budget(spark):
    pure = np.eye(4) * 0.9996 + 1e-4
    kinds = {"both": (70, (pure[0] + pure[1]) / 2), "en": (800, pure[0]), "de": (40, pure[1]), "fr": (50, pure[2]), "es": (40, pure[3])}
    posts = [v / v.sum() for m, v in kinds.values() for _ in range(m)]
    members = materialise(spark.createDataFrame([(i, i, 100, x.tolist()) for i, x in enumerate(posts)],
                                                "key BIGINT, doc_id BIGINT, n_tokens BIGINT, post ARRAY<DOUBLE>").repartition(2), "test-floor")
    domains = ["en", "de", "fr", "es"]
    errors = mx.solve(members, domains, mx.TARGETS, floor=1.0)
    rated = mx.with_rates(members, errors, floor=1.0).collect()
    assert min(r.rate for r in rated) >= 1 and min(r.copies for r in rated) >= 1
    got = sum(r.rate * np.array(r.post) for r in rated)
    assert got / got.sum() == pytest.approx([mx.TARGETS[d] for d in domains], abs=2e-3)


def test_mix_keeps_texts_of_two_languages_and_theirs(spark):
    def text(i, *langs):
        return " ".join(f"{d}{(i * 7 + w) % 40}" for w in range(40) for d in langs)
    rows = [(i, text(i, "en"), "en") for i in range(80)] + [(100 + i, text(i, "de"), "de") for i in range(8)]
    docs = spark.createDataFrame(rows + [(200 + i, text(i, "en", "de"), None) for i in range(20)], "doc_id BIGINT, text STRING, lang STRING")
    rated = mx.mix(docs, docs.withColumn("domain", F.col("lang")), {"en": 0.5, "de": 0.5})[0].collect()
    assert len(rated) == 108 and all(r.rate >= 1 and r.copies >= 1 for r in rated)


def test_mixing_edge_cases(spark):
    df = frame(spark)
    labelled = df.withColumn("domain", F.col("lang"))
    out = mx.repeat_rows(df, labelled, {"en": 0.5, "de": 0.5})
    assert out.columns == df.columns
    again = mx.repeat_rows(df, labelled, {"en": 0.5, "de": 0.5})
    assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, again.select("doc_id", "text").collect()))
    rated, domains = mx.mix(df, labelled.where(F.lit(False)), {"en": 1.0})
    assert domains == ["all"] and {r.rate for r in rated.collect()} == {1.0}
    rated, _ = mx.mix(df, labelled, {})
    assert {r.rate for r in rated.collect()} == {1.0}
    assert mx.mix(frame(spark, []), labelled, {"en": 1.0})[0].count() == 0


def _plain_best_fit(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fit = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= n and s not in b["s"] and c not in b["c"]]
        if fit:
            i = min(fit)[1]
        else:
            bins.append({"left": capacity, "s": set(), "c": set()})
            i = len(bins) - 1
        bins[i]["left"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
        out.append(i)
    return out


@pytest.mark.parametrize("n_sources", [5, 200])   # bits exact, and bits shared by several sources
def test_tightest_compatible_bin(n_sources):
    r = np.random.default_rng(n_sources)
    for _ in range(6):
        n = 400
        lengths = np.sort(r.integers(1, 100, n))[::-1]
        sources = r.integers(-2**62, 2**62, n_sources)[np.where(r.random(n) < 0.3, 0, r.integers(0, n_sources, n))]
        clusters = r.integers(-2**62, 2**62, 60)[r.integers(0, 60, n)]
        assert pk.pack(lengths, sources, clusters, 100).tolist() == _plain_best_fit(lengths.tolist(), sources.tolist(), clusters.tolist(), 100)


def test_packing_is_whole_and_without_conflicts(spark):
    docs = documents()
    p = pk.PackParams(capacity=256, group=8)
    got = pk.best_fit(frame(spark), p).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_group, r.bin].append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):   # no gaps, no overlaps, not over capacity
            assert r.offset == at
            at += r.n_tokens
        assert at <= 256
    tokens = defaultdict(int)
    for r in got:
        tokens[r.doc_id] += r.n_tokens
    want = defaultdict(int)
    for d in docs:
        want[d[0]] += len(words(d[1])) + 1
    assert tokens == want
    source = {d[0]: d[3] for d in docs if d[0] not in (6, None)}
    for b in bins.values():
        own = [source[r.doc_id] for r in b if r.doc_id in source]
        assert len(own) == len(set(own))
        assert len([r for r in b if r.doc_id in (0, 1, None)]) <= 1       # equal texts never meet
    assert pk.best_fit(frame(spark, []), p).count() == 0
