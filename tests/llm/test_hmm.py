"""HMM scoring: base score by count, exact likelihood, Baum-Welch."""

import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from docs_fixture import documents, frame, words
from pyspark.sql import functions as F

from rainfold.llm import hmm
from rainfold.llm.common import materialise


def _model(k=3, classes=5, seed=1):
    r = np.random.default_rng(seed)
    start, move, emit = r.random(k), r.random((k, k)), r.random((classes, k))
    return hmm.Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _by_enumeration(m, seq):
    total, post_move, post_emit, post_start = 0.0, np.zeros_like(m.move), np.zeros_like(m.emit), np.zeros_like(m.start)
    for path in product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, s in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[s, b]
        total += p
        post_start[path[0]] += p
        for a, b in zip(path, path[1:]):
            post_move[a, b] += p
        for s, a in zip(seq, path):
            post_emit[s, a] += p
    return total, post_start / total, post_move / total, post_emit / total


def test_forward_and_expected_counts_are_exact():
    m = _model()
    seqs = [np.array(s, np.uint16) for s in ([0, 1, 2, 3, 4, 0], [1, 0, 0, 3], [2, 2, 1], [4])]
    logs = hmm.forward(m, seqs)
    e = hmm.Expected.zero(3, 5)
    hmm.expect(m, seqs, e)
    want = [_by_enumeration(m, s) for s in seqs]
    assert logs == pytest.approx([np.log10(w[0]) for w in want])
    assert e.start == pytest.approx(sum(w[1] for w in want))
    assert e.move == pytest.approx(sum(w[2] for w in want))
    assert e.emit == pytest.approx(sum(w[3] for w in want))
    assert e.log == pytest.approx(sum(logs))


@pytest.mark.parametrize("segment", [1, 7, 50, 400])
def test_segments_change_no_count(segment):
    """Long input is trained in segments of steps, with work arrays used before."""
    r = np.random.default_rng(2)
    m, room = _model(), hmm.Room()
    seqs = [r.integers(0, 5, n).astype(np.uint16) for n in (90, 90, 41, 41, 40, 7, 1, 1)]
    whole = hmm.Expected.zero(3, 5)
    hmm.expect(m, seqs, whole)
    assert whole.log == pytest.approx(hmm.forward(m, seqs).sum(), rel=1e-12)
    for some in (seqs, seqs[:1], seqs):
        apart, alone = hmm.Expected.zero(3, 5), hmm.Expected.zero(3, 5)
        hmm.expect(m, some, apart, room, segment)
        for s in some:
            hmm.expect(m, [s], alone)
        for name in ("start", "move", "emit", "log"):
            assert np.allclose(getattr(apart, name), getattr(alone, name), rtol=1e-11)
    assert np.allclose(apart.emit, whole.emit, rtol=1e-11)


def test_rare_classes_of_long_texts_do_not_underflow():
    """Emissions as small as 1e-60 for as long as the scale waits."""
    m = _model()
    m.emit[4] = 1e-60
    seqs = [np.array([4] * 30, np.uint16)]
    e = hmm.Expected.zero(3, 5)
    hmm.expect(m, seqs, e)
    assert e.emit[4].sum() == pytest.approx(30)
    assert hmm.forward(m, seqs)[0] == pytest.approx(-1800, abs=1e-6) and e.log == pytest.approx(-1800, abs=1e-6)


def test_training_raises_the_likelihood():
    r = np.random.default_rng(0)
    seqs = sorted(([np.array(r.choice([1, 2] if i % 2 else [3, 4], r.integers(5, 40)), np.uint16) for i in range(60)]), key=lambda s: -len(s))
    p = hmm.HmmParams(states=2, smoothing=1e-3)
    m = hmm.new_hmm(np.full(5, 0.2), p)
    logs = []
    for _ in range(15):
        e = hmm.Expected.zero(2, 5)
        hmm.expect(m, seqs, e)
        logs.append(e.log)
        m = hmm.normalised(e, np.full(5, 0.2), p)
    assert all(b >= a - 1e-3 for a, b in zip(logs, logs[1:])) and logs[-1] > logs[0] + 100


@pytest.mark.parametrize("known", [131_072, 40])   # all counts known to the tasks, and most by the join
def test_scores(spark, known):
    docs = documents()
    p = hmm.HmmParams(states=3, frequent=30, rare_classes=16, known_words=known, rounds=1, max_word_bytes=6)
    train = [zlib.crc32(("" if d[0] is None else str(d[0])).encode()) % 5 != 1 for d in docs]
    counts = Counter()
    for d, t in zip(docs, train):
        if t:
            counts.update(words(d[1]))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in zip(docs, train):
        tokens = words(d[1]) + [None]
        want.append((d[0], not t, len(tokens), sum(counts[w] > 0 for w in tokens), n,
                     round(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), 5)))
    got = hmm.score(frame(spark), F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 1, p).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    same = {round(r.score, 6) for r in got if r.doc_id in (0, 1)}
    assert len(same) == 1


def test_every_round_sees_the_corpus_until_it_settles(spark, monkeypatch):
    """Half of the texts, all shorter than one long text, have words of their own."""
    r = np.random.default_rng(5)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{x}" for x in r.integers(0, 30, 40))) for i in range(60)] + [(60, "c " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("train", F.lit(True))
    p = hmm.HmmParams(states=3, frequent=80, rare_classes=8)
    counts = hmm.word_counts(docs)
    lexicon = hmm.fit_lexicon(counts, len(rows), p)
    encoded = materialise(hmm.encode(docs, lexicon, p), "test-hmm")
    logs, rows_seen = [], hmm.baum_welch

    def watched(*args):
        e = rows_seen(*args)
        logs.append(e.log)
        assert e.start.sum() == pytest.approx(len(rows), rel=1e-9)     # each text counts in each round
        assert e.emit.sum() == pytest.approx(60 * 41 + 5001, rel=1e-9)
        return e
    monkeypatch.setattr(hmm, "baum_welch", watched)
    m = hmm.train(encoded, lexicon, p)
    assert 2 < len(logs) <= p.rounds and logs[-1] - logs[-2] <= p.settled * abs(logs[-1])
    assert logs[-1] > logs[0] + 100
    seqs = [np.frombuffer(x.seq, np.uint16) for x in encoded.orderBy(F.desc("n_tokens")).collect()]
    exact = hmm.Expected.zero(3, lexicon.classes(p))
    hmm.expect(m, seqs, exact)
    again = rows_seen(encoded, m, p)
    assert again.log == pytest.approx(exact.log) and exact.log >= logs[-1] - 0.01
    assert np.allclose(again.emit, exact.emit) and np.allclose(again.move, exact.move)


def test_untrained_and_empty(spark):
    p = hmm.HmmParams(states=2, frequent=10, rare_classes=8, rounds=1)
    got = hmm.score(frame(spark), F.lit(False), p).collect()
    assert {r.n_known for r in got} == {0} and {r.train_tokens for r in got} == {0}
    assert all(np.isfinite(r.score) for r in got)
    assert hmm.score(frame(spark, []), F.lit(True), p).count() == 0


def test_model_beats_word_counts_on_held_out_text(spark):
    got = [r for r in hmm.op6_hmm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
