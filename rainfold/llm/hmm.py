"""Hidden Markov language model (operator 6).

Words are emitted through classes: each of the most frequent words is a class
of its own, the others share classes by a hash of their last letters, and the
end of a text is a class.  A state emits a class, a class a word:

    P(word | state) = P(class | state) * P(word | class)

so that the state tables have a fixed size (``classes`` x ``states``) for any
vocabulary, while every word keeps a probability of its own from its count in
the whole corpus.

Training: expected counts (Baum-Welch) are computed by the tasks with the
scaled forward and backward recursions and summed by class across partitions
with one shuffle; the driver normalises tables of fixed size.  Every pass runs
over all training texts, in a few parts with a refreshed model after each, until
the likelihood settles.

Scoring: the scaled forward recursion gives the exact likelihood of each
whole text.  Texts of a batch advance together, longest first.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.llm.common import CHUNK_BYTES, chunks, id_remainder, materialise, table, workspace


@dataclass(frozen=True)
class HmmParams:
    """Production parameters."""

    states: int = 8
    frequent: int = 12_288          # words that are classes of their own, at most
    rare_classes: int = 2048        # shared classes
    known_words: int = 131_072      # words whose counts every task knows, at most
    max_word_bytes: int = 64        # longer words are never among those
    rounds: int = 30                # passes over all training texts, at most
    parts: int = 4                  # the model is refreshed after each part of a pass
    settled: float = 3e-4           # the gain of the log likelihood, relative to it, that ends training
    smoothing: float = 0.5


#: Words that advance together, about.
BATCH_WORDS = 800_000
#: Words whose states a task holds at once while it trains.
SEGMENT_WORDS = 1_000_000
#: The recursions are scaled once in so many steps; the least emission to this
#: power is far above the least double.
SCALE_STEPS = 4


def rare_class(word: bytes, p: HmmParams) -> int:
    """Shared class of a word: a hash of its last three bytes."""
    return zlib.crc32(word[-3:]) % p.rare_classes


@dataclass
class Lexicon:
    """What every task knows of the vocabulary; bounded by ``known_words`` and
    ``max_word_bytes``.  Classes: 0 the end, 1..F frequent words, then the
    rare classes."""

    count: dict[bytes, int]
    number: dict[bytes, int]       # class of a frequent word
    frequent: int
    rare_total: np.ndarray          # tokens in each rare class
    rare_kinds: np.ndarray          # words in each rare class
    tokens: int                     # N, ends included
    kinds: int                      # V, the end included
    ends: int

    def classes(self, p: HmmParams) -> int:
        return 1 + self.frequent + p.rare_classes

    def log_in_class(self, count, cls):
        """log10 P(word | rare class) of a word with ``count`` occurrences;
        one word never seen has half an occurrence in each class."""
        return np.log10((count + 0.5) / (self.rare_total[cls] + 0.5 * (self.rare_kinds[cls] + 1)))


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Where each text's words begin (one entry more than texts), the number
    of each word, and the distinct words (A-Z lower-cased; null has none)."""
    lower = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    lists = pc.ascii_split_whitespace(lower)
    at = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
    words = lists.flatten().cast(pa.binary())
    blank = np.asarray(pc.binary_length(lower)) == 0        # split into one empty word
    if blank.any():
        keep = np.ones(len(words), bool)
        keep[at[:-1][blank & (np.diff(at) > 0)]] = False
        lens = np.where(blank, 0, np.diff(at))
        at = np.concatenate([[0], np.cumsum(lens)])
        words = words.filter(pa.array(keep))
    coded = words.dictionary_encode()
    return at, np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    if len(at) < 2:
        return np.zeros(0, values.dtype)
    sums = np.add.reduceat(np.append(values, 0).astype(values.dtype), at[:-1])   # the zero keeps every beginning inside
    sums[np.diff(at) == 0] = 0
    return sums


def word_counts(docs: DataFrame) -> DataFrame:
    """(word: binary, c): occurrences over all texts of ``docs``; each task
    sums before the shuffle and holds a bounded table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in chunks(batches, limit=4 * CHUNK_BYTES):
            _, codes, words = batch_words(batch.column("text"))
            held.update(dict(zip(words, np.bincount(codes, minlength=len(words)).tolist())))
            if len(held) > 400_000:
                yield _counted(held)
                held.clear()
        if held:
            yield _counted(held)
    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])


def _largest(counts: DataFrame, most: int, max_bytes: int) -> list:
    """At most ``most`` words: all with at least the least count that admits
    no more.  Counted by steps of 2**(1/16), no sort of the vocabulary."""
    short = counts.where(F.octet_length("word") <= max_bytes)
    step = F.floor(F.log2("c") * 16)
    steps = short.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()
    total, least = 0, None
    for row in sorted(steps, key=lambda r: -r.s):
        if total + row.n > most:
            break
        total, least = total + row.n, row.s
    if least is None:
        return []
    return short.where(step >= least).collect()


def fit_lexicon(counts: DataFrame, ends: int, p: HmmParams) -> Lexicon:
    known = sorted(((r.c, bytes(r.word)) for r in _largest(counts, p.known_words, p.max_word_bytes)), key=lambda x: (-x[0], x[1]))
    frequent = [w for _, w in known[:p.frequent]]
    number = {w: i + 1 for i, w in enumerate(frequent)}
    cls = F.pmod(F.crc32(F.expr("substring(word, greatest(octet_length(word) - 2, 1), 3)")), F.lit(p.rare_classes))
    whole = counts.groupBy(cls.cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    total, kinds = np.zeros(p.rare_classes), np.zeros(p.rare_classes)
    for r in whole:
        total[r.k], kinds[r.k] = r.c, r.n
    tokens, words = int(total.sum()), int(kinds.sum())
    for c, w in known[:p.frequent]:
        total[rare_class(w, p)] -= c
        kinds[rare_class(w, p)] -= 1
    return Lexicon({w: c for c, w in known}, number, len(frequent), total, kinds, tokens + ends, words + (ends > 0), ends)


def encode(docs: DataFrame, lexicon: Lexicon, p: HmmParams, id_col: str = "doc_id") -> DataFrame:
    """(key, part, doc_id, train, n_tokens, seq, logs...): a row per text, each
    in one of ``parts`` parts by its key's hash; ``seq`` its classes as unsigned 16-bit numbers, the end included.  Sums over the
    words that the lexicon counts are complete; the others are listed with
    their number of occurrences (``rest``, ``times``)."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    key = F.monotonically_increasing_id()
    source = docs.select(key.alias("key"), F.pmod(F.xxhash64(key), F.lit(p.parts)).cast("int").alias("part"), F.col(id_col).cast("long").alias("doc_id"), "train", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = sent.value
        place = {w: i for i, w in enumerate(x.count)}      # most frequent first: the first ``frequent`` are classes
        occurs = np.fromiter(x.count.values(), np.float64, len(place))
        for batch in chunks(batches, limit=4 * CHUNK_BYTES):
            at, codes, words = batch_words(batch.column("text"))
            i = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
            known, own = i >= 0, (i >= 0) & (i < x.frequent)
            cls = i + 1
            cls[~own] = 1 + x.frequent + np.fromiter((rare_class(words[k], p) for k in np.flatnonzero(~own)), np.int64, int((~own).sum()))
            base, inside = np.zeros(len(words)), np.zeros(len(words))
            base[known] = np.log10(occurs[i[known]] + 0.5)
            rare = known & ~own
            inside[rare] = x.log_in_class(occurs[i[rare]], cls[rare] - 1 - x.frequent)
            lens, n = np.diff(at), batch.num_rows
            seq = np.zeros(len(codes) + n, np.uint16)        # each text's classes, then the end
            owner = np.repeat(np.arange(n), lens)
            seq[np.arange(len(codes)) + owner] = cls[codes]
            offsets = np.concatenate([[0], np.cumsum(lens + 1)]).astype(np.int32) * 2
            # the words that the lexicon doesn't count, once a text
            open_ = np.flatnonzero(~known[codes])
            pairs, times = np.unique((owner[open_].astype(np.int64) << 32) | codes[open_], return_counts=True)
            cuts = pa.array(np.searchsorted(pairs, np.arange(n + 1, dtype=np.int64) << 32).astype(np.int32))
            rest = pa.array(words, pa.binary()).take(pa.array(pairs & 0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("part"), batch.column("doc_id"), batch.column("train"), pa.array(lens + 1),
                 pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(seq)]),
                 pa.array(_per_text(known[codes].astype(np.int64), at)), pa.array(_per_text(base[codes], at)), pa.array(_per_text(inside[codes], at)),
                 pa.ListArray.from_arrays(cuts, rest), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int64)))],
                ["key", "part", "doc_id", "train", "n_tokens", "seq", "known", "base", "emitted", "rest", "times"])

    return source.mapInArrow(run, "key long, part int, doc_id long, train boolean, n_tokens long, seq binary, known long, base double, "
                                  "emitted double, rest array<binary>, times array<long>")


def rest_sums(encoded: DataFrame, counts: DataFrame, lexicon: Lexicon, p: HmmParams) -> DataFrame:
    """(key, known, base, emitted) over the words the lexicon doesn't count,
    from their counts by a join on the word."""
    words = encoded.select("key", F.explode(F.arrays_zip("rest", "times")).alias("w")).select("key", "w.rest", "w.times")
    spark = encoded.sparkSession
    rare = spark.createDataFrame([(i, float(lexicon.rare_total[i] + 0.5 * (lexicon.rare_kinds[i] + 1))) for i in range(p.rare_classes)], "k int, room double")
    cls = F.pmod(F.crc32(F.expr("substring(word, greatest(octet_length(word) - 2, 1), 3)")), F.lit(p.rare_classes)).cast("int")
    # the same word in many texts (only words beyond max_word_bytes can be frequent here) is counted by a skew join
    found = words.join(counts.select(F.col("word"), "c"), words["rest"] == F.col("word"), "left") \
        .select("key", "times", F.coalesce("c", F.lit(0)).alias("c"), F.col("rest").alias("word"))
    found = found.select("key", "times", "c", cls.alias("k")).join(F.broadcast(rare), "k")
    c = F.col("c") + 0.5
    return found.groupBy("key").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known2"),
                                    F.sum(F.col("times") * F.log10(c)).alias("base2"),
                                    F.sum(F.col("times") * F.log10(c / F.col("room"))).alias("emitted2"))


@dataclass
class Hmm:
    start: np.ndarray                     # (states,)
    move: np.ndarray                      # (states, states)
    emit: np.ndarray                      # (classes, states): P(class | state)


@dataclass
class Expected:
    """Expected counts."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log: float = 0.0
    rows: int = field(default=0)

    @classmethod
    def zero(cls, k: int, classes: int) -> Expected:
        return cls(np.zeros(k), np.zeros((k, k)), np.zeros((classes, k)))


def new_hmm(common: np.ndarray, p: HmmParams, seed: int = 11) -> Hmm:
    """States that like to stay, emissions near the overall frequencies."""
    rng = np.random.default_rng(seed)
    k = p.states
    move = np.full((k, k), 0.1 / max(1, k - 1))
    np.fill_diagonal(move, 0.9)
    if k == 1:
        move[:] = 1.0
    emit = common[:, None] * rng.gamma(1.0, 1.0, (len(common), k)) + 1e-12
    return Hmm(np.full(k, 1 / k), move, emit / emit.sum(axis=0))


def normalised(e: Expected, common: np.ndarray, p: HmmParams) -> Hmm:
    """Parameters from expected counts, smoothed towards the overall class
    frequencies so that no class is impossible."""
    start = e.start + p.smoothing
    move = e.move + p.smoothing
    total = e.emit.sum(axis=0)
    weight = p.smoothing * len(common) * 0.1
    emit = (e.emit + weight * common[:, None]) / (total + weight)
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit)


def _together(seqs: list[np.ndarray], words: int) -> Iterator[list[int]]:
    """Numbers of the sequences to advance together, longest first."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    part: list[int] = []
    held = 0
    for i in order:
        if part and held + len(seqs[i]) > words:
            yield part
            part, held = [], 0
        part.append(i)
        held += len(seqs[i])
    if part:
        yield part


def _by_step(seqs: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """Symbols of sequences (longest first) ordered by step, and where each
    step begins: step t holds the sequences longer than t."""
    if len(seqs) == 1:
        return seqs[0].astype(np.int64), list(range(len(seqs[0]) + 1))
    lens = np.array([len(s) for s in seqs])
    alive = np.searchsorted(-lens, -np.arange(int(lens[0])), side="left")  # sequences with len > t
    begins = np.concatenate([[0], np.cumsum(alive)])
    step = np.concatenate([np.arange(n) for n in lens])
    owner = np.repeat(np.arange(len(lens)), lens)
    out = np.empty(int(lens.sum()), np.int64)
    out[begins[step] + owner] = np.concatenate(seqs)
    return out, begins.tolist()


class Room:
    """Work arrays of a task, used again from batch to batch."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def of(self, name: str, size: int) -> np.ndarray:
        if len(self.held.get(name, ())) < size:
            self.held[name] = np.empty(size)
        return self.held[name][:size]


def _segments(begins: list[int], words: int) -> list[tuple[int, int]]:
    """Runs of steps of at most ``words`` symbols (a wider step alone)."""
    cuts = [0]
    for t in range(1, len(begins) - 1):
        if begins[t + 1] - begins[cuts[-1]] > words:
            cuts.append(t)
    return list(zip(cuts, cuts[1:] + [len(begins) - 1]))


def forward(m: Hmm, seqs: list[np.ndarray], room: Room | None = None) -> np.ndarray:
    """log10 likelihood of each class sequence (longest first, none empty):
    the forward recursion, scaled to 1 at every ``SCALE_STEPS``-th step; the
    logarithms of the scales and of the last sum add up to the exact likelihood."""
    room = room or Room()
    symbols, begins = _by_step(seqs)
    k, most = len(m.start), len(seqs)
    emit, ahead = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
    states = room.of("even", k * most), room.of("odd", k * most)
    total = np.zeros(most)
    before = None
    for first, last in _segments(begins, 1 << 17):
        zero = begins[first]
        size = begins[last] - zero
        emitted = emit.take(symbols[zero:begins[last]], axis=1, out=room.of("emitted", k * size).reshape(k, size), mode="clip")
        for t in range(first, last):
            i, j = begins[t] - zero, begins[t + 1] - zero
            n = j - i
            a = states[t % 2][:k * n].reshape(k, n)
            if t:
                np.matmul(ahead, before[:, :n], out=a)
                a *= emitted[:, i:j]
            else:
                np.multiply(m.start[:, None], emitted[:, i:j], out=a)
            if t % SCALE_STEPS == SCALE_STEPS - 1:
                scale = a.sum(axis=0)
                a /= scale
                total[:n] += np.log(scale)
            lasting = begins[t + 2] - begins[t + 1] if t + 2 < len(begins) else 0
            if lasting < n:
                total[lasting:n] += np.log(a[:, lasting:].sum(axis=0))
            before = a
    return total / np.log(10)


def expect(m: Hmm, seqs: list[np.ndarray], into: Expected, room: Room | None = None, segment: int = SEGMENT_WORDS) -> None:
    """Add the expected counts of the sequences (longest first, none empty).

    Forward states are scaled to 1 at every ``SCALE_STEPS``-th step, and the
    emissions of that step by the same.  The recursions hold the states of
    about ``segment`` symbols: of longer input the forward states before each
    segment are kept and the others computed again on the way back."""
    room = room or Room()
    symbols, begins = _by_step(seqs)
    k, most, classes = len(m.start), len(seqs), len(into.emit)
    segments = _segments(begins, segment)
    size = max(begins[last] - begins[first] for first, last in segments)
    emit, ahead = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
    cap = max(2 * most, min(size, 1 << 17))
    held, scales = room.of("beta", k * cap).reshape(k, cap), room.of("scale", size)
    emitted, moves, log = np.zeros((k, classes)), np.zeros((k, k)), 0.0

    def onwards(first: int, last: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float]:
        """Forward states and emissions of the steps, a row per state, and the
        sum of the scales' logarithms."""
        zero, size, at = begins[first], begins[last] - begins[first], 0
        alpha = room.of("alpha", k * size).reshape(k, size)
        e = emit.take(symbols[zero:begins[last]], axis=1, out=room.of("emitted", k * size).reshape(k, size), mode="clip")
        for t in range(first, last):
            i, j = begins[t] - zero, begins[t + 1] - zero
            a = alpha[:, i:j]
            if t:
                np.matmul(ahead, before[:, :j - i], out=a)
                a *= e[:, i:j]
            else:
                np.multiply(m.start[:, None], e[:, i:j], out=a)
            if t % SCALE_STEPS == SCALE_STEPS - 1:
                s = scales[at:at + j - i]
                np.add.reduce(a, axis=0, out=s)
                a /= s
                e[:, i:j] /= s
                at += j - i
            before = a
        return alpha, e, float(np.log(scales[:at]).sum())

    entering: list[np.ndarray | None] = [None]     # the states before each segment
    for first, last in segments:
        alpha, e, logs = onwards(first, last, entering[-1])
        log += logs
        entering.append(alpha[:, begins[last - 1] - begins[last]:].copy())

    width, coming = 0, np.zeros((k, 0))            # sequences that go on after a segment, and what follows for them
    for number in range(len(segments) - 1, -1, -1):
        first, last = segments[number]
        if number < len(segments) - 1:
            alpha, e, _ = onwards(first, last, entering[number])
        zero, high = begins[first], begins[last] - begins[first]
        # backward states of symbols up to ``high``, filled from the end of ``held``
        held[:, cap - (high + zero - begins[last - 1]):][:, :width] = coming

        def flush(low: int, high: int) -> None:
            gamma = held[:, cap - (high - low):]
            gamma *= alpha[:, low:high]
            for s in range(k):
                emitted[s] += np.bincount(symbols[zero + low:zero + high], gamma[s], minlength=classes)

        for t in range(last - 1, first - 1, -1):
            i, j = begins[t] - zero, begins[t + 1] - zero
            n, at = j - i, cap - (high - i)
            if n > width:                          # the sequences that end here
                ends = alpha[:, i + width:j].sum(axis=0)
                log += float(np.log(ends).sum())
                held[:, at + width:at + n] = 1 / ends
                width = n
            e[:, i:j] *= held[:, at:at + n]
            if t > first:
                h = begins[t - 1] - zero
                if high - h > cap:
                    flush(i, high)
                    high = i
                to = cap - (high - h)
                np.matmul(m.move, e[:, i:j], out=held[:, to:to + n])
            elif t:
                coming = m.move @ e[:, i:j]
                moves += entering[number][:, :n] @ e[:, i:j].T
        flush(0, high)
        if first == 0:
            into.start += held[:, cap - high:][:, :most].sum(axis=1)
        # the moves of steps whose predecessors are equally wide lie side by side
        t = first + 1
        while t < last:
            until, back = t + 1, begins[t] - begins[t - 1]
            while until < last and begins[until] - begins[until - 1] == back:
                until += 1
            i, j = begins[t] - zero, begins[until] - zero
            moves += alpha[:, i - back:j - back] @ e[:, i:j].T
            t = until
    into.log += log / float(np.log(10))
    into.move += moves * m.move
    into.emit += emitted.T
    into.rows += len(seqs)


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def baum_welch(encoded: DataFrame, m: Hmm, p: HmmParams, refresh: Callable[[int, Expected], Hmm] | None = None) -> Expected:
    """Expected counts over all training rows, part by part.  Without
    ``refresh`` all are under ``m``; with it, each part's counts go to
    ``refresh(part, counts)``, whose model the next part uses."""
    total = Expected.zero(len(m.start), len(m.emit))
    for part in range(p.parts):
        e = expected_counts(encoded.where(F.col("part") == part), m)
        total = Expected(total.start + e.start, total.move + e.move, total.emit + e.emit, total.log + e.log)
        if refresh:
            m = refresh(part, e)
    return total


def expected_counts(encoded: DataFrame, m: Hmm) -> Expected:
    """Expected counts over the training rows: a partial table per task, one
    row for each class it met, summed by class (classes below 0: the start,
    the moves and the log likelihood under ``m``)."""
    sent = encoded.sparkSession.sparkContext.broadcast(m)
    classes, k = m.emit.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, room = Expected.zero(k, classes), Room()
        for batch in chunks(batches, "seq", 16 * BATCH_WORDS):   # so that the few long texts of many advance together
            seqs = _sequences(batch.column("seq"))
            for part in _together(seqs, BATCH_WORDS):
                expect(sent.value, [seqs[i] for i in part], e, room)
        if e.rows:
            met = np.flatnonzero(e.emit.any(axis=1))
            cls = np.concatenate([[-1], -2 - np.arange(k + 1), met])
            values = np.vstack([e.start[None, :], e.move, np.full((1, k), e.log), e.emit[met]])
            yield pa.RecordBatch.from_arrays([pa.array(cls.astype(np.int32))] + [pa.array(values[:, s]) for s in range(k)],
                                             ["cls"] + [f"s{s}" for s in range(k)])

    names = [f"s{s}" for s in range(k)]
    # a few splits a task, down to one task a core: fewer partial tables, and the long texts of a task advance together
    source = encoded.where("train").select("seq")
    tasks = max(source.sparkSession.sparkContext.defaultParallelism, source.rdd.getNumPartitions() // 8)
    rows = source.coalesce(tasks).mapInArrow(run, "cls int, " + ", ".join(f"{n} double" for n in names)) \
        .groupBy("cls").agg(*[F.sum(n).alias(n) for n in names]).collect()
    sent.unpersist()
    e = Expected.zero(k, classes)
    for r in rows:
        v = np.array(r[1:])
        if r.cls == -1:
            e.start = v
        elif r.cls == -2 - k:
            e.log = v[0]
        elif r.cls < -1:
            e.move[-2 - r.cls] = v
        else:
            e.emit[r.cls] = v
    return e


def train(encoded: DataFrame, lexicon: Lexicon, p: HmmParams) -> Hmm:
    """Incremental Baum-Welch over all training rows from states that differ
    at random: every part's counts replace those of the pass before, and the
    model follows after each part.  A pass that gains less than ``settled`` of
    the log likelihood ends it.  The driver holds ``parts`` tables of fixed
    size."""
    classes = lexicon.classes(p)
    common = np.full(classes, 0.5)
    common[0] += lexicon.ends
    for w, i in lexicon.number.items():
        common[i] += lexicon.count[w]
    common[1 + lexicon.frequent:] += lexicon.rare_total
    common /= common.sum()
    m = new_hmm(common, p)
    total = encoded.where("train").count()
    before = -np.inf
    held: dict[int, Expected] = {}

    def refresh(part: int, e: Expected) -> Hmm:
        nonlocal m
        held[part] = e
        scale = p.parts / len(held)     # in the first pass the parts to come are taken to be like those seen
        m = normalised(Expected(*(scale * sum(getattr(x, c) for x in held.values()) for c in ("start", "move", "emit"))), common, p)
        return m

    for _ in range(p.rounds if total else 0):
        e = baum_welch(encoded, m, p, refresh)
        if e.log - before <= p.settled * abs(e.log):
            break
        before = e.log
    return m


def likelihoods(encoded: DataFrame, m: Hmm, p: HmmParams) -> DataFrame:
    """(key, hmm): log10 likelihood of each row's class sequence."""
    sent = encoded.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = Room()
        for batch in chunks(batches, "seq", 4 * BATCH_WORDS):
            seqs = _sequences(batch.column("seq"))
            out = np.zeros(len(seqs))
            for part in _together(seqs, BATCH_WORDS):
                out[part] = forward(sent.value, [seqs[i] for i in part], room)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "doc_id", "train", "n_tokens", "known", "base", "emitted")]
                                             + [pa.array(out)], ["key", "doc_id", "train", "n_tokens", "known", "base", "emitted", "hmm"])

    return encoded.select("key", "doc_id", "train", "n_tokens", "seq", "known", "base", "emitted").mapInArrow(
        run, "key long, doc_id long, train boolean, n_tokens long, known long, base double, emitted double, hmm double")


def score(docs: DataFrame, train_rows, p: HmmParams = HmmParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    for every row; ``train_rows`` is a condition on the columns of ``docs``.

    Null texts are empty: one token, the end.  Without training rows nothing
    is known; base_score then is that of a vocabulary of one unknown word.
    Repeated rows are counted as often as they occur and score equally; words
    of equal count take their classes in byte order; an empty table gives an
    empty result; other columns are ignored.  Very long texts are scored and
    learned from whole; training holds the states of ``SEGMENT_WORDS`` words
    of them at once.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(train_rows, F.lit(False)).alias("train"))
    counts = materialise(word_counts(docs.where("train")), "hmm-counts")
    ends = docs.where("train").count()
    lexicon = fit_lexicon(counts, ends, p)
    # texts of like length side by side, so that those that advance together end together
    spark, path = docs.sparkSession, workspace(docs.sparkSession, "hmm-encoded")
    encoded = encode(docs, lexicon, p)
    encoded.sortWithinPartitions("part", F.desc("n_tokens")).write.partitionBy("part").parquet(path)
    encoded = spark.read.schema(encoded.schema).parquet(path)
    m = train(encoded, lexicon, p)
    scored = likelihoods(encoded, m, p).join(rest_sums(encoded, counts, lexicon, p), "key", "left")
    end = float(np.log10(lexicon.ends + 0.5))
    room = float(np.log10(lexicon.tokens + 0.5 * (lexicon.kinds + 1)))
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("known2", F.lit(0)) + F.lit(int(lexicon.ends > 0))).cast("long").alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(room)).alias("base_score"),
        (F.col("hmm") + F.col("emitted") + F.coalesce("emitted2", F.lit(0.0))).alias("score"))


def op6_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, id_remainder("doc_id", 5) != 1)
