"""Mixing to target weights by soft membership (operator 8).

1. A multinomial classifier over hashed words, fitted on a bounded sample of
   a labelled table, predicts for every document the posteriors of the
   domains.  (A document need not belong to one domain; the recorded label is
   not used for the prediction.)
2. Nonnegative document rates r minimise

       1/2 sum_d (S_d(r) - target_d)^2 / S_d(1)  +  ridge/2 sum_i q_i (r_i - 1)^2

   where q_i is a document's share of all tokens, S_d(r) = sum_i q_i p_id r_i
   the expected share of domain d, and the ridge picks among all solutions the
   one closest to taking every document once.  Projected gradient in the
   q-weighted metric: a step is r <- max(0, r - step * (sum_d e_d p_id + ridge
   (r - 1))) with e_d = (S_d - target_d) / S_d(1).  A domain without a target
   keeps the tokens it has: it counts only by what it would lose, e_d =
   min(0, S_d - S_d(1)) / S_d(1).  A step depends on the other
   documents through the few numbers e_d only, so an iteration is one
   aggregation; the list of e's is the whole state and tasks replay it from
   the posteriors.  Nothing is kept between iterations that could be lost.
3. A document is taken floor(r + u) times, u uniform from a hash of its id,
   so the expected number of copies is r.

Without a budget no document is dropped: rates are kept at 1 or more (max(1,
...) in the step) and the corpus grows with the rates until the targets are
the shares of its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.llm.common import batch_word_hashes, chunks, hash_unit, materialise, raw_texts, table


@dataclass(frozen=True)
class MixParams:
    """Production parameters."""

    bits: int = 18
    max_train_docs: int = 8_000     # bound of the labelled sample
    least_train_docs: int = 200     # of every domain, about
    max_train_words: int = 12_000_000
    smoothing: float = 0.1
    ridge: float = 1e-5
    rounds: int = 60
    tolerance: float = 1e-6         # of the relative change of the domain totals
    budget: float | None = None     # expected tokens of the domains with a target, times those they have


#: Target shares of expected tokens by domain (here: the language), used by the query and the pipeline.
TARGETS = {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13}


@dataclass(frozen=True)
class Classifier:
    """Log probability of each hashed word per domain, and the sharpness that
    turns mean log-likelihoods into posteriors."""

    domains: list[str]
    bits: int
    logp: np.ndarray       # (2**bits, domains), float32
    prior: np.ndarray
    sharpness: float

    def posteriors(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, domains) from word hashes; a wordless text has the prior."""
        n = np.diff(at)
        sums = np.zeros((len(n), len(self.domains)))
        some = np.flatnonzero(n)
        if len(some):
            rows = self.logp[(words & np.uint64((1 << self.bits) - 1)).astype(np.int64)]
            sums[some] = np.add.reduceat(rows, at[:-1][some], axis=0, dtype=np.float64)
        return _softmax(self.prior + self.sharpness * sums / np.sqrt(np.maximum(n, 1))[:, None])


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_classifier(examples: list[tuple[np.ndarray, str]], p: MixParams, documents: dict[str, int] | None = None) -> Classifier:
    """Multinomial naive Bayes; the sharpness is calibrated on every fifth
    example (likelihoods of long texts are far too sure of themselves).
    ``documents`` of each domain, where the examples are not in proportion."""
    domains = sorted({d for _, d in examples})
    size, k = 1 << p.bits, len(domains)
    counts, docs = np.zeros((size, k)), np.zeros(k)
    held = []
    for i, (words, domain) in enumerate(examples):
        if i % 5 == 4:
            held.append((words, domains.index(domain)))
            continue
        j = domains.index(domain)
        np.add.at(counts[:, j], words, 1.0)
        docs[j] += 1
    # smoothed towards the words of all domains
    common = counts.sum(axis=1, keepdims=True) + 0.01
    common /= common.sum()
    counts += p.smoothing * size * 0.05 * common
    logp = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    if documents:
        docs = np.array([float(documents[d]) for d in domains])
    prior = np.log((docs + 1) / (docs + 1).sum())
    best = Classifier(domains, p.bits, logp, prior, 1.0)
    if held:
        at = np.concatenate([[0], np.cumsum([len(w) for w, _ in held])])
        words = np.concatenate([w for w, _ in held]).astype(np.uint64)
        truth = np.array([d for _, d in held])

        def fit(s: float) -> float:
            post = Classifier(domains, p.bits, logp, prior, s).posteriors(words, at)
            return float(np.log(np.maximum(post[np.arange(len(truth)), truth], 1e-12)).mean())
        best = Classifier(domains, p.bits, logp, prior, max((0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 4.0), key=fit))
    return best


def train(labelled: DataFrame, p: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text",
          domain_col: str = "domain") -> Classifier | None:
    """Fit on about ``max_train_docs`` rows with a domain, chosen by id hash
    and read in its order; if they have more than ``max_train_words`` words,
    the share is lowered in proportion.  None if there are none.  Null texts
    count as empty."""
    bits = p.bits
    known = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"),
                            F.col(domain_col).cast("string").alias("domain")).where("domain IS NOT NULL")
    known = known.withColumn("u", hash_unit("id", "mixing"))
    # in proportion, but about ``least_train_docs`` of every domain (all if it has fewer)
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    share = p.max_train_docs / max(1, sum(counts.values()))
    shares = [(d, min(1.0, max(share, p.least_train_docs / n))) for d, n in counts.items()]
    if not shares:
        return None
    shares = labelled.sparkSession.createDataFrame(shares, "domain string, share double")
    sample = known.join(F.broadcast(shares), "domain").where("u < share").select("u", "share", "domain", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            (words,), at = batch_word_hashes(raw_texts(batch.column("text")))
            small = (words & np.uint64((1 << bits) - 1)).astype(np.int32)
            rows = [small[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("share"), batch.column("domain"), pa.array(rows, pa.binary())],
                                             ["u", "share", "domain", "words"])

    sample = materialise(sample.mapInArrow(run, "u double, share double, domain string, words binary"), "mixing-sample")
    held = sample.agg(F.sum(F.octet_length("words") / 4)).first()[0] or 0
    sample = sample.where(F.col("u") < F.col("share") * min(1.0, p.max_train_words / max(1, held)))
    examples = [(np.frombuffer(r.words, np.int32), r.domain) for r in sample.orderBy("u", "domain", "words").toLocalIterator()]
    return fit_classifier(examples, p, counts) if examples else None


def memberships(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id as given, key, n_tokens, post): the tokens (words between space and
    \\x09-\\x0D) and domain posteriors of every whole text.  ``key`` numbers
    the rows, so repeated and null ids stay apart."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"),
                         F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in chunks(batches):
            texts = raw_texts(batch.column("text"))
            (words,), at = batch_word_hashes(texts)
            post = m.posteriors(words, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), pa.array([len(t.split()) for t in texts], pa.int64()),
                 pa.array(list(post), pa.list_(pa.float64()))], ["key", "doc_id", "n_tokens", "post"])

    return source.mapInArrow(run, "key long, doc_id long, n_tokens long, post array<double>")


def replay(post: np.ndarray, errors: np.ndarray, ridge: float, floor: float = 0.0) -> np.ndarray:
    """Rates (``floor`` at least) after the projected-gradient steps whose
    domain errors are the rows of ``errors``, starting at 1."""
    r = np.ones(len(post))
    step = 1.0 / (1.0 + ridge)
    for e in errors:
        r = np.maximum(floor, r - step * (post @ e + ridge * (r - 1.0)))
    return r


def _posts(column: pa.Array, k: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, k)


def solve(members: DataFrame, domains: list[str], targets: dict[str, float], p: MixParams = MixParams(), floor: float = 0.0) -> np.ndarray:
    """The errors of all steps (steps, domains).  ``members`` is read once a
    step: each task replays the steps so far for its rows and returns one row
    of partial sums.

    Targets are shares, scaled to sum to 1 over the domains that occur, of
    the tokens of the domains that ``targets`` names; the others keep what
    they have.  They are shares of ``budget`` times the named domains' tokens;
    without a budget, of the least for which each of them can keep all it has.
    With a ``floor`` of 1 and no budget that is where the size starts:
    documents of several domains bring tokens of domains that need none, so
    at every step the size is the one that fits the domain totals best, and
    not below the start.  Shares that no rates of ``floor`` or more can give
    (say a target of 0) are met as nearly as they can."""
    k = len(domains)
    wanted = np.array([max(0.0, float(targets.get(d, 0.0))) for d in domains])
    named = np.array([d in targets for d in domains])
    if wanted.sum() <= 0:
        return np.zeros((0, k))
    spark = members.sparkSession
    errors, ridge = np.zeros((0, k)), p.ridge
    base = totals = None
    for _ in range(p.rounds + 1):
        sent = spark.sparkContext.broadcast(errors)

        def run(batches, sent=sent):
            sums = np.zeros(k)
            for batch in batches:
                post = _posts(batch.column("post"), k)
                n = batch.column("n_tokens").to_numpy().astype(np.float64)
                sums += (n * replay(post, sent.value, ridge, floor)) @ post
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(sums)], ["d", "s"])

        rows = members.select("n_tokens", "post").mapInArrow(run, "d int, s double").groupBy("d").agg(F.sum("s").alias("s")).collect()
        sent.unpersist()
        before, totals = totals, np.zeros(k)
        for row in rows:
            totals[row.d] = row.s
        if base is None:
            base = totals
            if base.sum() <= 0:
                return np.zeros((0, k))
            goal = np.where(base > 0, wanted, 0.0)
            if goal.sum() <= 0:
                return np.zeros((0, k))
            goal = goal / goal.sum()
            some = goal > 0
            share = goal
            size = least = p.budget * base[named].sum() if p.budget else float((base[some] / goal[some]).max())
        elif np.abs(totals - before).max() <= p.tolerance * base.sum():
            break
        if floor > 0 and not p.budget:
            size = max(least, float((totals[some] * share[some] / base[some]).sum() / (share[some] ** 2 / base[some]).sum()))
        off = np.where(named, totals - size * share, np.minimum(0.0, totals - base))
        errors = np.vstack([errors, np.where(base > 0, off / np.maximum(base, 1e-300), 0.0)])
    return errors[:p.rounds]


def with_rates(members: DataFrame, errors: np.ndarray, p: MixParams = MixParams(), floor: float = 0.0) -> DataFrame:
    """(key, doc_id, n_tokens, rate, copies, post)."""
    k, ridge = errors.shape[1], p.ridge
    sent = members.sparkSession.sparkContext.broadcast(errors)

    def run(batches):
        for batch in batches:
            rate = replay(_posts(batch.column("post"), k), sent.value, ridge, floor)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "doc_id", "n_tokens", "post")] + [pa.array(rate)],
                                             ["key", "doc_id", "n_tokens", "post", "rate"])

    rated = members.select("key", "doc_id", "n_tokens", "post").mapInArrow(run, "key long, doc_id long, n_tokens long, post array<double>, rate double")
    unit = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.col("key")), F.lit("copies")), F.lit(1 << 40)) / F.lit(1 << 40)
    rated = rated.withColumn("rate", F.round("rate", 5))  # the solver's accuracy
    return rated.withColumn("copies", F.floor(F.col("rate") + unit).cast("long"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], p: MixParams = MixParams()) -> tuple[DataFrame, list[str]]:
    """((key, doc_id, n_tokens, post, rate, copies), domains) for every row.

    Rows without words have the prior as posteriors and no weight in the
    totals; without labelled rows or without targets every rate is 1; without
    a budget no rate is below 1 and so no copies are 0.  Ties do
    not arise (a rate depends on the posteriors alone); repeated rows get
    equal rates and, having one id, equal copies; null ids are numbered by
    row.  An empty table gives an empty result; other columns are ignored.
    """
    model = train(labelled, p)
    if model is None:
        model = Classifier(["all"], 1, np.zeros((2, 1), np.float32), np.zeros(1), 1.0)
    members = materialise(memberships(docs, model), "mix-members")
    floor = 0.0 if p.budget else 1.0
    errors = solve(members, model.domains, targets, p, floor)
    return with_rates(members, errors, p, floor), model.domains


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated, domains = mix(docs.select("doc_id", "text"), docs.select("doc_id", "text", F.col("lang").alias("domain")), TARGETS)
    return rated.select("doc_id", "n_tokens", *[F.col("post")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate", "copies")


def repeat_rows(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], p: MixParams = MixParams()) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say, columns as
    given.  The copies are joined back by id: rows that repeat an id are each
    taken as often as its largest copies say, rows without an id once."""
    rated, _ = mix(docs, labelled, targets, p)
    copies = rated.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    name = "_copies"
    while name in docs.columns:
        name += "_"
    joined = docs.join(copies.select(F.col("doc_id").alias(name + "id"), F.col("copies").alias(name)),
                       docs["doc_id"] == F.col(name + "id"), "left")
    times = F.coalesce(F.col(name), F.lit(1)).cast("int")
    return joined.where(times > 0).withColumn(name + "n", F.explode(F.sequence(F.lit(1), times))) \
        .select(*[docs[c] for c in docs.columns])
