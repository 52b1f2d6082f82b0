"""Language identification with character language models (operator 5).

For every language an interpolated Kneser-Ney model over characters (order
4): the highest order keeps n-gram counts, lower orders count distinct left
neighbours, each order gives the discounted mass to the next lower one.

Storage: the 64-bit hashes of all n-grams that any language has seen, sorted,
one array per order, with a column of interpolated log probabilities for each
language (a language that has not seen the n-gram gets its backed-off value);
likewise the back-off weights of the contexts.  So the usual lookup is one
binary search for all languages.

A text's language is the one with the lowest cross-entropy per character.  A
text whose best cross-entropy exceeds what the language's own training texts
show (a high quantile of a calibration part) is flagged as not accepted.

The models are fitted on a bounded sample of labelled rows
(``max_chars_per_lang``); every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.llm.common import _fmix, chunks, free_name, hash_unit, id_remainder, materialise, table

ORDER = 4
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageIdParams:
    """Production parameters: bounds of the training sample (chosen by id hash) and
    the calibration quantile."""

    max_langs: int = 1024
    max_docs_per_lang: int = 1500
    max_chars_per_lang: int = 3_000_000
    calibration_share: int = 5  # one document in so many calibrates
    quantile: float = 0.999
    margin: float = 0.25


_fold: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Code point -> its lower case if it is a letter, else 32 (space)."""
    global _fold
    if _fold is None:
        out = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _fold = out
    return _fold


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, letters lower-cased, every run of others one
    space, a space before and after each text; and where each text begins."""
    lens = np.array([len(t) for t in texts], dtype=np.int64) + 2
    joined = " " + "  ".join(texts) + " " if texts else ""
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _fold_table()[raw]
    begins = np.concatenate([[0], np.cumsum(lens)])
    space = codes == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[begins[:-1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[begins]
    return codes[keep], at


def ngram_hashes(codes: np.ndarray, n: int, place: np.ndarray) -> np.ndarray:
    """Hash of the n characters that end at each position; ``place`` is the
    position within its text.  What is before a text's begin counts as spaces,
    so a value depends on its own text alone."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for k in range(n - 1, -1, -1):
        h = h * np.uint64(0x100000001B3) + np.roll(codes, k).astype(np.uint64) + np.uint64(1)
    h = _fmix(h + np.uint64(n))
    early = np.flatnonzero(place < n - 1)
    h[early] = _at(codes, early, n, place[early])
    return h


def _at(codes: np.ndarray, ends: np.ndarray, n: int, place: np.ndarray) -> np.ndarray:
    """``ngram_hashes`` of chosen positions only."""
    h = np.zeros(len(ends), dtype=np.uint64)
    for k in range(n - 1, -1, -1):
        c = np.where(place >= k, codes[(ends - k) % len(codes)], 32)
        h = h * np.uint64(0x100000001B3) + c.astype(np.uint64) + np.uint64(1)
    return _fmix(h + np.uint64(n))


def _places(at: np.ndarray) -> np.ndarray:
    return np.arange(int(at[-1])) - np.repeat(at[:-1], np.diff(at))


@dataclass
class CharModel:
    """One language: n-grams seen, per order, with interpolated probabilities."""

    grams: list[np.ndarray] = field(default_factory=list)      # sorted hashes, order 1..ORDER
    probs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)   # sorted hashes, length 1..ORDER-1
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: float = 1e-6                                          # probability of a character never seen


def fit_char_model(codes: np.ndarray, at: np.ndarray) -> CharModel:
    """Interpolated Kneser-Ney from the characters of one language's texts."""
    place = _places(at)
    hashes = [ngram_hashes(codes, k, place) for k in range(1, ORDER + 1)]
    ok = place >= 1  # the space before a text is context only
    m = CharModel()
    for k in range(1, ORDER + 1):
        if k == ORDER:
            own, ctx, low = hashes[k - 1][ok], np.roll(hashes[k - 2], 1)[ok], hashes[k - 2][ok]
        else:  # distinct left neighbours: one occurrence of each longer n-gram
            longer = np.unique(hashes[k][ok], return_index=True)[1]
            own = hashes[k - 1][ok][longer]
            ctx = np.roll(hashes[k - 2], 1)[ok][longer] if k > 1 else np.zeros(len(own), np.uint64)
            low = hashes[k - 2][ok][longer] if k > 1 else own
        grams, first, inverse = np.unique(own, return_index=True, return_inverse=True)
        c = np.bincount(inverse, minlength=len(grams)).astype(np.float64)
        contexts, of = np.unique(ctx[first], return_inverse=True)
        total, kinds = np.bincount(of, c, len(contexts)), np.bincount(of, minlength=len(contexts))
        n1, n2 = max(1, int((c == 1).sum())), max(1, int((c == 2).sum()))
        discount = n1 / (n1 + 2.0 * n2)
        weight = discount * kinds / np.maximum(total, 1e-12)
        if k == 1:
            size = len(grams) + 1.0  # one more for the characters never seen
            lower = np.full(len(grams), 1.0 / size)
            m.floor = float(weight[0] / size) if len(grams) else 1e-6
        else:
            j = np.searchsorted(m.grams[k - 2], low[first])
            j = np.minimum(j, len(m.grams[k - 2]) - 1)
            hit = m.grams[k - 2][j] == low[first]
            lower = np.where(hit, m.probs[k - 2][j], m.floor)
            m.contexts.append(contexts)
            m.backoff.append(weight)
        m.grams.append(grams)
        m.probs.append(np.maximum(c - discount, 0) / total[of] + weight[of] * lower if len(grams) else np.zeros(0))
    return m


def _find(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
    j = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return j, keys[j] == sought


@dataclass
class LanguageModels:
    """All languages merged: per order sorted n-gram hashes with a matrix of
    log probabilities, per context length sorted hashes with log weights."""

    langs: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    logw: list[np.ndarray]
    floor: np.ndarray
    limits: np.ndarray          # highest accepted cross-entropy per language
    sharpness: float = 20.0     # of the score, calibrated

    def char_logp(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(characters, languages): log probability of each character given
        the three before it in its text."""
        if not len(codes):
            return np.zeros((0, len(self.langs)), np.float32)
        j, hit = _find(self.grams[-1], ngram_hashes(codes, ORDER, place))
        out = self.logp[-1][j] if len(self.grams[-1]) else np.zeros((len(codes), len(self.langs)), np.float32)
        todo = np.flatnonzero(~hit)
        carried = np.zeros((len(todo), len(self.langs)), np.float32)
        for k in range(ORDER - 1, 0, -1):  # back off for the few that no language has seen
            if not len(todo):
                break
            ctx = _at(codes, todo - 1, k, place[todo] - 1)
            i, known = _find(self.contexts[k - 1], ctx)
            if len(self.contexts[k - 1]):
                carried += np.where(known[:, None], self.logw[k - 1][i], 0.0)
            i, hit = _find(self.grams[k - 1], _at(codes, todo, k, place[todo]))
            if len(self.grams[k - 1]):
                out[todo[hit]] = carried[hit] + self.logp[k - 1][i[hit]]
            todo, carried = todo[~hit], carried[~hit]
        if len(todo):
            out[todo] = carried + self.floor
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) mean negative log probability per character,
        natural units, and the letters of each text."""
        codes, at = folded(texts)
        place = _places(at)
        logp = self.char_logp(codes, place)
        logp[place == 0] = 0.0  # the space before the text
        n = np.diff(at)
        sums = np.add.reduceat(logp, at[:-1], axis=0, dtype=np.float64) if len(n) else np.zeros((0, len(self.langs)))
        letters = np.add.reduceat(codes != 32, at[:-1], dtype=np.int64) if len(n) else np.zeros(0, np.int64)
        return -sums / np.maximum(n - 1, 1)[:, None], letters


def merge_models(models: dict[str, CharModel]) -> LanguageModels:
    langs = sorted(models)
    floor = np.log(np.array([models[x].floor for x in langs]))
    grams, logp, contexts, logw = [], [], [], []
    for k in range(ORDER - 1):
        keys = np.unique(np.concatenate([models[x].contexts[k] for x in langs]))
        w = np.zeros((len(keys), len(langs)), np.float32)
        for i, x in enumerate(langs):
            w[np.searchsorted(keys, models[x].contexts[k]), i] = np.log(np.maximum(models[x].backoff[k], 1e-12))
        contexts.append(keys)
        logw.append(w)
    return LanguageModels(langs, [m for m in grams], logp, contexts, logw, floor, np.full(len(langs), np.inf))


def fit_language_models(samples: dict[str, list[str]], p: LanguageIdParams = LanguageIdParams()) -> LanguageModels:
    """Models of the languages in ``samples`` (language -> whole texts).  One
    text in ``calibration_share`` is held back to calibrate acceptance and the
    score, unless a language has too few."""
    fit, calib, chars = {}, [], {}
    for lang, texts in samples.items():
        held = [t for i, t in enumerate(texts) if i % p.calibration_share == p.calibration_share - 1]
        own = [t for i, t in enumerate(texts) if i % p.calibration_share != p.calibration_share - 1]
        chars[lang] = folded(own)
        fit[lang] = fit_char_model(*chars[lang])
        calib += [(lang, t) for t in held]
    models = merge_models(fit)
    _fill(models, fit, chars)
    if calib:
        ce, letters = models.cross_entropy([t for _, t in calib])
        own = np.array([models.langs.index(x) for x, _ in calib])
        good = letters > 0
        for i in range(len(models.langs)):
            mine = ce[good & (own == i), i]
            if len(mine):
                models.limits[i] = np.quantile(mine, p.quantile) + p.margin
        models.sharpness = max((1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0), key=lambda s: _fit_of(s, ce[good], own[good]))
    return models


def _fit_of(sharpness: float, ce: np.ndarray, own: np.ndarray) -> float:
    if not len(own):
        return 0.0
    s = -sharpness * (ce - ce.min(axis=1, keepdims=True))
    logp = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
    return float(logp[np.arange(len(own)), own].mean())


def _fill(models: LanguageModels, fit: dict[str, CharModel], chars: dict) -> None:
    """Rows for every n-gram that any language has seen, lowest order first.
    The characters of each n-gram are taken from one place where it occurs, so
    a language without it can be given its backed-off value."""
    langs = models.langs
    for k in range(1, ORDER + 1):
        keys, place, source = [], [], []
        for x in langs:
            codes, at = chars[x]
            places = _places(at)
            ok = np.flatnonzero(places >= 1)
            v, first = np.unique(ngram_hashes(codes, k, places)[ok], return_index=True)
            keys.append(v)
            place.append(ok[first])
            source.append(np.full(len(v), langs.index(x)))
        union, pick = np.unique(np.concatenate(keys), return_index=True)
        where, which = np.concatenate(place)[pick], np.concatenate(source)[pick]
        ctx, low = np.zeros(len(union), np.uint64), np.zeros(len(union), np.uint64)
        for i, x in enumerate(langs):
            mine = which == i
            if k > 1 and mine.any():
                inside = _places(chars[x][1])[where[mine]]
                ctx[mine] = _at(chars[x][0], where[mine] - 1, k - 1, inside - 1)
                low[mine] = _at(chars[x][0], where[mine], k - 1, inside)
        table_ = np.zeros((len(union), len(langs)), np.float32)
        for i, x in enumerate(langs):
            j, hit = _find(fit[x].grams[k - 1], union)
            if k == 1:
                backed = np.full(len(union), models.floor[i])
            else:
                c, known = _find(models.contexts[k - 2], ctx)
                w = np.where(known, models.logw[k - 2][c, i] if len(models.contexts[k - 2]) else 0.0, 0.0)
                l, seen = _find(models.grams[k - 2], low)
                backed = w + np.where(seen, models.logp[k - 2][l, i] if len(models.grams[k - 2]) else 0.0, models.floor[i])
            own = np.log(np.maximum(fit[x].probs[k - 1], 1e-12))
            table_[:, i] = np.where(hit, own[j] if len(own) else 0.0, backed)
        models.grams.append(union)
        models.logp.append(table_)


def train(docs: DataFrame, p: LanguageIdParams = LanguageIdParams(), lang_col: str = "lang") -> LanguageModels | None:
    """Fit on texts of rows with a language whose crc32(doc_id as text) mod 5
    is not 0: per language rows chosen by id hash, about as many as the bounds
    of ``p`` allow, in hash order.  Where the chosen rows have more characters
    than that, pieces of them are chosen by hash, so no text can be a
    language's whole sample.  More than ``max_langs`` languages are an error.
    None if there are none."""
    pool = docs.select(hash_unit("doc_id", "language").alias("u"), "doc_id", F.col("text").cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang")) \
        .where("lang IS NOT NULL AND text IS NOT NULL").where(id_remainder("doc_id", 5) != 0)
    counts = pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).limit(p.max_langs + 1).collect()
    if len(counts) > p.max_langs:
        raise ValueError(f"more than {p.max_langs} languages")
    if not counts:
        return None
    # about the bounds of each language, by hash: documents, then pieces of them where these are too long
    docs_share = {r["lang"]: min(1.0, p.max_docs_per_lang / r["n"]) for r in counts}
    piece_share = {r["lang"]: min(1.0, p.max_chars_per_lang / max(1.0, r["chars"] * docs_share[r["lang"]])) for r in counts}
    rows = [(k, docs_share[k], piece_share[k]) for k in docs_share]
    shares = docs.sparkSession.createDataFrame(rows, "lang string, docs_share double, piece_share double")
    chosen = pool.join(F.broadcast(shares), "lang").where("u < docs_share").select("lang", "u", "piece_share", "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out = []
            for lang, u, share, text in zip(*(batch.column(k).to_pylist() for k in ("lang", "u", "piece_share", "text"))):
                if share >= 1.0:
                    out.append((lang, u, 0, text))
                    continue
                n = -(-len(text) // SAMPLE_PIECE)
                kept = np.flatnonzero(np.random.default_rng(int(u * (1 << 40))).random(n) < share)
                out += [(lang, u, int(k), text[k * SAMPLE_PIECE:(k + 1) * SAMPLE_PIECE]) for k in kept]
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.int64(), pa.string()))],
                                             ["lang", "u", "piece", "text"])

    sample = materialise(chosen.mapInArrow(pieces, "lang string, u double, piece long, text string"), "language-sample")
    samples: dict[str, list[str]] = {}
    for row in sample.orderBy("lang", "u", "piece", "text").toLocalIterator():
        samples.setdefault(row.lang, []).append(row.text)
    return fit_language_models(samples, p) if samples else None


def identify(docs: DataFrame, models: LanguageModels | None, text_col: str = "text") -> DataFrame:
    """``docs`` plus lang_pred, score (0..1) and accepted.

    ``und`` with score 0 for null texts, texts without a letter, and if no
    language was learned.  Ties go to the first language in alphabetical
    order.  The score is the language's share of the likelihoods per
    character, sharpened as calibrated.  Texts of any length are scored whole;
    equal texts score equally.  Input columns with these names are replaced.
    """
    from pyspark.sql import types as T
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(models)
    out = ["lang_pred", "score", "accepted"]
    kept = [c for c in docs.columns if c not in out]
    hidden = free_name("_lid_text", [*docs.columns, *out])
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias(hidden))
    schema = T.StructType(source.schema.fields[:-1] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                                                       T.StructField("accepted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in chunks(batches, hidden):
            texts = [t or "" for t in batch.column(hidden).to_pylist()]
            if m is None:
                pred, score, ok = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            else:
                ce, letters = _scores(m, texts)
                best = ce.argmin(axis=1)
                least = ce[np.arange(len(ce)), best]
                score = 1.0 / np.exp(-m.sharpness * (ce - least[:, None])).sum(axis=1)
                some = letters > 0
                pred = [m.langs[b] if s else UNDETERMINED for b, s in zip(best, some)]
                score, ok = np.where(some, score, 0.0), some & (least <= m.limits[best])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)]
                                             + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], kept + out)

    return source.mapInArrow(run, schema)


#: Characters of a piece where texts are sampled in pieces.
SAMPLE_PIECE = 2000
#: Characters scored in one step; a longer text is scored in pieces that overlap by the context.
PIECE = 1 << 19


def _scores(m: LanguageModels, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    if len(texts) > 1 or len(texts[0]) <= PIECE:
        return m.cross_entropy(texts)
    codes, _ = folded(texts)
    total = np.zeros(len(m.langs))
    for i in range(0, len(codes), PIECE):
        begin = max(0, i - ORDER)
        logp = m.char_logp(codes[begin:i + PIECE], np.arange(begin, min(i + PIECE, len(codes))))[i - begin:]
        total += logp[1 if i == 0 else 0:].sum(axis=0, dtype=np.float64)
    return -total[None, :] / max(len(codes) - 1, 1), np.array([int((codes != 32).sum())])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = train(docs)
    return identify(docs.select("doc_id", "text"), models).select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "accepted")
