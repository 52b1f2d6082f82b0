"""Quality rules: one threshold table compiled into one projection (operator 2).

Everything is built-in Spark expressions: no user functions, no shuffle, no
explode.  Measures over a text's words and lines are higher-order functions
over arrays that never leave the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.llm.common import WORD_SEPARATORS, table

#: The most frequent function words of the four languages.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "that", "is", "was", "for", "with", "on", "are", "as", "be", "this", "from", "or", "an",
    "der", "die", "das", "und", "ist", "nicht", "mit", "von", "den", "ein", "eine", "zu", "auf", "für", "sich", "dem", "auch", "des",
    "le", "la", "les", "et", "des", "est", "une", "un", "que", "qui", "dans", "pour", "sur", "du", "pas", "de", "par", "avec",
    "el", "los", "las", "y", "en", "por", "con", "para", "una", "del", "su", "es", "al", "lo", "como", "no", "se",
)


@dataclass(frozen=True)
class Rule:
    """Keep a text only if ``low`` <= measure <= ``high`` (None: no bound)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Production thresholds.  Measures are columns of ``measures``.
RULES = (
    Rule("mean_word_length", "mean_word_length", 2.0, 15.0),
    Rule("symbol_ratio", "symbol_ratio", None, 0.10),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("stop_word_ratio", "stop_word_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.50),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.90),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.30),
    Rule("alphabetic_words", "alpha_word_ratio", 0.60, None),
)

_HAS_WORD = "[^\\x20\\x09-\\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, whatever the number of uses
    (also inside lambdas, where a plain reference would be computed again for
    every element)."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice.

    The windows are sorted with their positions; equal neighbours are repeats;
    the positions of the repeats, in order, cover ``min(3, gap)`` words each.
    """
    def covered(at: Column) -> Column:
        gaps = F.aggregate(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.struct(at[0].alias("prev"), F.lit(3).alias("n")),
                           lambda acc, x: F.struct(x.alias("prev"), (acc["n"] + F.least(x - acc["prev"], F.lit(3))).alias("n")),
                           lambda acc: acc["n"].cast("long"))
        return F.when(F.size(at) == 0, F.lit(0).cast("long")).otherwise(gaps)

    def repeats(windows: Column) -> Column:
        def positions(ranked: Column) -> Column:
            same = F.filter(ranked, lambda x, i: (x["w"] == F.get(ranked, i - 1)["w"]).eqNullSafe(F.lit(True))
                            | (x["w"] == F.get(ranked, i + 1)["w"]).eqNullSafe(F.lit(True)))
            return F.sort_array(F.transform(same, lambda x: x["i"]))
        ranked = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        counted = let(let(ranked, positions), covered)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(counted)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                          lambda i: F.concat_ws(" ", words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(windows, repeats))


def _word_measures(words: Column) -> Column:
    lowered = F.filter(words, lambda w: F.rtrim(F.lower(w), F.lit(",.")).isin(*dict.fromkeys(STOP_WORDS)))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size(lowered).cast("long").alias("n_stop_words"),
        F.size(F.filter(words, lambda w: w.rlike("\\p{L}"))).cast("long").alias("n_alpha_words"),
        _repeat_words(words).alias("n_repeat_words"),
    )


def _line_measures(lines: Column) -> Column:
    return F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: x.rlike("^[\\x20\\x09-\\x0D]*(?:[-*•‣]|[0-9]+[.)])[\\x20\\x09]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: x.rlike("(?:\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
    )


def measures(text: Column) -> Column:
    """All counts and ratios of a text as one struct."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, WORD_SEPARATORS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_HAS_WORD))
    counted = F.struct(
        let(words, _word_measures).alias("w"), let(lines, _line_measures).alias("l"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    def flat(c: Column) -> Column:
        w, n = c["w"], c["l"]
        return F.struct(
            *[w[k].alias(k) for k in ("n_words", "word_chars", "n_stop_words", "n_alpha_words", "n_repeat_words")],
            *[n[k].alias(k) for k in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")],
            c["n_symbols"].alias("n_symbols"),
            ratio(w["word_chars"], w["n_words"]).alias("mean_word_length"),
            ratio(c["n_symbols"], w["word_chars"]).alias("symbol_ratio"),
            ratio(w["n_stop_words"], w["n_words"]).alias("stop_word_ratio"),
            ratio(w["n_alpha_words"], w["n_words"]).alias("alpha_word_ratio"),
            ratio(n["n_dup_lines"], n["n_lines"]).alias("dup_line_ratio"),
            ratio(n["n_bullet_lines"], n["n_lines"]).alias("bullet_line_ratio"),
            ratio(n["n_ellipsis_lines"], n["n_lines"]).alias("ellipsis_line_ratio"))

    return let(counted, flat)


def compile_rules(q: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that the measures ``q`` break, in table order."""
    broken = []
    for r in rules:
        m = q[r.measure]
        outside = F.lit(False)
        if r.low is not None:
            outside = outside | (m < F.lit(r.low))
        if r.high is not None:
            outside = outside | (m > F.lit(r.high))
        broken.append(F.when(outside, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def passed(q: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    return ~base_failed(q) & (F.size(compile_rules(q, rules)) == 0)


def quality_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` plus n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, broken_rules (array) and kept.

    Null and empty texts have no words: base_failed, not kept.  Rows are
    judged one by one, so repeated rows get equal verdicts and an empty table
    stays empty.  Input columns with the same names as the results are
    replaced by the results.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    taken = {*names, "base_failed", "broken_rules", "kept"}
    name = "_q"
    while name in df.columns:
        name += "_"

    def verdict(q: Column) -> Column:
        broken = compile_rules(q, rules)
        return F.struct(*[q[n].alias(n) for n in names], base_failed(q).alias("base_failed"), broken.alias("broken_rules"),
                        passed(q, rules).alias("kept"))

    fields = [F.col(f"`{c}`") for c in df.columns if c not in taken]
    return df.select(*fields, let(measures(F.col(f"`{text_col}`")), verdict).alias(name)).select(*fields, f"{name}.*")


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, columns as given.

    The condition is one expression that names the measures once: a filter on
    columns of them would be pushed below their projection and compute them
    again for every use."""
    return docs.where(let(measures(F.col(f"`{text_col}`")), lambda q: passed(q, rules)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "kept")


def oracle() -> str:
    """The same verdict in DuckDB, written from the definitions: words and
    lines are unnested and windows grouped instead of sorted in place."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i
  FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
wc AS (
  SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars,
         count(*) FILTER (rtrim(lower(word), ',.') IN ({stop})) AS n_stop,
         count(*) FILTER (regexp_matches(word, '\p{{L}}')) AS n_alpha
  FROM w GROUP BY rid),
win AS (
  SELECT a.rid, a.i, a.word || ' ' || b.word || ' ' || c.word AS g
  FROM w a JOIN w b ON b.rid = a.rid AND b.i = a.i + 1 JOIN w c ON c.rid = a.rid AND c.i = a.i + 2),
rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT rid, count(DISTINCT p) AS n_repeat
  FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM rep) GROUP BY rid),
ln AS (
  SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lc AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup,
         count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*(?:[-*•‣]|[0-9]+[.)])[\x20\x09]')) AS n_bullet,
         count(*) FILTER (regexp_matches(line, '(?:\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_ellipsis
  FROM ln GROUP BY rid),
m AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
         coalesce(n_stop, 0) AS n_stop, coalesce(n_alpha, 0) AS n_alpha, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_bullet, 0) AS n_bullet, coalesce(n_ellipsis, 0) AS n_ellipsis
  FROM d LEFT JOIN wc USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN lc USING (rid)),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 15.0 * n_words
         AND n_symbols / word_chars <= 0.10 AND n_stop >= 2 AND n_stop / n_words >= 0.02
         AND n_dup_lines / n_lines <= 0.50 AND n_bullet / n_lines <= 0.90 AND n_ellipsis / n_lines <= 0.30
         AND n_alpha / n_words >= 0.60 AS kept
FROM v"""
