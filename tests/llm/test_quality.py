"""Quality rules against a plain Python definition."""

import re
from collections import Counter

from docs_fixture import documents, frame

from rainfold.llm import quality as q


def _measures(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    win = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(win).items() if n > 1}
    covered = {i + k for i, w in enumerate(win) if w in often for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_base_measures(spark):
    got = sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
                  for r in q.quality_rules(frame(spark)).collect()), key=repr)
    assert got == sorted(((d[0], _measures(d[1])) for d in documents()), key=repr)


def test_verdicts_and_native_plan(spark):
    clean = "the cat and the dog went to a small house in the green hills and that was good for all of them " * 1
    rows = [(1, clean + " ".join(f"word{i}" for i in range(60))), (2, "### " * 80), (3, "same the of line here\n" * 30),
            (4, " ".join(f"qx{i}" for i in range(80))), (5, None), (6, "")]
    df = q.quality_rules(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    got = {r.doc_id: r for r in df.collect()}
    assert got[1].kept and not got[1].broken_rules
    assert not any(got[k].kept for k in (2, 3, 4, 5, 6))
    assert "stop_words" in got[4].broken_rules and "symbol_ratio" in got[2].broken_rules
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_rows_as_given(spark):
    df = frame(spark)
    kept = q.keep_good(df)
    assert kept.columns == df.columns
    assert q.keep_good(frame(spark, [])).count() == 0
    rules = (q.Rule("few_words", "n_words", 60, None),)
    assert {r.doc_id for r in q.keep_good(df, rules=rules).collect()} >= {0, 1}
