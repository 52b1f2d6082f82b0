"""Small documents with every awkward case, and rows from the given tables."""

import random

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score DOUBLE, kept STRING, fp BIGINT, _q INT"
rnd = random.Random(4)
VOCAB = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def documents():
    base = prose(120, 1)
    texts = [base, base, base.replace(" ", "  ", 3), base + " extra", "x " + base, prose(60, 2), prose(60, 3), None, "", " \t\n ",
             "one", "one two", "ONE two three", "a b c a b c a b c " + prose(50, 5), "same line\nsame line\n\nsame line\nother",
             "### $$$ ***", "é ü ß ñ 漢字 🙂 " + prose(40, 6), prose(30_000, 7), base.upper(), "the end.\nThe end.\nthe end. <|endoftext|> x"]
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 5 else None, None, 0.5, "k", 7, 1) for i, t in enumerate(texts)]
    rows.append(rows[5])                                    # a row repeated
    rows.append((None, base, "en", "src1", 1, None, None, None, None))   # no id
    rows.append((6, "another text of the same id " + prose(55, 8), "de", "src2", 1, None, None, None, None))
    return rows


def frame(spark, rows=None):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def components(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
