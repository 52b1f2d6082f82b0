"""Operator 12 against a plain dictionary of prefixes."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from rainfold.llm import prefix_trie as pt
from rainfold.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, key STRING, depth INT, path STRING"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, rebuild):
    conv = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    seq = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in seq}
        seq = {c: seq.get(c - c % 5, [])[:h[c]] + s[h[c]:] for c, s in seq.items()}
    members, children = defaultdict(list), defaultdict(set)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                children[tuple(s[:d - 1])].add(tuple(s[:d]))
    leaves, saved, out = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ended = ",".join(map(str, sorted(c for c in members[p] if len(seq[c]) == len(p))))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p],
                 saved[p], sha256(ended.encode()).hexdigest()))
    return out


def rows_of(nodes):
    rows = [tuple(r) for r in nodes.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def awkward():
    """Nulls everywhere, turnless rebuilds, copies, shared beginnings, one
    long conversation, negative ids, long and empty texts."""
    rows = []
    for c in range(60):
        for t in range(c % 7 + 1):
            text = "shared" if t < 3 and c % 3 else f"text {c % 4} {t} é漢"
            rows.append((c, t, "user" if t % 2 else "assistant", text, "k", 1, "p"))
    rows += [(200 + k, t, "user", f"copy {t}", "k", 1, "p") for k in range(40) for t in range(5)]
    rows += [(300, t, "user", f"long {t}", "k", 1, "p") for t in range(150)]
    rows += [(301, t, "user", f"long {min(t, 140)}", "k", 1, "p") for t in range(150)]
    rows += [(404, 0, None, None, None, None, None), (409, None, "user", "first", "k", 1, "p"), (409, 3, "user", "", "k", 1, "p"),
             (409, 1, None, "x" * 300_000, "k", 1, "p"), (None, 1, "user", "no id", "k", 1, "p"), (-3, 0, "user", "negative", "k", 1, "p")]
    return rows


@pytest.mark.parametrize("group", [1, 3, 256])
def test_awkward_rows(spark, group):
    """The same nodes whether nearly all, some or no depths are peeled above
    the floors."""
    rows = awkward()
    nodes = pt.trie(pt.turns_of(spark.createDataFrame(rows, SCHEMA)), group)
    assert rows_of(nodes) == brute(rows, False)


def test_rebuilt_beginnings(spark):
    rows = [r for r in awkward() if r[0] is None or r[0] >= 0]
    assert rows_of(pt.trie(pt.rebuilt(spark.createDataFrame(rows, SCHEMA)), 4)) == brute(rows, True)


def test_repeated_rows_are_turns(spark):
    rows = [(1, 0, "user", "a", None, None, None)] * 3
    nodes = rows_of(pt.trie(pt.turns_of(spark.createDataFrame(rows, SCHEMA))))
    assert {(d, n, kids) for _, d, _, n, kids, *_ in nodes} == {(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 0)}


def test_empty_table(spark):
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_of_nodes(spark):
    df = spark.createDataFrame(awkward(), SCHEMA)
    nodes = pt.prefix_trie(df).where("depth = 1 AND conv_id = 200").select("role", "text").collect()
    assert [tuple(r) for r in nodes] == [("user", "copy 0")]
    assert pt.prefix_trie(df).where("depth = 0").select("text").first()[0] is None


def test_whole_table(spark):
    conv = table(spark, SF, "conversations")
    rows = [tuple(r) for r in conv.select("conv_id", "turn", "role", "text").collect()]
    got = pt.op12_prefix_trie(spark, SF)
    assert got.columns == COLUMNS and rows_of(got) == brute(rows, True)


def test_ids_of_a_hot_node_are_hashed_in_order(spark, monkeypatch):
    """One key with all rows, printed by several tasks in several chunks."""
    monkeypatch.setattr(pt, "ID_CHUNK", 100)
    members = spark.range(5000).select(F.unhex(F.lit("00ff")).alias("key"), (F.col("id") * 7 - 100).alias("conv_id")).repartition(7)
    ((_, digest),) = pt.ends(members).collect()
    assert digest == sha256(",".join(str(k * 7 - 100) for k in range(5000)).encode()).hexdigest()
