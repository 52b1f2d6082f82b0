"""Operator 11 against a plain recursive Merkle tree."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from docs_fixture import documents, frame
from pyspark.sql import functions as F

from rainfold.llm import merkle
from rainfold.llm.common import table


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """Top, and for each node its proof as [(position in run, siblings)]."""
    proofs, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, up_owners = [], []
        for k in range(0, len(nodes), 2):
            run = nodes[k:k + 2]
            for a in range(len(run)):
                for leaf in owners[k + a]:
                    proofs[leaf].append((a, run[:a] + run[a + 1:]))
            up.append(H(*run))
            up_owners.append(sum(owners[k:k + 2], []))
        nodes, owners = up, up_owners
    return nodes[0], proofs


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute(rows):
    """Sorted result rows of (doc_id, source, lang, n_chars, text) tuples."""
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for n in names:
        by[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[n] = plain_tree([leaf(r) for r in by[n]])
    root, upper = plain_tree([trees[n][0] for n in names])
    out = []
    for n, above in zip(names, upper):
        for r, proof in zip(by[n], trees[n][1]):
            proof = proof + above
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                node = leaf((*r[:3], r[3] + 1, r[4]))
            for place, others in proof:
                node = H(*([*others, node] if place else [node, *others]))
            out.append((r[0], leaf(r), trees[n][0], root, H(*[x for _, o in proof for x in o]), node, node == root))
    return sorted(out, key=repr)


def got(spark, df, **kw):
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = merkle.dataset_manifest(df, tampered).collect()
    return sorted((tuple(r)[:7] for r in rows), key=repr)


def plain(df):
    return [tuple(r) for r in df.select(*merkle.FIELDS).collect()]


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_awkward_rows(spark, monkeypatch, levels):
    """Nulls, empty and long texts, repeated rows, repeated and null ids,
    clashing columns; superblocks of 2, 4 and 1,024 leaves."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    df = frame(spark, [(*r[:4], 9223372036854775807 if r[0] == 3 else r[0], *r[5:]) for r in documents()])
    df = df.withColumn("tree", F.lit("x")).withColumn("node", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("_tie", F.lit(0))
    assert got(spark, df) == brute(plain(df))


def test_one_row_and_no_row(spark):
    one = frame(spark, documents()[:1])
    (row,) = got(spark, one)
    assert row[1] == row[2] == row[3] and row[4] == H() and row == brute(plain(one))[0]
    assert got(spark, one.limit(0)) == []


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = sorted((tuple(r)[:7] for r in merkle.op11_merkle(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert rows == brute(plain(docs))
    assert 0 < sum(not r[6] for r in rows) < len(rows)


def test_every_change_of_a_row_breaks_its_proof(spark):
    """A folded leaf leads to the root only if nothing changed."""
    nodes = [H(str(k)) for k in range(11)]
    levels = merkle.reduce_levels(nodes, 4)
    for k, node in enumerate(nodes):
        proof = merkle.siblings(levels, k)
        assert merkle.fold(node, proof) == levels[-1][0]
        assert merkle.fold(H("x"), proof) != levels[-1][0]
