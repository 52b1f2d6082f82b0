"""SimHash and embedding near-duplicates against all pairs."""

import numpy as np
import xxhash
from docs_fixture import components, documents, frame, words
from pyspark.sql import functions as F

from rainfold.llm import embedding_dedup as ed
from rainfold.llm import simhash as sh
from rainfold.llm.common import connected_components


def _fingerprint(text):
    w = words(text)
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    bits = [0] * 64
    for x in s:
        h = xxhash.xxh64(x, seed=42).intdigest()
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(s)) if s else 0


def test_simhash_query_columns(spark):
    docs = documents()
    fps = np.array([_fingerprint(d[1]) for d in docs], dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    root = components(len(docs), zip(*np.nonzero(np.triu(near, 1))))
    least = {}
    for i, r in enumerate(root):
        if docs[i][0] is not None:
            least[r] = min(least.get(r, docs[i][0]), docs[i][0])
    want = sorted(((d[0], f"{fps[i]:016x}", least.get(root[i])) for i, d in enumerate(docs)), key=repr)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in sh.near_duplicates(frame(spark)).collect()), key=repr)
    assert got == want


def test_spark_hash_is_the_contracts(spark):
    h = spark.sql("SELECT xxhash64('the cat sat') AS h").first().h
    assert h % 2**64 == xxhash.xxh64(b"the cat sat", seed=42).intdigest()


def test_every_plan_finds_every_link(spark):
    """Any number of parts and any valid thresholds give the same components,
    also with dense groups larger than a block."""
    r = np.random.default_rng(3)
    centre = r.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set(centre.tolist())
    for c in centre[:3]:
        for _ in range(500):
            fps.add(int(c) ^ int(sum(1 << int(b) for b in r.choice(64, r.integers(1, 4), replace=False))))
    for c in centre[3:]:
        fps.add(int(c) ^ 0b111)
        fps.add(int(c) ^ 0b1111 << 40)   # four bits: not linked to the centre
    v = np.array(sorted(fps), dtype=np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    want = components(len(v), zip(*np.nonzero(np.triu(near, 1))))
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp BIGINT").repartition(3)
    for thresholds in ((0, 0, 0, 0), (1, -1, 0, 0), (1, 0, 0), (1, 1), (2, 0)):
        bits = sh.group_bits(v, len(thresholds))
        assert sorted(b for p in bits for b in p) == list(range(64))
        parts = [sh.Part(b, t) for b, t in zip(bits, thresholds) if t >= 0]
        roots = {x.node: x.root for x in connected_components(sh.links(df, parts, 3)).collect()}
        got = [roots.get(int(x), int(x)) for x in v.view(np.int64)]
        index = {}
        assert [index.setdefault(g, i) for i, g in enumerate(got)] == want, thresholds


def test_threshold_allocation_is_optimal():
    r = np.random.default_rng(1)
    from itertools import product
    for m in (2, 3, 4):
        costs = r.random((m, 5)).tolist()
        total = 3 - m + 1
        best = min(sum(costs[i][t + 1] for i, t in enumerate(c)) for c in product(range(-1, 4), repeat=m) if sum(c) == total)
        cost, chosen = sh.allocate(costs, total)
        assert abs(cost - best) < 1e-12 and sum(chosen) == total
    assert sum(p.threshold for p in sh.plan(r.integers(0, 2**63, 500, dtype=np.uint64), 10**9, 3)) >= 0


def test_one_row_of_each_group_stays(spark):
    df = frame(spark)
    kept = sh.keep_one(df).collect()
    roots = sh.components(sh.fingerprints(df), 3).select("root").distinct().count()   # two groups may share an id
    assert len(kept) == roots and df.columns == sh.keep_one(df).columns
    assert {k.doc_id for k in kept} == {d.component_id for d in sh.near_duplicates(df).collect()}
    unique = frame(spark, [d for i, d in enumerate(documents()[:20])])
    assert {r.doc_id for r in sh.keep_one(unique).collect()} == {r.component_id for r in sh.near_duplicates(unique).collect()}
    assert sh.keep_one(frame(spark, [])).count() == 0 and sh.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 500 + i) for i in range(300)] + [(3, 3), (9, 8), (8, 9), (None, 4)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert got[139] == 100 and got[799] == 7 and got[9] == 8 and got[3] == 3 and 4 not in got


def _vectors():
    r = np.random.default_rng(8)
    v = r.normal(size=(160, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    for i in range(40):   # near copies of varying closeness, chains among them
        rows.append((200 + i, (v[i % 12] / np.linalg.norm(v[i % 12]) + r.normal(size=16) * 0.05).tolist()))
    rows += [(300, v[0].tolist()), (301, v[0].tolist()), (302, (v[0] * 3).tolist()), (303, [0.0] * 16), (304, None), (305, [1.0, None] * 8),
             (306, [float("nan")] * 16), (307, [float("inf")] * 16), (308, []), (309, [1.0, 2.0]), (310, [2.0, 4.0]), (300, v[0].tolist()),
             (None, v[1].tolist())]
    return rows


def test_embedding_links_components(spark):
    rows = _vectors()
    good = [i for i, (_, x) in enumerate(rows) if x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for a in good:
        for b in good:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if a != b and len(x) == len(y):
                near[a, b] = x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.95
    root = components(n, zip(*np.nonzero(np.triu(near, 1))))
    least = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    want = sorted(((rows[i][0], int(near[i].sum()), least.get(root[i])) for i in range(n)), key=repr)
    schema = "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT, node STRING, n_links INT, kept INT"
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], schema)
    for block in (4096, 16):   # whole cells, and cells cut into many blocks
        p = ed.DedupParams(block=block)
        got = ed.near_duplicates(df, p=p).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert ed.near_duplicates(df.where(F.lit(False))).count() == 0
    # single-precision vectors, compared in double precision
    small = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.95, 0.31224990]), (2, [0.949, 0.3152]), (3, [0.0, 1.0])],
                                  "vec_id BIGINT, embedding ARRAY<FLOAT>")
    v = np.array([r.embedding for r in small.orderBy("vec_id").collect()])
    c = (v @ v.T) / np.sqrt((v * v).sum(1))[:, None] / np.sqrt((v * v).sum(1))[None, :]
    assert [r.n_links for r in ed.near_duplicates(small).orderBy("vec_id").collect()] == [int((x >= 0.95).sum()) - 1 for x in c]
