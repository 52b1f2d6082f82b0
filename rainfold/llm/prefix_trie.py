"""Conversation prefix trie by truncation peeling (operator 12).

A node of depth d is a distinct sequence of the first d turns (role, text) of
some conversation.  Peeling starts at the greatest depth: the conversations
that end there are its nodes; then the last turn is stripped, what survives is
regrouped together with the conversations that end one turn earlier, and so on
up to the root.  Every regrouping finishes the nodes of its depth with all
their figures, because their subtrees are finished by then.

On Spark:

* A turn is its digest and the size of its text, a prefix the chained digest of
  its turns (128 bits), so a conversation is 24 bytes a turn; texts are never
  shuffled.  Equal conversations are merged before anything else.
* Prefixes at a ladder of depths (0, 1, 2, 3, 5, 7, 11, ...) are counted.  The
  shallowest prefix of a conversation that at most ``GROUP`` distinct
  conversations share is its floor.  All below a floor is peeled by one task
  (a bounded group), all floors side by side.
* Above the floors every depth is one aggregation over the nodes below it,
  combined before the shuffle, so a first turn shared by any share of the
  conversations is never gathered.  There are as many such rounds as the
  deepest prefix that more than ``GROUP`` distinct conversations share
  (up to the next step of the ladder).

Null role or text is empty; turns of one conversation are ordered by turn (null
first), equal turns by their digest; a repeated row is a further turn; rows
without ``conv_id`` belong to no conversation and are left out; very long texts
are hashed in their row; an empty table gives no node (not even a root).  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rainfold.llm.common import chunks, materialise, table

#: Distinct conversations below a floor at most.
GROUP = 256
#: Bytes of a prefix digest; the digest of the empty prefix.
DIGEST = 16
ROOT = bytes(DIGEST)
#: Parts of a prefix that more than ``GROUP`` distinct conversations share.
SALTS = 64
#: Text of joined ids handed on in one row (bytes).
ID_CHUNK = 1 << 16

NODE = "key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): per conversation its turns in order, each a digest of
    role and text and the UTF-8 bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    marked = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(F.col("turn").cast("long").alias("turn"),
                    F.substring(F.unhex(F.sha2(marked.cast("binary"), 256)), 1, DIGEST).alias("digest"),
                    F.octet_length(text).cast("long").alias("size"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).where("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 5, longest: int = 9) -> DataFrame:
    """``turns_of`` with borrowed beginnings: conversation c takes the first h
    turns of conversation c - c % every (none if there is none), then its own
    turns after its first h; h = crc32(decimal c) % longest.

    At most ``every`` conversations share a beginning, so the window's groups
    are that small."""
    each = turns_of(conversations.withColumn("conv_id", F.col("conv_id").cast("long")))
    each = each.withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, longest - 1))).over(W.partitionBy("base"))
    each = each.select("conv_id", "turns", head.alias("head"),
                       (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int").alias("h"))
    empty = F.slice("turns", 1, 0)
    borrowed = F.coalesce(F.slice("head", F.lit(1), F.col("h")), empty)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return each.select("conv_id", F.concat(borrowed, own).alias("turns"))


def chained(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, path, sizes): chained digests of all prefixes
    (``path``, the last of them is ``key``) and the turns' sizes (big-endian int64)."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sizes = batch.column("digests"), batch.column("sizes")
            at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            flat = lists.flatten().to_pylist()
            numbers = np.asarray(sizes.flatten(), dtype=">i8")
            keys, paths, raw = [], [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                key, path = ROOT, []
                for d in flat[i:j]:
                    key = blake2b(key + d, digest_size=DIGEST).digest()
                    path.append(key)
                keys.append(key)
                paths.append(b"".join(path))
                raw.append(numbers[i:j].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(keys, pa.binary()),
                 pa.array(paths, pa.binary()), pa.array(raw, pa.binary())], ["conv_id", "depth", "key", "path", "sizes"])

    rows = turns.select("conv_id", F.transform("turns", lambda t: t["digest"]).alias("digests"),
                        F.transform("turns", lambda t: t["size"]).alias("sizes"))
    return rows.mapInArrow(chain, "conv_id long, depth long, key binary, path binary, sizes binary")


def prefix_key(depth: Column) -> Column:
    """Digest of the first ``depth`` turns of a row's path."""
    at = ((depth - 1) * DIGEST + 1).cast("int")
    return F.when(depth == 0, F.lit(ROOT)).otherwise(F.substring("path", at, F.lit(DIGEST)))


def ladder(depth: Column) -> Column:
    """Depths of the ladder that are at most ``depth``."""
    steps = F.sequence(F.lit(0), F.ceil(F.log(F.greatest(depth, F.lit(1)).cast("double")) / float(np.log(1.5))).cast("int") + 1)
    rungs = F.transform(steps, lambda i: F.floor(F.pow(F.lit(1.5), i)).cast("long"))
    return F.filter(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), rungs)), lambda k: k <= depth)


def with_floors(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """``distinct`` plus ``floor``: the shallowest ladder depth whose prefix at
    most ``group`` rows share; null where there is none up to the row's end."""
    rungs = distinct.select("key", "path", F.explode(ladder(F.col("depth"))).alias("rung"))
    rungs = rungs.select("key", "rung", prefix_key(F.col("rung")).alias("prefix"))
    heavy = rungs.groupBy("rung", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group)
    # every heavy prefix is a hot key of this join: the rows are dealt over SALTS parts of it
    heavy = heavy.select("rung", "prefix", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rungs.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    deepest = salted.join(heavy, ["rung", "prefix", "salt"]).groupBy("key").agg(F.max("rung").alias("deepest"))
    after = F.filter(ladder(F.col("depth")), lambda k: k > F.coalesce(F.col("deepest"), F.lit(-1)))
    return distinct.join(deepest, "key", "left").withColumn("floor", F.get(after, F.lit(0))).drop("deepest")


def _peel(rows: list[tuple], floor: int) -> list[tuple]:
    """Nodes from the greatest depth down to ``floor``, of rows (n_convs,
    conv_id, path, sizes) that share their first ``floor`` turns.  The node at
    the floor comes last; its parent is not known here."""
    ends: dict[int, list[int]] = {}
    for k, (_, _, path, _) in enumerate(rows):
        ends.setdefault(len(path) // DIGEST, []).append(k)
    sizes = [np.frombuffer(r[3], ">i8") for r in rows]
    out, below = [], {}   # key -> [a row through the node, n_convs, conv_id, children, leaves, saved]
    for depth in range(max(ends), floor - 1, -1):
        here: dict[bytes, list] = {}
        at = (depth - 1) * DIGEST
        for k in ends.get(depth, ()):                 # conversations that end here
            n, conv, path, _ = rows[k]
            key = path[at:at + DIGEST] if depth else ROOT
            node = here.setdefault(key, [k, 0, conv, 0, 0, 0])
            node[1] += n
            node[2] = min(node[2], conv)
        parents = []
        for child in below.values():                  # survivors, their last turn stripped
            k, n, conv, _, leaves, saved = child
            key = rows[k][2][at:at + DIGEST] if depth else ROOT
            node = here.setdefault(key, [k, 0, conv, 0, 0, 0])
            node[1] += n
            node[2] = min(node[2], conv)
            node[3] += 1
            node[4] += leaves
            node[5] += saved
            parents.append(node)
        out += [(key, depth + 1, c[2], p[2], c[1], c[3], c[4], c[5]) for (key, c), p in zip(below.items(), parents)]
        for node in here.values():
            node[4] = node[4] or 1
            if depth:
                node[5] += (node[1] - 1) * int(sizes[node[0]][depth - 1])
        below = here
    out += [(key, floor, c[2], None, c[1], c[3], c[4], c[5]) for key, c in below.items()]
    return out


def _peel_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Peel each run of equal ``light`` (rows sorted by it)."""
    names = ["key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "path", "sizes"]
    types = [pa.binary()] + [pa.int64()] * 7 + [pa.binary()] * 2

    def finished(floor: int, rows: list[tuple]) -> pa.RecordBatch:
        nodes = _peel(rows, floor)
        top = (rows[0][2][:floor * DIGEST], rows[0][3][:floor * 8])   # only the floor goes on
        cols = list(zip(*[n + ((None, None) if n[1] > floor else top) for n in nodes]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    light, floor, held = None, 0, []
    for batch in batches:
        for key, f, *row in zip(*(batch.column(c).to_pylist() for c in ("light", "floor", "n_convs", "conv_id", "path", "sizes"))):
            if key != light and held:
                yield finished(floor, held)
                held = []
            light, floor = key, f
            held.append(tuple(row))
    if held:
        yield finished(floor, held)


def trie(sequences: DataFrame, group: int = GROUP) -> DataFrame:
    """All nodes of the conversations in ``sequences`` (conv_id, turns) as from
    ``turns_of``: the ``NODE`` columns and ``ends_sha256``."""
    all_rows = materialise(chained(sequences), "trie-chained")
    distinct = all_rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    distinct = materialise(distinct, "trie-distinct")
    rows = materialise(with_floors(distinct, group), "trie-floors")

    light = rows.where("floor IS NOT NULL").withColumn("light", prefix_key(F.col("floor")))
    light = light.select("light", "floor", "n_convs", "conv_id", "path", "sizes").repartition("light").sortWithinPartitions("light")
    peeled = materialise(light.mapInArrow(_peel_groups, NODE + ", path binary, sizes binary"), "trie-peeled")

    # above the floors: finished nodes and ended conversations, depth by depth
    names = [f.split()[0] for f in NODE.split(", ")]
    floors = peeled.where("path IS NOT NULL").withColumn("ended", F.lit(False))
    ended = rows.where("floor IS NULL").select(
        "key", "depth", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("n_children"),
        F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "path", "sizes", F.lit(True).alias("ended"))
    waiting = floors.unionByName(ended)
    top = waiting.agg(F.max(F.col("depth") - F.when(F.col("ended"), 0).otherwise(1))).first()[0]   # one number
    done = [peeled.where("path IS NULL").select(*names)]
    below = floors.where(F.col("depth") == F.lit(top) + 1) if top is not None else floors
    for depth in range(-1 if top is None else top, -1, -1):
        arriving = below.unionByName(ended.where(F.col("depth") == depth))
        grouped = arriving.select("*", prefix_key(F.lit(depth)).alias("up")).groupBy("up").agg(
            F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
            F.count_if(~F.col("ended")).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
            F.min(F.substring("path", 1, depth * DIGEST)).alias("path"), F.min(F.substring("sizes", 1, depth * 8)).alias("sizes"))
        last = F.conv(F.hex(F.substring("sizes", (depth - 1) * 8 + 1, 8)), 16, 10).cast("long") if depth else F.lit(0)
        here = materialise(grouped.select(
            F.col("up").alias("key"), F.lit(depth).cast("long").alias("depth"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
            "n_children", F.greatest("leaves", F.lit(1)).alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * last).alias("saved_tokens"), "path", "sizes", F.lit(False).alias("ended")), "trie-level")
        if depth:
            up = here.select(F.col("key").alias("up"), F.col("conv_id").alias("parent"))
            named = below.withColumn("up", prefix_key(F.lit(depth))).join(up, "up").withColumn("parent_conv_id", F.col("parent"))
        else:   # the root is one row: its smallest member is one number
            named = below.withColumn("parent_conv_id", F.lit(here.first()["conv_id"]).cast("long"))
        done.append(named.select(*names))
        below = here.unionByName(floors.where(F.col("depth") == depth))
    done.append(below.where("depth = 0").select(*names))   # the root
    nodes = done[0]
    for part in done[1:]:
        nodes = nodes.unionAll(part)
    digests = ends(all_rows.select("key", "conv_id"))
    return nodes.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())))


def ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the decimal ids of each key's members,
    ascending and comma-joined.

    The ids are dealt by range of (key, id), so a key of any size is sorted and
    printed by many tasks; then one task a key hashes the printed chunks in
    order, as a stream."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, key, ids, size = [], None, [], 0

        def close() -> None:
            rows.append((key, ids[0], len(ids), ",".join(map(str, ids))))

        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (k != key or size > ID_CHUNK):
                    close()
                    ids, size = [], 0
                key = k
                ids.append(c)
                size += 12
            if rows:
                yield _batch(rows)
                rows = []
        if ids:
            close()
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.string()))],
                                          ["key", "first", "n", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in chunks(batches, "ids"):
            keys, digests = [], []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k == key:
                    state.update(b",")
                else:
                    if state is not None:
                        keys.append(key)
                        digests.append(state.hexdigest())
                    key, state = k, sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])

    chunked = dealt.mapInArrow(printed, "key binary, first long, n long, ids string")
    return chunked.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = GROUP) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) with the last
    role and text of every node: those of its smallest member (null at the
    root)."""
    nodes = trie(turns_of(conversations), group)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, DIGEST)
    place = W.partitionBy("conv_id").orderBy("turn", "digest")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 role.alias("role"), text.alias("text"), digest.alias("digest")).where("conv_id IS NOT NULL")
    turns = turns.select("conv_id", F.row_number().over(place).cast("long").alias("depth"), "role", "text")
    return nodes.join(turns, ["conv_id", "depth"], "left")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie(rebuilt(table(spark, sf_dir, "conversations")))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
