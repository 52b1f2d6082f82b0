"""Token ids as length-delimited binary records (operator 1).

File format, one ``shard-NNNNNN.rec`` per range of ids: a header (``TOKR`` and
the bytes of an id as uint32), then records::

    uint64 length | uint32 masked crc32 of the length | payload | uint32 masked crc32 of the payload

(all little-endian; the payload is the id sequence as unsigned integers of 2
bytes if the whole vocabulary fits, else 4) and beside it ``shard-NNNNNN.idx``: one ``<q Q Q>`` entry (document
id, offset of the frame, payload length) per record, in the same order.  The
checksum is CRC-32 with the usual rotate-and-add mask, so that a stored
checksum of data that itself holds checksums stays strong.

Shards are written by the tasks straight to the output folder (any store that
``pyarrow.fs`` opens: shared POSIX, hdfs, s3, gs) under a temporary name and
then renamed, so a retried or speculative task replaces nothing but its own
shard with equal bytes.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.llm.common import CHUNK_BYTES, chunks, materialise, table, workspace

#: Formats of an index entry, a length and a checksum.
INDEX_ENTRY, INDEX_BYTES = "<qQQ", 24
LENGTH, CHECK = "<Q", "<I"
#: Stands for a null document id in the index.
NO_ID = -(1 << 63)
#: Text of a shard, about, where that makes more shards than shuffle partitions.
SHARD_BYTES = 256 << 20
#: Pieces whose ids each worker remembers (about 20 bytes each, and 50 while a chunk is looked up).
CACHE_PIECES = 300_000
#: Text of an Arrow batch that Spark sends to a writing task, about (a longer text goes alone).  Its
#: default of 64 MB is held about six times over: in the JVM's vectors and stream, and by the worker.
BATCH_BYTES = 4 << 20
#: Rows that Spark's Parquet reader decodes at once; its default of 4096 holds whole texts in arrays
#: that double as they grow, so the heap grows with the length of the texts.
READ_ROWS = 256


MAGIC, HEADER_BYTES = b"TOKR", 8


class CorruptRecord(ValueError):
    """A length or checksum does not match."""


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack(LENGTH, len(payload))
    return b"".join((head, struct.pack(CHECK, masked_crc(head)), payload, struct.pack(CHECK, masked_crc(payload))))


def read_frame(stream) -> bytes | None:
    """Next payload; None at the end of the file."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack(CHECK, head[8:])[0] != masked_crc(head[:8]):
        raise CorruptRecord("length")
    n = struct.unpack(LENGTH, head[:8])[0]
    body = stream.read(n + 4)
    if len(body) < n + 4 or struct.unpack(CHECK, body[n:])[0] != masked_crc(body[:n]):
        raise CorruptRecord("payload")
    return body[:n]


def read_header(stream) -> np.dtype:
    """Type of the ids in a file that is at its beginning."""
    head = stream.read(HEADER_BYTES)
    if len(head) < HEADER_BYTES or head[:4] != MAGIC or head[4:] not in (b"\2\0\0\0", b"\4\0\0\0"):
        raise CorruptRecord("header")
    return np.dtype(f"<u{head[4]}")


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a folder given as URI or absolute path."""
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


# White space of the tokenizer's pattern.  (Python's \\s also has \\x1c-\\x1f,
# which that pattern treats as symbols.)
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WS_CHARS = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{_WS}]", chr(c)))
_UNIT = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: Marks a piece that has no space before it.
MARK = "\x01"
#: Cuts beside those at spaces: between a letter (of a block that no version of
#: Unicode disputes) and an ASCII symbol, and on both sides of a single line end.
_CUTS = ((r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-/:-@\[-`{-~])", rf"\1 {MARK}\2"),
         (rf"([^{_WS}])\n([^{_WS}])", f"\\1 {MARK}\n {MARK}\\2"))


class PieceEncoder:
    """Encodes whole texts with a byte-level BPE tokenizer, each distinct
    piece once.

    The tokenizer's pattern never joins a visible character with white space
    after it, nor a letter with a symbol after it, so a text may be cut there
    without changing its ids.  The pieces (mostly words) repeat: each is
    encoded once and kept in a bounded cache, and the ids of a batch of texts
    are gathered piece by piece.  A text is encoded by a plainer cut if it has
    white space before a space, whole if it holds a special string.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        #: ids whose bytes begin with a space (shown as U+0120 in the vocabulary)
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        newline = self._ids("\n")
        self.newline = int(newline[0]) if len(newline) == 1 else None
        # Pieces met since the cache last turned over and those of the turn before, each with its ids
        # (null: not usable).  Arrow arrays take some 20 bytes a piece, a dict ten times that.
        self.new = self.old = pa.array([], pa.string())
        self.new_ids = self.old_ids = pa.array([], pa.binary())

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, words: list[str]) -> list[bytes | None]:
        """Ids of " " + word, of marked words without the space.  Words that
        end with white space (or are empty) are no pieces, but for the marked
        line end.  Many are encoded in one call, where the place of each is
        certain: words after a space begin at an id that begins with a space,
        marked words without white space are joined by line ends."""
        known: dict[str, bytes | None] = {}
        plain, marked = [], []
        for w in words:
            if w == MARK + "\n":
                known[w] = self._ids("\n").tobytes()
            elif not w or w[-1] in _WS_CHARS or w == MARK:
                known[w] = None
            elif w[0] != MARK:
                plain.append(w)
            elif len(w[1:].split()) == 1 and not w[1].isspace() and self.newline is not None:
                marked.append(w)
            else:
                known[w] = self._ids(w[1:]).tobytes()
        for some in (plain[at:at + 256] for at in range(0, len(plain), 256)):
            ids = self._ids(" " + " ".join(some))
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) == len(some) and begins[0] == 0:
                known.update(self._parts(some, ids, begins, np.append(begins[1:], len(ids))))
            else:
                known.update((w, self._ids(" " + w).tobytes()) for w in some)
        for some in (marked[at:at + 256] for at in range(0, len(marked), 256)):
            ids = self._ids("\n".join(w[1:] for w in some))
            ends = np.append(np.flatnonzero(ids == self.newline), len(ids))
            if len(ends) == len(some):
                known.update(self._parts(some, ids, np.append(0, ends[:-1] + 1), ends))
            else:
                known.update((w, self._ids(w[1:]).tobytes()) for w in some)
        return [known[w] for w in words]

    @staticmethod
    def _parts(words: list[str], ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, bytes]]:
        raw, n = ids.tobytes(), ids.itemsize
        return ((w, raw[i:j]) for w, i, j in zip(words, (begins * n).tolist(), (ends * n).tolist()))

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text, cut by pattern."""
        if any(x in text for x in self.special):
            return self._ids(text)
        parts = [self._ids(u) for u in _UNIT.findall(text)]
        return np.concatenate(parts) if parts else np.zeros(0, self.kind)

    def _pieces(self, words: pa.StringArray) -> pa.BinaryArray:
        """Ids of the (distinct) words, from the cache or learnt now."""
        if len(self.new) > CACHE_PIECES // 2:
            self.old, self.old_ids = self.new, self.new_ids
            self.new, self.new_ids = self.new[:0], self.new_ids[:0]
        at = pc.index_in(words, value_set=pa.concat_arrays([self.new, self.old]))
        unknown = words.filter(pc.is_null(at))
        ids = pa.concat_arrays([self.new_ids, self.old_ids, pa.array(self._learn(unknown.to_pylist()), pa.binary())])
        place = np.array(at.fill_null(-1), np.int64)
        place[place < 0] = np.arange(len(ids) - len(unknown), len(ids))
        found = ids.take(pa.array(place))
        fresh = pa.array(place >= len(self.new))
        self.new = pa.concat_arrays([self.new, words.filter(fresh)])
        self.new_ids = pa.concat_arrays([self.new_ids, found.filter(fresh)])
        return found

    def encode_batch(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) and where each text's ids begin (one
        more entry than texts)."""
        cut = texts
        for pattern, replacement in _CUTS:
            cut = pc.replace_substring_regex(cut, pattern=pattern, replacement=replacement)
        pieces = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(MARK), cut, ""), " ")
        at = np.asarray(pieces.offsets) - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        gathered = self._pieces(coded.dictionary).take(coded.indices)
        ids = np.frombuffer(gathered.buffers()[2] or b"", self.kind)
        begins = np.frombuffer(gathered.buffers()[1], np.int32)[at].astype(np.int64) // self.kind.itemsize

        # an unusable piece, a text with the mark in it or a special string: that text is encoded by itself
        odd = np.asarray(pc.match_substring(texts, MARK))
        for x in self.special:
            odd = odd | np.asarray(pc.match_substring(texts, x))
        if gathered.null_count:
            odd = odd | (np.add.reduceat(np.asarray(pc.is_null(gathered)).astype(np.int64), at[:-1]) > 0)
        odd &= np.asarray(pc.binary_length(texts)) > 0
        if not odd.any():
            return ids[begins[0]:begins[-1]], begins - begins[0]
        parts = [self.encode(texts[i].as_py()) if odd[i] else ids[begins[i]:begins[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    """One per worker process."""
    if path not in _encoders:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def write_token_records(df: DataFrame, out_uri: str, tokenizer_path: str, id_col: str = "doc_id",
                        text_col: str = "text", end_id: int | None = 0, shards: int | None = None) -> DataFrame:
    """Encode ``text_col``, write shards in ascending ``id_col`` order and
    return the manifest (shard, n_records, n_tokens), one row per shard.

    Rows are dealt by range of (id, beginning and hash of the text, row), so
    shards are balanced by rows whatever the source, and an id (or null) that
    many rows share is split too; there are at least as many as the text has
    ``SHARD_BYTES``.  All texts are taken whole.  Null text is empty (its record
    holds only the end id); a null id sorts first; rows with the same id are
    ordered by the first 32 characters of their text, then by its hash (equal
    rows in any order, their records are equal); an empty input writes no
    shard.  Other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if not shards:
        with _small_batches(df.sparkSession):
            size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0   # one number
        shards = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    keys = ["id", "_head", "_hash", "_row"]
    ranged = rows.withColumns({"_head": F.substring("text", 1, 32), "_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ranged = ranged.repartitionByRange(shards, *keys).sortWithinPartitions(*keys).select("id", "text")
    end = [] if end_id is None else [end_id]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        fs, folder = open_folder(out_uri)
        encoder = _encoder(tokenizer_path)
        part = rec = idx = None
        width = max(encoder.kind.itemsize, 2 if (end_id or 0) < 1 << 16 else 4)
        offset, records, tokens = HEADER_BYTES, 0, 0
        for batch in chunks(batches, limit=2 * CHUNK_BYTES):
            if rec is None:
                fs.create_dir(folder, recursive=True)
                part = f"{folder}/_{shard:06d}-{uuid.uuid4().hex}"
                rec, idx = fs.open_output_stream(part + ".rec"), fs.open_output_stream(part + ".idx")
                rec.write(MAGIC + struct.pack("<I", width))
            ids, at = encoder.encode_batch(batch.column("text").fill_null(""))
            ids, last = ids.astype(f"<u{width}", copy=False), np.array(end, f"<u{width}").tobytes()
            for doc, i, j in zip(batch.column("id").to_pylist(), at[:-1], at[1:]):
                payload = ids[i:j].tobytes() + last
                framed = frame(payload)
                rec.write(framed)
                idx.write(struct.pack(INDEX_ENTRY, NO_ID if doc is None else doc, offset, len(payload)))
                offset += len(framed)
                records += 1
                tokens += len(payload) // width
            del batch, ids
            pa.default_memory_pool().release_unused()   # else the pool keeps a chunk's work space, in every worker
        if rec is not None:
            rec.close()
            idx.close()
            for kind in (".rec", ".idx"):
                fs.move(part + kind, f"{folder}/shard-{shard:06d}{kind}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_records": [records], "n_tokens": [tokens]})

    with _small_batches(df.sparkSession):
        return materialise(ranged.mapInArrow(write, "shard long, n_records long, n_tokens long"), "token-manifest")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hold few texts at a time: the session's limits are
    lowered (never raised) and then set back."""
    limits = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS}
    before = {key: spark.conf.get(key, None) for key in limits}
    try:
        for key, limit in limits.items():
            own = re.fullmatch(r"(\d+)b?", before[key] or "")
            if not own or int(own[1]) > limit:
                spark.conf.set(key, str(limit))
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def read_token_records(manifest: DataFrame, out_uri: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids binary]) read back from the
    shards, every length and checksum verified.  ``start`` counts the ids of
    all records before, in shard order; ``ids`` holds (and the crc32 is over)
    unsigned 32-bit integers."""
    starts = _shard_starts(manifest)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_folder(out_uri)
        for batch in batches:
            for shard, start, n_records in zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "n_records"))):
                name = f"{folder}/shard-{shard:06d}"
                rows, held = [], 0
                with fs.open_input_stream(name + ".rec", buffer_size=1 << 20) as rec, fs.open_input_stream(name + ".idx", buffer_size=1 << 20) as idx:
                    kind = read_header(rec)
                    for _ in range(n_records):
                        payload = read_frame(rec)
                        entry = idx.read(INDEX_BYTES)
                        if payload is None or len(entry) < INDEX_BYTES:
                            raise CorruptRecord(f"{name} ends early")
                        doc, _, n = struct.unpack(INDEX_ENTRY, entry)
                        if n != len(payload):
                            raise CorruptRecord(f"{name}: index and record differ")
                        found = np.frombuffer(payload, kind).astype("<u4").tobytes()
                        rows.append((None if doc == NO_ID else doc, start, len(found) // 4, zlib.crc32(found), found if ids else None))
                        start += len(found) // 4
                        held += len(found) if ids else 160    # bytes of a row's numbers as Python objects
                        if held > 4 << 20:
                            yield _record_batch(rows, ids)
                            rows, held = [], 0
                    if read_frame(rec) is not None:
                        raise CorruptRecord(f"{name} goes on after its last record")
                if rows:
                    yield _record_batch(rows, ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")
    return starts.mapInArrow(read, schema)


def _record_batch(rows: list[tuple], ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows))
    arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + ([pa.array(cols[4], pa.binary())] if ids else [])
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)


#: Shards whose counts are added up at once for the starting offsets.
SHARD_BLOCK = 1024


def _shard_starts(manifest: DataFrame) -> DataFrame:
    """Manifest with ``start``, one partition per few shards.  Two-level
    prefix sums: within blocks of shards, then over the blocks."""
    from pyspark.sql import Window as W
    m = manifest.withColumn("block", F.floor(F.col("shard") / SHARD_BLOCK))
    inner = W.partitionBy("block").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    outer = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = m.groupBy("block").agg(F.sum("n_tokens").alias("n")) \
        .select("block", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    out = m.join(blocks, "block").select("shard", "n_records", (F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)) + F.col("before")).alias("start"))
    return out.repartitionByRange(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")


def read_index(spark: SparkSession, manifest: DataFrame, out_uri: str) -> DataFrame:
    """(doc_id, shard, offset, length) of every record, from the index files."""
    def read(batches):
        fs, folder = open_folder(out_uri)
        kind = np.dtype([("doc", "<i8"), ("offset", "<u8"), ("n", "<u8")])
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                with fs.open_input_stream(f"{folder}/shard-{shard:06d}.idx") as f:
                    while data := f.read(kind.itemsize << 16):
                        e = np.frombuffer(data, kind)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(e["doc"].astype("i8"), mask=e["doc"] == NO_ID), pa.array(np.full(len(e), shard)),
                             pa.array(e["offset"].astype("i8")), pa.array(e["n"].astype("i8"))],
                            ["doc_id", "shard", "offset", "length"])
    return manifest.select("shard").mapInArrow(read, "doc_id long, shard long, offset long, length long")


def shuffled_records(spark: SparkSession, manifest: DataFrame, out_uri: str, seed: int, partitions: int) -> DataFrame:
    """All records in a seeded random order (position within ``partitions``
    equal ranges): the index is shuffled, then each task seeks its records.
    Returns (doc_id, ids binary); memory per task is one record at a time."""
    order = read_index(spark, manifest, out_uri).withColumn("key", F.xxhash64(F.lit(seed), "shard", "offset"))
    order = order.repartitionByRange(partitions, "key").sortWithinPartitions("key", "shard", "offset")

    def read(batches):
        fs, folder = open_folder(out_uri)
        files: dict[int, tuple] = {}
        for batch in batches:
            for doc, shard, offset, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "shard", "offset", "length"))):
                if shard not in files:
                    if len(files) >= 64:
                        files.pop(next(iter(files)))[0].close()
                    opened = fs.open_input_file(f"{folder}/shard-{shard:06d}.rec")
                    files[shard] = opened, read_header(opened)
                file, kind = files[shard]
                file.seek(offset)
                payload = read_frame(file)
                if payload is None or len(payload) != n:
                    raise CorruptRecord(f"shard {shard} at {offset}")
                payload = np.frombuffer(payload, kind).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([payload], pa.binary())], ["doc_id", "ids"])
        for file, _ in files.values():
            file.close()
    return order.mapInArrow(read, "doc_id long, ids binary")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    out = workspace(spark, "token-records")
    manifest = write_token_records(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_records(manifest, out, ids=False)
