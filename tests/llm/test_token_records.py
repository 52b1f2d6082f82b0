"""Token records: exact round trip, ids equal to whole-text encoding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from docs_fixture import documents, frame
from tokenizers import Tokenizer

from rainfold.llm import token_records as tr
from rainfold.llm.common import workspace

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_encode_like_whole_texts():
    whole, pieces = Tokenizer.from_file(PATH), tr.PieceEncoder(PATH)
    r = random.Random(3)
    alphabet = list(" \n\t\x1c\x1d\x85\xa0  ab'sZ1!?é漢🙂\u180e\r    ") + ["<|endoftext|>"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(16))) for _ in range(4000)] + [d[1] or "" for d in documents()]
    ids, at = pieces.encode_batch(pa.array(texts))
    for i, t in enumerate(texts):
        assert whole.encode(t, add_special_tokens=False).ids == ids[at[i]:at[i + 1]].tolist(), repr(t[:80])


def test_cache_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(tr, "CACHE_PIECES", 64)
    whole, pieces = Tokenizer.from_file(PATH), tr.PieceEncoder(PATH)
    r = random.Random(9)
    for _ in range(12):
        texts = [" ".join(f"w{r.randrange(400)}" for _ in range(40)) for _ in range(5)]
        ids, at = pieces.encode_batch(pa.array(texts))
        for i, t in enumerate(texts):
            assert whole.encode(t, add_special_tokens=False).ids == ids[at[i]:at[i + 1]].tolist()


def _expected():
    whole = Tokenizer.from_file(PATH)
    rows = sorted(((d[0], d[1] or "") for d in documents()), key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1]))
    out, start = [], 0
    for doc, text in rows:
        ids = np.asarray(whole.encode(text, add_special_tokens=False).ids + [0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    return out


def test_round_trip_order_index_and_shuffle(spark):
    out = workspace(spark, "test-records")
    manifest = tr.write_token_records(frame(spark), out, PATH, shards=3)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in tr.read_token_records(manifest, out).collect()),
                 key=lambda x: x[1])
    assert got == _expected()
    index = tr.read_index(spark, manifest, out).collect()
    assert len(index) == len(got)
    a = [(r.doc_id, bytes(r.ids)) for r in tr.shuffled_records(spark, manifest, out, 1, 3).collect()]
    b = [(r.doc_id, bytes(r.ids)) for r in tr.shuffled_records(spark, manifest, out, 2, 3).collect()]
    whole = sorted(((d, ids) for d, *_, ids in got), key=repr)
    assert sorted(a, key=repr) == sorted(b, key=repr) == whole and a != b


def test_empty_table(spark):
    out = workspace(spark, "test-records")
    manifest = tr.write_token_records(frame(spark, []), out, PATH)
    assert tr.read_token_records(manifest, out).count() == 0


def test_damage_is_noticed(spark, tmp_path):
    manifest = tr.write_token_records(frame(spark, documents()[:4]), str(tmp_path / "r"), PATH, shards=1)
    shard = next((tmp_path / "r").glob("*.rec"))
    data = bytearray(shard.read_bytes())
    data[60] ^= 1
    shard.write_bytes(bytes(data))
    with pytest.raises(Exception, match="CorruptRecord"):
        tr.read_token_records(manifest, str(tmp_path / "r")).collect()


def test_cuts_change_no_ids(spark):
    """Symbols after letters, line ends, disputed letters, marks and white
    space of every kind: the ids of a plain encode."""
    texts = ["a\x01b c", "don't 'tis rest'rest it's\nthe\n\nThe  x.\n x", "é.ñ ñ,ß\xa0x. y z.", "", " lead", "trail ", "a\tb.c\td",
             "x\x85.y", " \n", "a\nb\nc\nd.", "<|endoftext|> a.b", "\x01", "\x01\n", "中文.字 ,a.", "漢字\nx\n漢", "é.x ͣ.y", "a1.b 2,c\r\n.d",
             "w" * 5000 + "." + "w" * 100, "x \n y.z", "\n", "a.\n", ".\na", "a \nb", "a\n b"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = tr.PieceEncoder(path).tokenizer
    encoder = tr.PieceEncoder(path)
    for _ in range(2):      # learnt, then from the cache
        ids, at = encoder.encode_batch(pa.array(texts))
        for text, i, j in zip(texts, at[:-1], at[1:]):
            assert list(ids[i:j]) == plain.encode(text, add_special_tokens=False).ids, text


def test_small_cache_forgets_and_learns_again(spark, monkeypatch):
    monkeypatch.setattr(tr, "CACHE_PIECES", 20)
    encoder = tr.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(6):
        text = " ".join(f"word{i} the." for i in range(k * 10, k * 10 + 30))
        ids, _ = encoder.encode_batch(pa.array([text]))
        assert list(ids) == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.new) + len(encoder.old) < 200


def test_one_id_for_all_rows_is_split(spark, tmp_path):
    """Equal and null ids are dealt over shards; the files stay in order."""
    rows = [(None, f"text {i}") for i in range(300)] + [(7, "same")] * 300 + [(7, f"other {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(5)
    out = str(tmp_path / "r")
    manifest = tr.write_token_records(df, out, public_tokenizers.path("byte_bpe_50k.json"), shards=8)
    counts = [r.n_records for r in manifest.collect()]
    assert sum(counts) == 700 and max(counts) < 200
    got = tr.read_token_records(manifest, out).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 300 + [7] * 400
    assert len({r.ids_crc32 for r in got[300:]}) == 101


def test_a_workers_memory_is_bounded(spark):
    """Many distinct pieces: the cache stays a few MB, and what a chunk takes
    besides is given back."""
    encoder = tr.PieceEncoder(PATH)
    r = random.Random(5)
    for _ in range(4):
        encoder.encode_batch(pa.array([" ".join(f"{r.randrange(1 << 40):x}" for _ in range(60_000))]))
    kept = [encoder.new, encoder.new_ids, encoder.old, encoder.old_ids]
    pieces = len(encoder.new) + len(encoder.old)
    assert 200_000 < pieces < 2 * tr.CACHE_PIECES and sum(a.nbytes for a in kept) < 50 * pieces


def test_writing_gets_small_batches(spark, tmp_path, monkeypatch):
    """Arrow batches of a writing task are bounded by a few bytes, not by
    10,000 rows or 64 MB; the session's settings are as before."""
    sizes = tmp_path / "sizes"
    plain = tr.chunks

    def noted(batches, *args, **kw):
        def seen():
            for b in batches:
                with sizes.open("a") as f:
                    f.write(f"{b.nbytes}\n")
                yield b
        return plain(seen(), *args, **kw)

    monkeypatch.setattr(tr, "chunks", noted)
    monkeypatch.setattr(tr, "BATCH_BYTES", 1 << 16, raising=False)
    keys = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(key, None) for key in keys]
    df = spark.range(2000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 20) AS text")
    out = str(tmp_path / "r")
    manifest = tr.write_token_records(df, out, PATH, shards=1)
    assert [spark.conf.get(key, None) for key in keys] == before
    assert tr.read_token_records(manifest, out).count() == 2000
    found = [int(x) for x in sizes.read_text().split()]
    assert len(found) > 3 and max(found) < 2 << 16
