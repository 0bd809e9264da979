"""BPE and the token store against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from websheaf.llm import bpe, token_store
from websheaf.llm.storage import new_path

PATH = bpe.default_path()
PARTS = [" ", "  ", "\n", "'s", "'", "'ll", "l", "re", "a", "7", "é", "日本", "<|endoftext|>", "<|endof", "!", "aaaa", "z" * 40, " " * 30, "'" * 30, "՘", "\U0001f600", "\x85", "\x1f"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n, k, seed):
    r = random.Random(seed)
    return ["".join(r.choices(PARTS, k=r.randint(0, k))) for _ in range(n)]


def test_ids_are_the_library_s(library):
    encoder = bpe.Encoder(bpe.vocabulary(PATH))
    for t in texts(300, 60, 1):
        assert encoder.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_small_pieces_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 7)
    monkeypatch.setattr(bpe, "LONG_RUN", 40)
    encoder = bpe.Encoder(bpe.vocabulary(PATH))
    for t in texts(300, 60, 2):
        assert encoder.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_long_runs_keep_to_the_lookahead(library):
    vocab = bpe.vocabulary(PATH)
    r = random.Random(3)
    pieces = [b.decode() for b in vocab.bytes_of.values() if b.isalpha() and len(b) > 2]
    run = "".join(r.choices(pieces, k=6000))
    for t in (run, "a" * 30_000, " " * 30_000 + "x", "".join(r.choices("abcdefgh", k=30_000))):
        encoder, most, out = bpe.Encoder(vocab), 0, []
        for i in range(0, len(t), 5000):
            out += encoder.feed(t[i : i + 5000])
            most = max(most, len(encoder.carry) + (len(encoder.run.held) if encoder.run else 0))
        assert out + encoder.finish() == library.encode(t, add_special_tokens=False).ids
        assert most < 4 * vocab.lookahead + 512 + 2 * bpe.LONG_RUN + 5000


def test_decoding_in_parts(library):
    vocab = bpe.vocabulary(PATH)
    decoder = bpe.Decoder(vocab)
    for t in texts(200, 40, 4):
        ids = library.encode(t, add_special_tokens=False).ids
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == t
    odd = [i for i, b in vocab.bytes_of.items() if b in (b"\xe6", b"\xf0\x9f", b"\xff")]
    assert "".join(decoder.feed([i]) for i in odd) + decoder.finish() == library.decode(odd, skip_special_tokens=False)


def frame(spark):
    rows = list(enumerate(texts(120, 50, 5))) + [(500, None), (501, ""), (7, "again"), (None, "no id"), (900, "long text " * 20_000), (901, "long text " * 20_000)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_store_gives_back_every_document(spark, library):
    rows, docs = frame(spark)
    store = new_path(spark, "test-store")
    token_store.write_store(docs, store, PATH)
    found = token_store.document_digests(spark, store).collect()
    assert all(r.verified for r in found) and len(found) == len(rows)
    expected = {}
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
    for r in found:
        assert (r.n_tokens, r.ids_crc32) in [e[:2] for e in expected[r.doc_id]]
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.doc_id or -1 for r in ordered] == sorted(r.doc_id or -1 for r in found)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered]).tolist()[:-1]]
    whole = token_store.documents(spark, store).collect()
    assert all(r.ids in [e[2] for e in expected[r.doc_id]] for r in whole) and len(whole) == len(rows)
    keys = [bytes(r.key) for r in spark.read.parquet(f"{store}/chunks").select("key").collect()]
    uses = sum(len(r.chunk_ids) for r in spark.read.parquet(f"{store}/recipes").collect())
    assert len(keys) == len(set(keys)) < uses
    assert all(r.sound for r in token_store.verified_shards(spark, store).collect())


def two_documents(spark, name):
    store = new_path(spark, name)
    token_store.write_store(spark.createDataFrame([(1, "one text"), (2, "another text")], "doc_id long, text string"), store, PATH)
    return store


def replaced(spark, path, change, **partition):
    frame = spark.read.parquet(path)
    rows = change([r.asDict() for r in frame.collect()])
    writer = spark.createDataFrame(rows, frame.schema).write.mode("overwrite")
    (writer.partitionBy(partition["by"]) if partition else writer).parquet(path)


def test_a_damaged_chunk_is_seen(spark):
    store = two_documents(spark, "damaged-chunk")
    replaced(spark, f"{store}/chunks", lambda rows: [rows[0] | {"ids": bytes(rows[0]["ids"][:-1]) + b"\x07"}, *rows[1:]])
    assert False in {r.verified for r in token_store.document_digests(spark, store).collect()}


def test_a_damaged_manifest_and_a_lost_recipe_are_seen(spark):
    store = two_documents(spark, "damaged-manifest")
    replaced(spark, f"{store}/manifest", lambda rows: [rows[0] | {"root": b"\0" * 32}, *rows[1:]])
    assert False in {r.sound for r in token_store.verified_shards(spark, store).collect()}
    assert False in {r.verified for r in token_store.document_digests(spark, store).collect()}
    store = two_documents(spark, "lost-recipe")
    replaced(spark, f"{store}/recipes", lambda rows: sorted(rows, key=lambda r: r["doc_id"])[1:], by="shard")
    assert False in {r.sound for r in token_store.verified_shards(spark, store).collect()}


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    bpe.refuse_other_kinds(spec)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"byte_fallback": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.refuse_other_kinds(spec | change)


def test_empty_store(spark):
    store = new_path(spark, "empty-store")
    token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), store, PATH)
    assert token_store.document_digests(spark, store).count() == 0


def test_shifted_crcs_combine():
    r = random.Random(6)
    parts = [r.randbytes(r.randint(1, 5000)) for _ in range(20)]
    after = np.array([sum(map(len, parts[i + 1 :])) for i in range(20)])
    shares = token_store.shifted_crc(np.array([zlib.crc32(p) for p in parts]), after)
    assert int(np.bitwise_xor.reduce(shares)) == zlib.crc32(b"".join(parts))


def test_round_trip_digests(spark, library):
    import hashlib

    rows, docs = frame(spark)
    found = bpe.round_trip_digests(docs.withColumn("ids", docs.doc_id), PATH).collect()
    assert len(found) == len(rows)
    texts_of = {}
    for i, t in rows:
        texts_of.setdefault(i, []).append(t or "")
    for r in found:
        assert r.decoded_sha256 in [hashlib.sha256(t.encode()).hexdigest() for t in texts_of[r.doc_id]]
        assert r.ids_sha256 in [hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for t in texts_of[r.doc_id]]
    ids = bpe.encoded(docs, PATH)
    assert bpe.decoded(ids, PATH).filter("text is null").count() == 0


def test_round_trip_digests_hold_one_piece_at_a_time(spark):
    """Long texts in one batch: peak memory stays far under what their ids would take."""
    import tracemalloc

    import pyarrow as pa

    from websheaf.llm import bpe

    text = "The quick brown fox é jumps over 12345 lazy dogs. " * 20_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(8), pa.int64()), pa.array([text] * 7 + [None])], ["doc_id", "text"])
    list(bpe._round_trips(bpe.default_path(), iter([batch.slice(7)])))  # the vocabulary is loaded
    tracemalloc.start()
    found = next(iter(bpe._round_trips(bpe.default_path(), iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids = [x for part in bpe._encoded(bpe.default_path(), iter([batch])) for x in part["ids"]]
    assert found["n_tokens"].to_pylist() == [len(x) for x in ids] and found["n_tokens"][7].as_py() == 0
    assert peak < 6 * len(text) and peak < 40 * len(ids[0])
