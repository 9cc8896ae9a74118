"""Operators 1, 5 and 6 against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tellurion.llm import codec, sstable, tokens

from .conftest import TEXTS

JSON, RANKS, WORDS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
PARTS = [*"ab  \n\n\t'relvstmd 09$é日😀\x1c\x85ſΣİ", "<|endoftext|>", "'re", "   ", "the", "\r\n", "​"]


def words(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 24))) for _ in range(n)]


def test_every_prefix_is_exact():
    c, lib = tokens.PrefixCounter(JSON), Tokenizer.from_file(JSON)
    for text in words(250):
        table = c.table(text)
        assert len(table) == len(text.encode())
        for k in range(len(text) + 1):
            assert tokens.count_at(table, len(text[:k].encode())) == len(lib.encode(text[:k], add_special_tokens=False).ids), (text, k)


def test_truncation():
    c, lib = tokens.PrefixCounter(JSON), Tokenizer.from_file(JSON)
    for text in words(80, 1):
        for budget in (0, 1, 3, 7):
            cut = tokens.truncate(c.table(text), text.encode(), budget)
            best = max(len(text[:k].encode()) for k in range(len(text) + 1) if len(lib.encode(text[:k], add_special_tokens=False).ids) <= budget)
            assert cut == best


def test_windows():
    c, text = tokens.PrefixCounter(JSON), "It was a very long night. " * 40
    starts = tokens.window_starts(c.table(text), text.encode(), 50)
    assert starts[0] == 0 and len(starts) > 4 and starts == sorted(set(starts))


def test_counts_frame(awkward, nothing):
    lib = Tokenizer.from_file(JSON)
    found = tokens.prefix_counts(awkward, JSON).collect()
    assert len(found) == len(TEXTS)
    want = sorted((str(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in found) == want
    assert tokens.prefix_counts(nothing, JSON).count() == 0


def test_codec_like_tiktoken():
    own = codec.codec(RANKS, P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text in words(2000, 2):
        ids = own.encode(text).tolist()
        assert ids == ref.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_codec_frames(awkward, nothing):
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.read_ranks(RANKS), special_tokens={})
    out = codec.decode(codec.encode(awkward, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    want = sorted((str(i), hashlib.sha256(" ".join(map(str, ref.encode_ordinary(t or ""))).encode()).hexdigest(), (t or "").encode()) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.ids_sha256, bytes(r.bytes)) for r in out) == want
    assert codec.encode(nothing, RANKS, P.PATTERN).count() == 0


def test_word_encoder(monkeypatch):
    own, lib = sstable.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    odd = ["Don't!!'s 'Sound''ll x'RE 5's <|endoftext|>Y <|A|", "ÀÉß×÷ Ünï'dé H\u0331 e\u0301A\u0300", "a\xa0B\u2003c\x1fD\x7fe\x00F", "", "\n", "x" * 5000 + " " + "Ab9" * 3000]
    for size in (1 << 21, 7):
        monkeypatch.setattr(sstable._white_end, "__defaults__", (size,))
        texts = [*words(2000, 3), *odd]
        for text, ids in zip(texts, own.encode_all(texts)):
            assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids, text
    assert max(map(len, own.memo)) <= sstable.MEMO_CHARS and own.encode_all([]) == []


def test_repeated_ids_are_dealt_to_many_shards(spark):
    docs = spark.range(400).selectExpr("if(id % 3 = 0, id, null) doc_id", "if(id % 3 = 1, 'same text', concat('text ', id)) text")
    manifest = sstable.write_shards(docs, WORDS, sstable.scratch(spark, "t"), shard_rows=50).cache()
    assert manifest.agg({"n_docs": "sum"}).first()[0] == 400 and manifest.agg({"n_docs": "max"}).first()[0] < 120
    assert len(sstable.lookup(manifest, [None]).collect()) == 266


def test_table_file(tmp_path):
    uri = f"file://{tmp_path}/a/t.sst"
    w = sstable.Writer(uri, 2)
    keys = [None, -5, 0, 3, 3, *range(10, 9000, 7)]
    for k in keys:
        w.add(sstable.key_of(k), np.arange(abs(k or 0) % 300, dtype="<u2").tobytes())
    w.close()
    t = sstable.Table(uri)
    assert [sstable.id_of(k) for k, _ in t] == keys and t.entries == len(keys) and len(t.index) > 1
    assert len(t.get(3)) == 2 and len(t.get(-5)[0]) == 5 and len(t.get(None)) == 1 and t.get(4) == [] and len(t.get(3993)[0]) == 3993 % 300
    with pytest.raises(ValueError):
        sstable.Writer(f"file://{tmp_path}/b.sst", 2).add(b"b", b"") or w.add(b"\0", b"")


def test_shards_round_trip(spark, small):
    lib, start = Tokenizer.from_file(WORDS), 0
    manifest = sstable.write_shards(small, WORDS, sstable.scratch(spark, "t"), 2, shard_rows=37).cache()
    found = {r.doc_id: r for r in sstable.read_shards(manifest).collect()}
    assert manifest.count() > 3
    for r in small.orderBy("doc_id").collect():
        ids = [*lib.encode(r.text, add_special_tokens=False).ids, 2]
        assert (found[r.doc_id].start, found[r.doc_id].n_tokens, found[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.doc_id for r in sstable.lookup(manifest, [7, 10**9]).collect()] == [7]


def test_shards_of_awkward_rows(awkward, nothing):
    assert sorted(str(r.doc_id) for r in sstable.roundtrip(awkward, WORDS).collect()) == sorted(str(i) for i, _ in TEXTS)
    assert sstable.roundtrip(nothing, WORDS).count() == 0
