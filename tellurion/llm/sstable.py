"""Operator 5: token ids as sorted-string-table shards.

A shard holds documents keyed by identifier, ascending: blocks of prefix-compressed entries (each block zstd-packed),
then a sparse index (first key, offset, size and entry count of each block), a Bloom filter over the keys and a footer
of fixed size. `Table.get` finds a document with one Bloom probe, one bisection and one block read.

    block   = zstd( (shared, unshared, value length as varints, key suffix, value)* )
    value   = ids as little-endian integers of the shard's width (2 or 4 bytes)
    footer  = index offset, index size, bloom offset, bloom size, entries, ids, width, magic
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, held, materialize, pieces, scratch, small_batches, texts
from .tokens import byte_chars

MAGIC, BLOCK_BYTES, PROBES, BITS_PER_KEY = b"TLRNSST1", 1 << 18, 7, 10
_FOOTER = struct.Struct("<QQQQQQQ8s")
#: Parts whose ids are kept per process, and their longest length; bounds of memory only.
MEMO_PARTS, MEMO_CHARS = 250_000, 40
#: Bytes that are cut into parts at once; a bound of memory only.
PIECE = 1 << 21
_FAMILY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Printable ASCII and the letters of Latin-1: already composed, and lower-cased one by one.
_EASY = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def _classes() -> np.ndarray:
    """Of each byte: 0 white space, 1 letter, 2 digit, 3 other printable ASCII, 4 anything else."""
    out = np.full(256, 4, np.uint8)
    out[33:127] = 3
    out[48:58] = 2
    out[[*range(65, 91), *range(97, 123)]] = 1
    out[[9, 10, 11, 12, 13, 32]] = 0
    return out


_CLASS = _classes()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def key_of(doc_id: int | None) -> bytes:
    """Keys order like ids, null first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Writes one shard; keys must come in ascending order, equal keys may repeat."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = _filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.path)
        self.width, self.block, self.index, self.keys = width, bytearray(), [], []
        self.first, self.previous, self.in_block, self.at, self.ids = b"", b"", 0, 0, 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.keys and key < self.previous:
            raise ValueError("keys must ascend")
        shared = len(os.path.commonprefix([key, self.previous])) if self.in_block else 0
        if not self.in_block:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.previous, self.in_block, self.ids = key, self.in_block + 1, self.ids + len(ids) // self.width
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.in_block:
            packed = zstandard.ZstdCompressor(level=1).compress(bytes(self.block))
            self.out.write(packed)
            self.index.append((self.first, self.at, len(packed), self.in_block))
            self.at += len(packed)
            self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQQ", at, size, n) for k, at, size, n in self.index)
        bits = max(64, len(self.keys) * BITS_PER_KEY + 7 & ~7)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_probes(key, bits)] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(packed)
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), len(self.keys), self.ids, self.width, MAGIC))
        self.out.close()


class Table:
    """Reads one shard."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        at, n, bloom_at, bloom_n, self.entries, self.ids, self.width, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no table of this format")
        raw, self.index, p = self.file.read_at(n, at), [], 0
        while p < len(raw):
            k, p = _read_varint(raw, p)
            self.index.append((raw[p : p + k], *struct.unpack_from("<QQQ", raw, p + k)))
            p += k + 24
        self.bloom = self.file.read_at(bloom_n, bloom_at)

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, n = self.index[k]
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(size, at))
        p, key = 0, b""
        for _ in range(n):
            shared, p = _read_varint(raw, p)
            rest, p = _read_varint(raw, p)
            size, p = _read_varint(raw, p)
            key = key[:shared] + raw[p : p + rest]
            p += rest
            yield key, raw[p : p + size]
            p += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self._block(k)

    def array(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document with this identifier, none if it isn't here."""
        key, bits = key_of(doc_id), len(self.bloom) * 8
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, bits)):
            return []
        k = max(0, bisect.bisect_left(self.index, (key,)) - 1)
        found = []
        while k < len(self.index) and self.index[k][0] <= key:
            found += [self.array(v) for name, v in self._block(k) if name == key]
            k += 1
        return found


class WordEncoder:
    """Ids under a tokenizer that drops white space. Texts are cut into parts by array operations over their bytes, equal parts
    of a batch meet once, and only parts that the memo lacks reach the tokenizer."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.tokenize, self.chars = self.tokenizer.model.tokenize, dict(enumerate(byte_chars()))
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Cutting into parts holds for this family only: lower-casing, the pattern above, whole words.
        text = open(path, encoding="utf-8").read()
        self.simple = '"Lowercase"' in text and json.dumps(_FAMILY)[1:-1] in text

    def _missing(self, parts: list[str]) -> list[bytes]:
        """Ids of parts: easy ones, their bytes as characters, by the tokenizer's model alone, others by all of it."""
        odd = [p for p in parts if not _EASY.fullmatch(p) or "<|" in p]
        found = dict(zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False))) if odd else {}
        pack, kind, out = struct.pack, self.kind[1:].replace("u2", "H").replace("u4", "I"), []
        for p in parts:
            if p in found:
                own = found[p].ids
            else:
                own = [t.id for t in self.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(self.chars))]
            out.append(pack(f"<{len(own)}{kind}", *own))
        return out

    def _ids(self, parts: list[str]) -> list[bytes]:
        memo, older = self.memo, self.older
        found = list(map(memo.get, parts))
        if None in found:
            lost = []
            for k, ids in enumerate(found):
                if ids is None:
                    if (old := older.get(parts[k])) is None:
                        lost.append(k)
                    else:
                        memo[parts[k]] = found[k] = old
            for k, ids in zip(lost, self._missing([parts[k] for k in lost])):
                found[k] = ids
                if len(parts[k]) <= MEMO_CHARS:
                    memo[parts[k]] = ids
            if len(memo) >= MEMO_PARTS:
                self.older, self.memo = memo, {}
        return found

    def encode_all(self, docs: list[str]) -> list[np.ndarray]:
        """Token ids of whole texts."""
        if not self.simple:
            return [np.array(got.ids, self.kind) for got in self.tokenizer.encode_batch_fast(docs, add_special_tokens=False)]
        raw = [d.encode() for d in docs]
        limits = np.cumsum([len(r) + 1 for r in raw])
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        flat, counts, at = [], np.zeros(len(docs), np.int64), 0
        while at < len(data):
            end = _white_end(data, at)
            lowered, starts = part_starts(data[at:end])
            offsets = np.append(starts, end - at).astype(np.int64)
            parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(lowered)).dictionary_encode()
            ids, n = gathered(self._ids(parts.dictionary.to_pylist()), parts.indices.to_numpy(), self.kind)
            flat.append(ids)
            counts += np.bincount(np.searchsorted(limits, starts + at, "right"), n, len(docs)).astype(np.int64)
            at = end
        return np.split(np.concatenate(flat), np.cumsum(counts)[:-1]) if flat else []


def _white_end(data: np.ndarray, at: int, most: int = PIECE) -> int:
    """The end of the longest run of whole words of about `most` bytes from `at` on."""
    end = at + most
    while end < len(data):
        gaps = np.flatnonzero(_CLASS[data[end - most : end]] == 0)
        if len(gaps):
            return end - most + int(gaps[-1]) + 1
        end += most
    return len(data)


def part_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, lower-cased, and where parts begin: runs of letters, single digits, runs of marks, the contractions of
    `_FAMILY`, white space; a word with other characters than `_EASY` or with '<|' is one part and keeps its case."""
    n = len(data)
    kind, after = _CLASS[data], np.append(data[1:], np.uint8(0))
    lead = (data == 0xC3) & (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
    tail = np.append(False, lead[:-1])
    kind[lead | tail] = 1
    begins = np.append(True, kind[1:] != kind[:-1]) | (kind == 2)
    quotes = np.flatnonzero((data == 39) & begins)
    if len(quotes):
        low = np.append(data, np.zeros(3, np.uint8)) | np.uint8(32)
        x, y = low[quotes + 1], low[quotes + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = ((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))
        cut = quotes[one | two]
        begins[cut + 1] = False
        ends = cut + np.where(one, 2, 3)[one | two]
        begins[ends[ends < n]] = True
    odd = np.flatnonzero((kind == 4) | ((data == 60) & (after == 124)))
    up = ((data >= 65) & (data <= 90)) | (tail & (data >= 0x80) & (data <= 0x9E))
    if len(odd):
        word = np.cumsum(np.append(True, (kind[1:] == 0) != (kind[:-1] == 0)))  # numbers of words and gaps
        hard = np.zeros(int(word[-1]) + 1, bool)
        hard[word[odd]] = True
        inside = hard[word]
        begins &= ~inside
        begins |= inside & np.append(True, word[1:] != word[:-1])
        up &= ~inside
    return data + (up * np.uint8(32)), np.flatnonzero(begins)


def encoder(path: str) -> WordEncoder:
    return held(("sstable", path), lambda: WordEncoder(path))


def write_shards(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2, shard_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append `end_id`, write the shards below `folder`; returns the manifest: shard, path, n_docs,
    n_ids, and `base`, the ids in all shards before it.

    Rows are dealt by ranges of (identifier, hash of the text, row number), so neither a null id nor one that a third of all rows
    repeat, with one text or many, gathers in a task; up to 20,000 tasks write a shard for each `shard_rows` documents or so. A
    null text encodes as the empty one. A null id sorts first; equal ids are neighbours, ordered by the hash of their text.
    Files are written once per attempt of a task and only the manifest's are read, so lost executors do no harm. Other
    columns are not read.
    """
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    tasks = min(20_000, max(1, -(-source.count() // shard_rows)))
    order = [F.asc_nulls_first("id"), F.asc("hash"), F.asc("row")]
    dealt = source.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    made = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, file, writer, uri = encoder(vocabulary), TaskContext.get().partitionId(), 0, None, ""
        end = np.array([end_id], own.kind).tobytes()

        def ended() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pylist([{"part": part, "file": file, "path": uri, "n_docs": len(writer.keys), "n_ids": writer.ids}], schema=made)

        for piece in pieces(batches):
            for doc_id, ids in zip(piece.column("id").to_pylist(), own.encode_all(texts(piece))):
                if writer and len(writer.keys) >= 2 * shard_rows:
                    yield ended()
                    file, writer = file + 1, None
                if writer is None:
                    uri = f"{folder}/shard-{part:06d}-{file:04d}-{uuid.uuid4().hex}.sst"
                    writer = Writer(uri, own.width)
                writer.add(key_of(doc_id), ids.tobytes() + end)
        if writer:
            yield ended()

    small_batches(spark=docs.sparkSession)
    written = dealt.select("id", "text").mapInArrow(write, "part int, file int, path string, n_docs long, n_ids long")
    every = Window.orderBy("part", "file")
    manifest = materialize(written, "manifest").withColumn("shard", F.row_number().over(every) - 1)
    return manifest.select("shard", "path", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it in all shards), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table, start, rows = Table(row["path"]), row["base"], []
                for key, value in table:
                    ids = table.array(value)
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    files = max(1, manifest.count())
    return manifest.select("shard", "path", "base").repartition(min(files, 20_000), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_ids: list[int | None]) -> DataFrame:
    """The ids of the stated documents: each shard's Bloom filter and index are searched, no shard is read whole."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                table = Table(path)
                rows = [{"doc_id": d, "ids": ids.tolist()} for d in doc_ids for ids in table.get(d)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.select("path").mapInArrow(run, "doc_id long, ids array<long>")


def roundtrip(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`write_shards` into the shared folder, then `read_shards`."""
    return read_shards(write_shards(docs, vocabulary, scratch(docs.sparkSession, "sst"), end_id, id_col=id_col, text_col=text_col))


def session_lookup(spark: SparkSession, manifest_path: str, doc_ids: list[int | None]) -> DataFrame:
    """`lookup` on a manifest that was written as Parquet."""
    return lookup(spark.read.parquet(manifest_path), doc_ids)
