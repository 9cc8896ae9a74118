"""Operator 6: byte-level BPE encoding and decoding by a sentencepiece model made from the ranks.

The model is serialised straight from the vocabulary: every token, its bytes mapped to printable characters, becomes a
normal piece with score -rank (sentencepiece merges the best score first, leftmost on ties, which is the order of the
ranks); normalisation is the identity. Texts are split into pre-tokens, each is encoded on its own, and ids are turned
back to bytes by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import gathered, held, map_batches, texts
from .tokens import byte_chars

#: Words whose ids are kept per process, and letters of the longest kept; bounds of memory only.
MEMO_WORDS, MEMO_CHARS = 120_000, 40
_ODD = re.compile(r"\s \s?| \s|\s\s")


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model; piece k is the token of rank k, the unknown piece comes last."""
    chars, pieces = byte_chars(), []
    for k, raw in enumerate(sorted(ranks, key=ranks.__getitem__)):
        if ranks[raw] != k:
            raise ValueError("ranks must be 0, 1, 2 and so on")
        pieces.append(_field(1, "".join([chars[b] for b in raw]).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -k) + _field(3, 1))
    pieces.append(_field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(pieces) - 1) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.table = dict(enumerate(byte_chars()))
        self.raw = sorted(self.ranks, key=self.ranks.__getitem__)
        self.decimal = [str(k) for k in range(len(self.raw))]
        self.split = regex.compile(pattern)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.long = 0  # letters of long pre-tokens among them

    def _pieces(self, wanted: list[str]) -> None:
        """Encode pre-tokens into the memo."""
        pack = struct.pack
        for k in range(0, len(wanted), 4096):
            group = wanted[k : k + 4096]
            mapped = [p.encode().decode("latin-1").translate(self.table) for p in group]
            for piece, ids in zip(group, self.model.encode(mapped, out_type=int, num_threads=1)):
                whole = self.ranks.get(piece.encode())
                self.long += len(piece) if len(piece) > MEMO_CHARS else 0
                self.pieces[piece] = pack(f"<{len(ids)}i", *ids) if whole is None else pack("<i", whole)

    def _parts(self, parts: list[str]) -> bytes:
        self._pieces([p for p in dict.fromkeys(parts) if p not in self.pieces])
        return b"".join([self.pieces[p] for p in parts])

    def _following(self, words: list[str]) -> list[bytes]:
        """Ids of words that follow a space, or begin with a line feed in place of it."""
        memo, older, split = self.words, self.older, self.split
        found: list[bytes | None] = list(map(memo.get, words))
        if None in found:
            missing: dict[int, list[str]] = {}
            for k, ids in enumerate(found):
                if ids is None:
                    w = words[k]
                    if (ids := older.get(w)) is not None:
                        memo[w] = found[k] = ids
                    else:
                        missing[k] = split.findall(w if w[:1] == "\n" else " " + w)
            pieces = self.pieces
            self._pieces([p for p in dict.fromkeys(p for parts in missing.values() for p in parts) if p not in pieces])
            for k, parts in missing.items():
                found[k] = ids = b"".join([pieces[p] for p in parts])
                if len(words[k]) <= MEMO_CHARS:
                    memo[words[k]] = ids
            if len(memo) >= MEMO_WORDS:
                self.older, self.words = memo, {}
        return found

    def encode_all(self, docs: list[str]) -> list[np.ndarray]:
        """Token ids of whole texts. Words that follow single spaces are pre-tokens whatever stands around them, so equal ones of
        a batch are encoded once; texts with other runs of white space are cut by the pattern itself."""
        if len(self.pieces) > MEMO_WORDS or self.long > MEMO_CHARS * 25_000:
            self.pieces.clear()
            self.long = 0
        out: list[np.ndarray | None] = [None] * len(docs)
        plain = []
        for k, text in enumerate(docs):
            if _ODD.search(text):
                out[k] = np.frombuffer(self._parts(self.split.findall(text)), "<i4")
            else:
                plain.append(k)
        if plain:
            lists = pc.split_pattern(pc.replace_substring(pa.array([docs[k] for k in plain], pa.large_string()), "\n", " \n"), " ")
            words, starts = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()[:-1]
            starts = starts - starts[0]
            code, unique = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
            cut = [self.split.findall(unique[c]) for c in code[starts].tolist()]
            self._pieces([p for p in dict.fromkeys(p for parts in cut for p in parts) if p not in self.pieces])
            first = [b"".join([self.pieces[p] for p in parts]) for parts in cut]
            known = self._following(unique) + first
            code[starts] = len(unique) + np.arange(len(first))
            ids, n = gathered(known, code, "<i4")
            for k, own in zip(plain, np.split(ids, np.cumsum(np.add.reduceat(n, starts))[:-1])):
                out[k] = own
        return out

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text."""
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids])


def codec(path: str, pattern: str) -> Codec:
    return held(("codec", path, pattern), lambda: Codec(path, pattern))


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id and `ids` array<int>. A null text encodes as the empty one, to an empty array; null and
    repeated ids are kept; other columns are not read, so their names cannot clash."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def kernel(batch: pa.RecordBatch) -> dict:
        found = codec(ranks, pattern).encode_all(texts(batch))
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        return {"id": batch.column("id"), "ids": pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), pa.array(flat.astype(np.int32)))}

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return map_batches(source, kernel, "id long, ids array<int>", schema, 256).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of `encode`: its id, n_tokens, ids_sha256 (of the decimal ids joined by a space), `bytes` (decoded) and
    decoded_sha256. A null or empty array decodes to no bytes."""
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("bytes", pa.binary()), ("decoded_sha256", pa.string())])

    def kernel(batch: pa.RecordBatch) -> dict:
        own, out = codec(ranks, pattern), {f.name: [] for f in schema}
        decimal = own.decimal
        for ids in batch.column("ids"):
            ids = (ids.values.to_numpy().tolist() if ids.is_valid else [])
            raw = own.decode(ids)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
            out["bytes"].append(raw)
            out["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
        return out | {"id": batch.column("id")}

    source = encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].alias("ids"))
    return map_batches(source, kernel, "id long, n_tokens long, ids_sha256 string, bytes binary, decoded_sha256 string", schema, 256).withColumnRenamed("id", id_col)
