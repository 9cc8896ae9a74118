"""Operator 1: exact token counts of every prefix by prefix dynamic programming.

Byte-level BPE encodings have one structure that makes prefix counts cheap: a token sequence is the encoding of its
bytes exactly if every adjacent pair of it encodes to itself. So the last token of each prefix of a word follows from
shorter prefixes, and one left-to-right pass fills the count of every prefix. Tables of words are kept per process
(their number is bounded; emptying them never changes a result).

The table of a document holds one signed byte per UTF-8 byte of the text: what the exact token count of
the prefix changes by. `count_at`, `truncate` and `window_starts` answer questions about budgets from
the table alone, without encoding again.
"""

from __future__ import annotations

import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import held, map_batches, texts

#: Words whose tables are kept per process, pairs of tokens, and letters of the longest word kept; bounds of memory only.
MEMO_WORDS, PAIRS, MEMO_CHARS = 300_000, 1_000_000, 40
_ODD = regex.compile(r"\s \s?| \s|\s\s")
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b], extra = chr(256 + extra), extra + 1
    return [out[b] for b in range(256)]


class PrefixCounter:
    """Prefix tables under a byte-level BPE of the tokenizers library, given by its JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.chars = byte_chars()
        back = {c: b for b, c in enumerate(self.chars)}
        added = set(self.specials)
        self.vocab = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.bytes_of = {i: b for b, i in self.vocab.items()}
        self.tokenize = self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.endings = ahocorasick.Automaton()
        for raw, i in self.vocab.items():
            self.endings.add_word(raw.decode("latin-1"), (i, len(raw)))
        self.endings.make_automaton()

    def pair_stays(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes encode to these two tokens."""
        joined = self.bytes_of[left] + self.bytes_of[right]
        got = [t.id for t in self.tokenize("".join([self.chars[b] for b in joined]))]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 20 | right] = got == [left, right]
        return known

    def _piece(self, piece: bytes) -> bytes:
        """Changes of the count along one pre-token, by dynamic programming on its prefixes.

        The automaton yields, for each end, the tokens that end there, longest first; the one that stays
        a token after the last token of what precedes it is the last token of the prefix.
        """
        pairs, stays = self.pairs, self.pair_stays
        last, count, end = [0], [0], -1
        for at, (token, size) in self.endings.iter(piece.decode("latin-1")):
            if at != end:
                start = at + 1 - size
                if start:
                    key = last[start] << 20 | token
                    good = pairs.get(key)
                    if not (stays(last[start], token) if good is None else good):
                        continue
                end = at
                last.append(token)
                count.append(count[start] + 1)
        if len(last) <= len(piece):
            raise ValueError("the vocabulary lacks a byte")
        return bytes([(y - x) & 255 for x, y in zip(count, count[1:])])

    def _pretoken(self, piece: str) -> bytes:
        if piece in ("'re", "'ve", "'ll"):  # cut short, these are two pre-tokens
            whole = sum(self._signed(self._piece(piece.encode())))
            return bytes([1, 1, (whole - 2) & 255])
        return self._piece(piece.encode())

    @staticmethod
    def _signed(table: bytes) -> list[int]:
        return [b - 256 if b > 127 else b for b in table]

    def _ordinary(self, text: str) -> bytes:
        """Table of a text without special tokens, for any white space."""
        out, found = [], _SPLIT.findall(text)
        for k, piece in enumerate(found):
            table = self._pretoken(piece)
            if k and found[k - 1].isspace() and piece[0].isspace():
                # Cut after this character, it belongs to the run of white space before it.
                run, size = found[k - 1] + piece[0], len(piece[0].encode())
                longer = sum(self._signed(self._piece(run.encode()))) - sum(self._signed(self._piece(found[k - 1].encode())))
                steps = self._signed(table)
                head, total = steps[:size], sum(steps[:size])
                table = bytes([x & 255 for x in [*[0] * (len(head) - 1), longer]]) + (bytes([(steps[size] + total - longer) & 255]) + table[size + 1 :] if len(table) > size else b"")
                if len(steps) == size and longer != total:
                    out.append(table)
                    out.append(("debt", total - longer))
                    continue
            out.append(table)
        tables, debt = [], 0
        for item in out:
            if isinstance(item, tuple):
                debt += item[1]
            elif debt and item:
                first = item[0] - 256 if item[0] > 127 else item[0]
                tables.append(bytes([(first + debt) & 255]) + item[1:])
                debt = 0
            else:
                tables.append(item)
        return b"".join(tables)

    def _n(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _with_specials(self, text: str) -> bytes:
        """Table of a text that holds special strings; those count as one token once whole."""
        out, pattern, at, done = [], regex.compile("|".join(map(regex.escape, self.specials))), 0, 0
        for m in pattern.finditer(text):
            before, mark = text[at : m.start()], m[0]
            out.append(self._ordinary(before))
            total = sum(self._signed(out[-1]))
            for k in range(1, len(mark) + 1):
                now = self._n(before + mark[:k]) if k < len(mark) else self._n(before) + 1
                out.append(bytes([*[0] * (len(mark[k - 1].encode()) - 1), (now - total) & 255]))
                total = now
            at = m.end()
        out.append(self._ordinary(text[at:]))
        return b"".join(out)

    def table(self, text: str) -> bytes:
        """One signed byte per UTF-8 byte of `text`; their running sum is the token count of each prefix."""
        if any(s in text for s in self.specials):
            return self._with_specials(text)
        if _ODD.search(text):
            return self._ordinary(text)
        words = text.replace("\n", " \n").split(" ")
        first, memo = words[0], self.words
        tables = [memo.get(w) for w in words[1:]]
        if None in tables:
            older, pieces = self.older, self.pieces
            for k, table in enumerate(tables):
                if table is None:
                    w = words[k + 1]
                    table = memo.get(w) or older.get(w)
                    if table is None:
                        parts = []
                        for piece in _SPLIT.findall(w if w[:1] == "\n" else " " + w):
                            part = pieces.get(piece)
                            if part is None:
                                part = self._pretoken(piece)
                                if len(piece) <= MEMO_CHARS:
                                    pieces[piece] = part
                            parts.append(part)
                        table = b"".join(parts)
                    tables[k] = table
                    if len(w) <= MEMO_CHARS:
                        memo[w] = table
            if len(memo) >= MEMO_WORDS:
                self.older, self.words = memo, {}
            if len(pieces) >= MEMO_WORDS:
                pieces.clear()
        return self._ordinary(first) + b"".join(tables)


def count_at(table: bytes, prefix_bytes: int) -> int:
    """Exact tokens of the prefix with so many UTF-8 bytes (a character boundary)."""
    return int(np.frombuffer(table, np.int8)[:prefix_bytes].sum(dtype=np.int64))


def truncate(table: bytes, text_bytes: bytes, budget: int) -> int:
    """Bytes of the longest prefix, at a character boundary, with at most `budget` tokens."""
    counts = np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)
    raw = np.frombuffer(text_bytes, np.uint8)
    starts = np.append((raw[1:] & 0xC0) != 0x80, True) if len(raw) else np.zeros(0, bool)
    fits = np.flatnonzero(starts & (counts <= budget))
    return int(fits[-1]) + 1 if len(fits) and budget >= 0 else 0


def window_starts(table: bytes, text_bytes: bytes, budget: int) -> list[int]:
    """Byte offsets that cut a text into consecutive windows of at most `budget` tokens by the table's counts."""
    counts = np.concatenate([[0], np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)])
    raw, out, at = np.frombuffer(text_bytes, np.uint8), [], 0
    while at < len(raw):
        out.append(at)
        ends = np.flatnonzero(counts[at:] - counts[at] <= budget) + at
        end = int(ends[-1])
        while end > at and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        at = max(end, at + 1)
    return out


def counter(path: str) -> PrefixCounter:
    return held(("tokens", path), lambda: PrefixCounter(path))


def prefix_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, n_bytes, n_tokens, limit_bytes (longest prefix within `limit` tokens), prefix_table.

    A null text is the empty one: no bytes, no tokens, an empty table. Null or repeated ids are kept, one row each;
    other columns of `docs` are not read, so their names cannot clash.
    """
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("limit_bytes", pa.int64()), ("prefix_table", pa.binary())])

    def kernel(batch: pa.RecordBatch) -> dict:
        count, tables, sizes, totals, fits = counter(vocabulary), [], [], [], []
        for text in texts(batch):
            table = count.table(text)
            total = int(np.frombuffer(table, np.int8).sum(dtype=np.int64))
            tables.append(table)
            sizes.append(len(table))
            totals.append(total)
            fits.append(len(table) if total <= limit else truncate(table, text.encode(), limit))
        return {"id": batch.column("id"), "n_bytes": sizes, "n_tokens": totals, "limit_bytes": fits, "prefix_table": tables}

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    out = map_batches(source, kernel, "id long, n_bytes long, n_tokens long, limit_bytes long, prefix_table binary", schema, 256)
    return out.withColumnRenamed("id", id_col)
