"""Operator 8: language identification of mixed text.

Script ranges narrow each word's candidates to the languages written in its script; every word gets a score per
candidate from character 1- to 4-grams; and Viterbi with a penalty for switching labels spans of words. The
document's language is the one that most of its letters are labelled with.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, held, map_batches

#: Documents per language a model is fitted on at most (about; those with the smallest hashes of their id).
MAX_DOCS = 1500
BUCKETS, ORDERS, PENALTY, MEMO_WORDS = 1 << 16, 4, 6.0, 200_000
#: Words whose n-grams are computed at once, and letters of words that a memo may hold; bounds of memory only.
WORDS, MEMO_LETTERS = 16_384, 6_000_000
#: A letter with the letters and marks that follow it; joiners inside words belong to them too.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}\u200c\u200d]*")
#: The same for texts below the first combining mark.
_MARKED = re.compile("[\u0300-\U0010ffff]")
_LOW_WORD = re.compile("[" + "".join(chr(c) for c in range(0x300) if unicodedata.category(chr(c))[0] == "L") + "]+")
#: First code points of script ranges and the script's number from there on (0: common or Latin extensions' gaps).
_SCRIPTS = [(0x0, 1), (0x250, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x900, 7), (0x980, 8), (0xA00, 9), (0xA80, 10), (0xB00, 11), (0xB80, 12), (0xC00, 13), (0xC80, 14), (0xD00, 15), (0xE00, 16), (0xE80, 17), (0x1000, 18), (0x10A0, 19), (0x1100, 20), (0x1200, 21), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 22), (0x30A0, 23), (0x3100, 0), (0x3400, 24), (0xA000, 0), (0xAC00, 20), (0xD7B0, 0), (0xF900, 24), (0xFB00, 0)]
_AT, _NUMBER = np.array([a for a, _ in _SCRIPTS]), np.array([n for _, n in _SCRIPTS])
SCRIPTS = 25


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character n-grams of the words with boundary marks: (bucket of each gram, first gram of each word), and the script
    of each word's first letter and its letters."""
    lowered = [w.lower() for w in words]
    codes = np.frombuffer(("^" + "^".join(lowered) + "^").encode("utf-32-le"), np.uint32).astype(np.uint64)
    marks = np.flatnonzero(codes == 94)
    owner = np.searchsorted(marks, np.arange(len(codes)), "right") - 1
    found, of = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, ORDERS + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        # A gram may start at a mark, and end at the next one, but not go past it.
        start = np.arange(len(h))
        word = owner[start]
        last = np.append(marks, len(codes))[word + 1]
        good = (start + n - 1 <= last) & (word < len(words)) & ((n > 1) | (codes[start] != 94))
        x = h[good]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((x >> np.uint64(48)).astype(np.int64) % BUCKETS)
        of.append(word[good])
    bucket, of = np.concatenate(found), np.concatenate(of)
    by = np.argsort(of, kind="stable")
    first = codes[marks[:-1] + 1].astype(np.int64)
    return bucket[by], np.searchsorted(of[by], np.arange(len(words))), _NUMBER[np.searchsorted(_AT, first, "right") - 1], np.array([len(w) for w in words])


def words_of(text: str | None) -> list[str]:
    """Words: runs of letters with their combining marks; empty if the text has no letter."""
    if not text:
        return []
    return (_WORD if _MARKED.search(text) else _LOW_WORD).findall(text)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (languages, BUCKETS) log-probabilities, less their mean over languages
    scripts: np.ndarray  # (languages, SCRIPTS) booleans
    penalty: float = PENALTY
    key: bytes = b""
    index: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None
    letters: np.ndarray | None = None
    learned: np.ndarray | None = None  # whether a word's script is one of a language
    held_letters: int = 0

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        bucket, firsts, script, letters = _grams(words)
        n = len(self.langs)
        score = np.stack([np.add.reduceat(self.table[k][bucket], firsts) for k in range(n)], 1) / ORDERS
        allowed = self.scripts[:, script].T
        score = np.where(allowed | ~allowed.any(1, keepdims=True), score, score.min() - 20).astype(np.float32)
        at = len(self.index)
        if self.scores is None or at + len(words) > len(self.scores):
            grown = np.zeros((max(4096, 2 * (at + len(words))), n), np.float32)
            sized, learned = np.zeros(len(grown), np.int32), np.zeros(len(grown), bool)
            if at:
                grown[:at], sized[:at], learned[:at] = self.scores[:at], self.letters[:at], self.learned[:at]
            self.scores, self.letters, self.learned = grown, sized, learned
        new = slice(at, at + len(words))
        self.scores[new], self.letters[new], self.learned[new] = score, letters, allowed.any(1)
        self.index.update(zip(words, range(at, at + len(words))))
        self.held_letters += int(letters.sum())

    def label(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Language number of each word of each document."""
        if len(self.index) > MEMO_WORDS or self.held_letters > MEMO_LETTERS:
            self.index.clear()
            self.scores, self.held_letters = None, 0
        known = self.index
        new = list(dict.fromkeys(w for words in docs for w in words if w not in known))
        for k in range(0, len(new), WORDS):
            self._learn(new[k : k + WORDS])
        self.ids = [np.array([known[w] for w in words], np.int64) for words in docs]
        out: list[np.ndarray] = []
        hard = []
        for d, at in enumerate(self.ids):
            if not len(at):
                out.append(np.zeros(0, np.int64))
                continue
            s = self.scores[at].astype(np.float64)
            best = int(s.sum(0).argmax())
            gain = np.cumsum(s - s[:, best : best + 1], axis=0)
            low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
            low[1:] = low[:-1].copy()
            low[0] = 0
            # No stretch gains another language as much as half a switch: the constant labelling is the best path.
            if (gain - low).max() <= self.penalty / 2:
                out.append(np.full(len(at), best))
            else:
                out.append(at)
                hard.append(d)
        for d, path in zip(hard, self._viterbi([self.ids[d] for d in hard])):
            out[d] = path
        return out

    def _viterbi(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """Best paths; documents advance together, longest first."""
        if not docs:
            return []
        n, counts = len(self.langs), np.array([len(d) for d in docs])
        by = np.argsort(-counts, kind="stable")
        more = np.searchsorted(-counts[by], -np.arange(counts.max()), "left")
        firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])[by]
        flat = self.scores[np.concatenate(docs)].astype(np.float64)
        back = np.zeros((len(flat), n), np.int16)
        final = np.zeros((len(docs), n))
        state = flat[firsts]
        final[:] = state
        own = np.arange(n, dtype=np.int16)
        for t in range(1, len(more)):
            k = more[t]
            state = state[:k]
            top = state.argmax(1)
            jump = state[np.arange(k), top] - self.penalty
            stay = state >= jump[:, None]
            at = firsts[:k] + t
            back[at] = np.where(stay, own, top[:, None].astype(np.int16))
            state = np.where(stay, state, jump[:, None]) + flat[at]
            final[:k] = state
        paths: list[np.ndarray] = [np.zeros(0, np.int64)] * len(docs)
        label = np.zeros(len(flat), np.int64)
        now = final.argmax(1)
        for t in range(len(more) - 1, -1, -1):
            k = more[t]
            at = firsts[:k] + t
            label[at] = now[:k]
            now[:k] = back[at, now[:k]]
        for k, d in enumerate(by):
            paths[d] = label[firsts[k] : firsts[k] + counts[d]]
        return paths

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]], float]]:
        """(language, share of the letters labelled with it, spans as (language, first word, end), share of the letters in scripts of
        learned languages); ('und', 0, [], 0) without letters."""
        docs = [words_of(t) for t in texts]
        out = []
        for words, path, ids in zip(docs, self.label(docs), self.ids) if self.langs else zip(docs, docs, docs):
            if not words or not self.langs:
                out.append(("und", 0.0, [], 0.0))
                continue
            share, known = np.bincount(path, self.letters[ids], len(self.langs)), self.letters[ids][self.learned[ids]].sum()
            best = int(share.argmax())
            cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
            out.append((self.langs[best], float(share[best] / share.sum()), [(self.langs[int(path[a])], a, b) for a, b in zip(cuts, cuts[1:])], float(known / share.sum())))
        return out


def fit_model(counts: dict[str, np.ndarray], scripts: dict[str, np.ndarray], penalty: float = PENALTY) -> Model:
    """From gram counts and letters by script of each language, up to 32,767 of them."""
    langs = sorted(counts)
    if len(langs) > 32_767:
        raise ValueError("too many languages")
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, SCRIPTS), bool), penalty)
    table = np.stack([np.log((counts[k] + 0.5) / (counts[k].sum() + 0.5 * BUCKETS)) for k in langs])
    table = (table - table.mean(0)).astype(np.float32)
    own = np.stack([scripts[k] / max(1, scripts[k].sum()) for k in langs]) >= 0.005
    return Model(langs, table, own, penalty, hashlib.sha256(table.tobytes() + own.tobytes() + repr(penalty).encode()).digest())


def train(docs: DataFrame, max_docs: int = MAX_DOCS, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about `max_docs` documents of each language, those with the smallest hashes of their id; null languages, ids and
    texts do not count. Executors sum gram counts, so the driver gets one row per language and filled bucket."""
    named = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where("id is not null and lang is not null and text is not null")
    rates = {r["lang"]: min(1.0, max_docs / r["count"]) for r in named.groupBy("lang").count().collect()}
    if not rates:
        return fit_model({}, {}, penalty)
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("lang")]
    sample = named.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < rate * 1_000_000).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def kernel(batch: pa.RecordBatch) -> dict:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by.setdefault(lang, []).extend(words_of(text))
        langs, buckets, counts = [], [], []
        for lang, words in by.items():
            n = np.zeros(BUCKETS + SCRIPTS, np.int64)
            for k in range(0, len(words), WORDS):
                bucket, _, script, letters = _grams(words[k : k + WORDS])
                n += np.concatenate([np.bincount(bucket, minlength=BUCKETS), np.bincount(script, letters, SCRIPTS).astype(np.int64)])
            full = np.flatnonzero(n)
            langs += [lang] * len(full)
            buckets += full.tolist()
            counts += n[full].tolist()
        return {"lang": langs, "bucket": buckets, "n": counts}

    summed = map_batches(sample, kernel, "lang string, bucket int, n long", schema, 4096).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts, scripts = {}, {}
    for r in summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("own")).collect():
        dense = np.zeros(BUCKETS + SCRIPTS)
        dense[[x["bucket"] for x in r["own"]]] = [x["n"] for x in r["own"]]
        counts[r["lang"]], scripts[r["lang"]] = dense[:BUCKETS], dense[BUCKETS:]
    return fit_model(counts, scripts, penalty)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, lang_pred, score (share of letters in that language), spans (array of lang, first word, end).

    'und' with score 0 where the text is null or has no letter. Null and repeated ids are kept; other columns are not read."""
    span = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def kernel(batch: pa.RecordBatch) -> dict:
        found = _own(model).predict(batch.column("text").to_pylist())
        return {"id": batch.column("id"), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "spans": [[{"lang": a, "start": b, "end": c} for a, b, c in x[2]] for x in found]}

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return map_batches(source, kernel, "id long, lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>", schema, 256).withColumnRenamed("id", id_col)


def _own(model: Model) -> Model:
    """One copy of a model per process, so that its memo of words lasts over tasks."""
    return held(("langid", model.key, *model.langs), lambda: model)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.55, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, of whose letters one language has the share `least` or more; letters of words in a script
    that no learned language uses count for none. No shuffle."""

    def keep(own: list[str]) -> list[bool]:
        return [lang != "und" and score * known >= least for lang, score, _, known in _own(model).predict(own)]

    return filter_rows(docs, keep, text_col)
