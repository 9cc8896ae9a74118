"""Operator 10: benchmark decontamination by a BM25 index of the test items and block-max WAND.

The test items are indexed, in blocks of `ITEMS` items so that what goes to executors is bounded: postings per term with
BM25 impacts divided by the item's own best score (so 1 means all of an item's terms), their maximum, and maxima of blocks of
postings. Every passage of every training text, overlapping word windows that hold any run as long as the longest item
whole, is a query: windows whose terms' maxima stay under the threshold are skipped at once, the others run
block-max WAND, and every item above the threshold comes back. A hit is confirmed by the share of the item's 5-word shingles that the passage
holds, in the question's part and in the answer's part each; an item of one text is one part. Document frequencies, the mean
length and the window size are those of all items, however many passes they take.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neardup
from .common import filter_rows, map_batches, materialize, texts
from .neardup import _mix

ITEMS, BYTES, BLOCK, RANGES, K1, B = 20_000, 32 << 20, 32, 64, 1.2, 0.75


def _lut() -> tuple[np.ndarray, np.ndarray]:
    value = _mix(np.arange(256, dtype=np.uint64) + np.uint64(0xABCDEF))
    part = np.ones(256, bool)
    part[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
    value[part] = 0
    return value, part


_VALUE, _PART = _lut()


def word_hashes(text_bytes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of each word: runs of ASCII letters, digits and non-ASCII bytes of lower-cased text."""
    return neardup.word_hashes(np.frombuffer(text_bytes, np.uint8), (_VALUE, _PART))


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words (all words as one if fewer)."""
    n = min(n, len(words))
    seq = np.zeros(max(0, len(words) - n + 1) if n else 0, np.uint64)
    for k in range(n):
        seq = _mix(seq * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(seq)] + np.uint64(k + 1))
    return seq


class Index:
    """Impact-scored postings of test items. `items` are (id, question, answer); an item without words is left out. `known` has the
    statistics of a larger set that the items are of: items, mean words, most words, and frequencies by term."""

    def __init__(self, items: list[tuple[int, str, str]], shingle: int = 5, known: tuple[int, float, int, dict[int, int]] | None = None):
        parsed = []
        for item, question, answer in items:
            q, a = (word_hashes(x.lower().encode())[2] for x in (question, answer))
            if len(q) + len(a):
                parsed.append((item, q, a))
        self.items = [p[0] for p in parsed]
        self.parts = [tuple(np.unique(_shingles(x, shingle)) for x in (q, a) if len(x)) for _, q, a in parsed]
        self.sizes = [tuple(min(shingle, len(x)) for x in (q, a) if len(x)) for _, q, a in parsed]
        every = [np.concatenate([q, a]) for _, q, a in parsed]
        tf = [np.unique(words, return_counts=True) for words in every]
        if known is None:
            df: dict[int, int] = {}
            for own, _ in tf:
                for t in own.tolist():
                    df[t] = df.get(t, 0) + 1
            known = len(every), sum(map(len, every)) / max(1, len(every)), max(map(len, every), default=1), df
        n, mean, self.longest, df = known
        post: dict[int, list[tuple[int, float]]] = {}
        for k, (own, count) in enumerate(tf):
            norm = K1 * (1 - B + B * len(every[k]) / mean)
            impact = [log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in zip(own.tolist(), count.tolist())]
            best = sum(impact)
            for t, x in zip(own.tolist(), impact):
                post.setdefault(t, []).append((k, x / best))
        self.terms = np.array(sorted(post), np.uint64)
        self.post = [([k for k, _ in post[t]], [x for _, x in post[t]]) for t in self.terms.tolist()]
        self.blocks = [[(own[min(i + BLOCK, len(own)) - 1], max(x[i : i + BLOCK])) for i in range(0, len(own), BLOCK)] for own, x in self.post]
        self.most = np.array([max(x) for _, x in self.post] + [0.0])
        # Maxima of each term over ranges of items; they bound many passages at once before any is searched.
        self.ranges = np.zeros((len(self.post), RANGES), np.float32)
        wide = max(1, -(-len(every) // RANGES))
        for t, (own, x) in enumerate(self.post):
            np.maximum.at(self.ranges[t], np.array(own) // wide, np.array(x, np.float32))

    def wand(self, terms: list[int], theta: float) -> list[tuple[int, float]]:
        """All items whose score for the distinct `terms` is `theta` or more, by block-max WAND."""
        post, blocks, most, found = self.post, self.blocks, self.most, []
        end = len(self.items)
        cursors = [[post[t][0][0], 0, t] for t in terms]  # item, position, term
        while True:
            cursors = [c for c in cursors if c[0] < end]
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += most[c[2]]
                if bound >= theta - 1e-12:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, after = 0.0, end if pivot + 1 == len(cursors) else cursors[pivot + 1][0]
            for c in cursors[: pivot + 1]:
                last, peak = next(b for b in blocks[c[2]][c[1] // BLOCK :] if b[0] >= item) if blocks[c[2]][-1][0] >= item else (end, 0.0)
                bound += peak
                after = min(after, last + 1)
            if bound < theta - 1e-12:
                target = max(after, item + 1)  # no item in these blocks can reach theta
                moving = cursors[: pivot + 1]
            elif cursors[0][0] == item:
                score = sum(post[c[2]][1][c[1]] for c in cursors[: pivot + 1])
                if score >= theta - 1e-12:
                    found.append((item, score))
                target, moving = item + 1, cursors[: pivot + 1]
            else:
                target, moving = item, [c for c in cursors[:pivot] if c[0] < item]
            for c in moving:
                own, at = post[c[2]][0], c[1]
                while at < len(own) and own[at] < target:
                    at += 1
                c[0], c[1] = (own[at] if at < len(own) else end), at

    def search(self, docs: list[str], theta: float, overlap: float) -> list[list[tuple[int, float, float, int, int]]]:
        """Per text its confirmed hits: (item id, score, least overlap of question and answer, first byte, end) of the passage in
        the lower-cased text, the best passage of each item."""
        out: list[list[tuple[int, float, float, int, int]]] = [[] for _ in docs]
        if not self.items or not docs:
            return out
        raw = [d.lower().encode() for d in docs]
        starts, ends, words = word_hashes(b" ".join([*raw, b""]))
        if not len(words):
            return out
        offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
        limits = np.searchsorted(starts, offsets)
        at = np.searchsorted(self.terms, words)
        at[at == len(self.terms)] = 0
        term = np.where(self.terms[at] == words, at, len(self.terms))
        half, bests = max(32, self.longest), {}
        count = np.maximum(1, -(-np.diff(limits) // half))  # of half windows in each text
        first = np.concatenate([[0], np.cumsum(count)])
        begin = np.repeat(limits[:-1], count) + (np.arange(first[-1]) - np.repeat(first[:-1], count)) * half
        # Where each known word's half window begins and the one before it, and where the text had the word last.
        known = np.flatnonzero(term < len(self.terms))
        own = np.searchsorted(begin, known, "right") - 1
        doc = np.searchsorted(first, own, "right") - 1
        key = doc * (len(self.terms) + 1) + term[known]
        by = np.argsort(key, kind="stable")
        last = np.full(len(known), -1)
        same = key[by][1:] == key[by][:-1]
        last[by[1:][same]] = known[by[:-1][same]]
        sums = []
        for back in (0, 1):  # as the first half of a window, and as the second
            edge = begin[np.maximum(own - back, first[doc])]
            new = last < edge
            total = np.zeros((len(begin), RANGES), np.float32)
            cuts, of = known[new], own[new]
            if len(cuts):
                heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                total[of[heads]] = np.add.reduceat(self.ranges[term[cuts]], heads, axis=0)
            sums.append(total)
        bound = sums[0].copy()
        inner = np.ones(len(begin), bool)
        inner[first[1:] - 1] = False  # a text's last half is no window of its own, unless it is the only one
        bound[:-1][inner[:-1]] += sums[1][1:][inner[:-1]]
        window = inner.copy()
        window[first[:-1][count == 1]] = True
        for w in np.flatnonzero(window & (bound.max(1) >= theta - 1e-5)).tolist():
            d = int(np.searchsorted(first, w, "right")) - 1
            lo, hi = int(begin[w]), int(min(begin[w] + 2 * half, limits[d + 1]))
            best = bests.setdefault(d, {})
            terms = np.unique(term[lo:hi])
            terms = terms[terms < len(self.terms)]
            for item, score in self.wand(terms.tolist(), theta):
                held = [np.isin(part, _shingles(words[lo:hi], n)).mean() if hi - lo >= n else 0.0 for part, n in zip(self.parts[item], self.sizes[item])]
                if min(held) >= overlap and (item not in best or best[item][:2] < (score, min(held))):
                    best[item] = (float(score), float(min(held)), int(starts[lo] - offsets[d]), int(ends[hi - 1] - offsets[d]))
        for d, best in bests.items():
            out[d] = [(self.items[k], *v) for k, v in sorted(best.items())]
        return out


def _statistics(items: DataFrame) -> tuple[tuple[int, float, int], DataFrame]:
    """Items with words, their mean and most words; and how many items have each term (a distributed table)."""
    schema = pa.schema([("n", pa.int64()), ("terms", pa.list_(pa.int64()))])

    def kernel(batch: pa.RecordBatch) -> dict:
        own = [np.concatenate([word_hashes((x or "").lower().encode())[2] for x in pair]) for pair in zip(batch.column("q").to_pylist(), batch.column("a").to_pylist())]
        return {"n": [len(w) for w in own], "terms": [np.unique(w).view(np.int64).tolist() for w in own]}

    counted = map_batches(items.dropDuplicates(), kernel, "n long, terms array<long>", schema).where("n > 0")
    total = counted.agg(F.count("*"), F.avg("n"), F.max("n")).first()
    return (total[0], total[1] or 0.0, total[2] or 1), counted.select(F.explode("terms").alias("t")).groupBy("t").count()


def indexes(benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", question_col: str | None = None, answer_col: str | None = None, items_per_pass: int = ITEMS, bytes_per_pass: int = BYTES):
    """Broadcast indexes over the items, about `items_per_pass` items and `bytes_per_pass` bytes of text each: a hash of the id
    decides the pass of an item. Null ids are left out."""
    if question_col:
        items = benchmark.select(benchmark[item_col].cast("long").alias("i"), F.coalesce(benchmark[question_col].cast("string"), F.lit("")).alias("q"), F.coalesce(benchmark[answer_col].cast("string"), F.lit("")).alias("a"))
    else:
        items = benchmark.select(benchmark[item_col].cast("long").alias("i"), F.coalesce(benchmark[text_col].cast("string"), F.lit("")).alias("q"), F.lit("").alias("a"))
    items = items.where("i is not null")
    total = items.agg(F.count("*"), F.sum(F.octet_length("q") + F.octet_length("a"))).first()
    passes = max(1, -(-total[0] // items_per_pass), -(-(total[1] or 0) // bytes_per_pass))
    whole, frequency = _statistics(items) if passes > 1 else (None, None)
    for k in range(passes):
        rows = sorted({(r["i"], r["q"], r["a"]) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == k).collect()})
        known = None
        if whole:
            terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(word_hashes(x.lower().encode())[2] for r in rows for x in r[1:])])).view(np.int64)
            wanted = benchmark.sparkSession.createDataFrame([(t,) for t in terms.tolist()], "t long")
            known = *whole, {r["t"] & (1 << 64) - 1: r["count"] for r in frequency.join(wanted, "t", "left_semi").collect()}
        yield benchmark.sparkSession.sparkContext.broadcast(Index(rows, known=known))


def decontaminate(docs: DataFrame, benchmark: DataFrame, theta: float = 0.7, overlap: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", question_col: str | None = None, answer_col: str | None = None, items_per_pass: int = ITEMS) -> DataFrame:
    """Per document: its id, contaminated, n_items, hits (array of item_id, score, overlap, start, end: bytes of the lower-cased text).

    An item's text may be one column (`text_col` of `benchmark`) or question and answer columns, which must both be held. Items go
    to the executors `items_per_pass` at a time, so their size is bounded; each pass reads all documents. Null and empty texts
    have no hits; null ids are kept; repeated ids are kept as rows of their own; items that are null or have no words are left out.
    """
    hit = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("hits", pa.list_(hit))])
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    found, passes = None, 0
    for index in indexes(benchmark, text_col, item_col, question_col, answer_col, items_per_pass):
        passes += 1

        def kernel(batch: pa.RecordBatch, index=index) -> dict:
            got = index.value.search(texts(batch), theta, overlap)
            return {"id": batch.column("id"), "hits": [[dict(zip(("item_id", "score", "overlap", "start", "end"), h)) for h in own] for own in got]}

        one = map_batches(source, kernel, "id long, hits array<struct<item_id:long,score:double,overlap:double,start:long,end:long>>", schema, 256)
        found = one if found is None else found.unionByName(one.where(F.size("hits") > 0))
    if passes > 1:
        found = found.groupBy("id").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    return found.select(F.col("id").alias(id_col), (F.size("hits") > 0).alias("contaminated"), F.size("hits").alias("n_items"), "hits")


def keep_clean(docs: DataFrame, benchmark: DataFrame, theta: float = 0.7, overlap: float = 0.8, text_col: str = "text", items_per_pass: int = ITEMS) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item of `benchmark`; no shuffle. Each pass over more items than one takes is a
    written table, so executors hold one index at a time."""
    last = None
    for index in indexes(benchmark, items_per_pass=items_per_pass):
        if last is not None:
            docs = materialize(docs, "clean")
            last.unpersist()
        docs, last = filter_rows(docs, lambda own, index=index: [not hits for hits in index.value.search(own, theta, overlap)], text_col), index
    return docs
