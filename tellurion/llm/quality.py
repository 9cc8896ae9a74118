"""Operator 2: document quality from a linear-chain conditional random field over lines.

Every line gets features of itself and of its neighbours; a two-state chain (bad, good) with learned weights and
transitions labels each line by forward-backward marginals, and a document's quality is the length-weighted mean of
its lines' chance to be good, put on a probability scale by a logistic map. Only documents have labels: their lines inherit
them, and documents composed of stretches of good and of bad ones, whose lines' labels are known, show the chain where
quality changes within a text. The sample of labelled documents is bounded by `max_docs` and by bytes of text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filter_rows, map_batches, texts
from .neardup import word_hashes

#: Labelled documents a model is fitted on at most, those with the smallest hash of their id.
MAX_DOCS = 3000
#: UTF-8 bytes of the texts of that sample at most, so that the driver's memory is bounded whatever their lengths.
MAX_BYTES = 64 << 20
#: Composed documents in training at most, and the lines of each of their stretches.
MIXED, STRETCH = 600, 8
_CLASSES = ("lower", "upper", "digit", "space", "mark", "pipe", "bang", "odd", "wide")


def _byte_classes() -> np.ndarray:
    out = np.zeros((len(_CLASSES), 256), np.float32)
    sets = (range(97, 123), range(65, 91), range(48, 58), (9, 11, 12, 13, 32), b".,;:'\"()-?", b"|/\\<>=[]{}", b"!", b"#$%&*@^~_+`", range(128, 256))
    for k, chars in enumerate(sets):
        out[k, list(chars)] = 1
    return out


_TABLE = _byte_classes()
OWN = len(_CLASSES) + 10
FEATURES = 3 * OWN + 1


def line_features(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, FEATURES) of all documents' lines in order, bytes of each line, lines of each document. A document has at least one
    line, so the empty text is one empty line."""
    lines = [[part.encode() for part in t.split("\n")] for t in docs]
    counts = np.array([len(x) for x in lines], np.int64)
    flat = [x for own in lines for x in own]
    size = np.array([len(x) for x in flat], np.int64)
    data = np.frombuffer(b"\n".join(flat) + b"\n", np.uint8)
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
    own = np.zeros((len(flat), OWN), np.float32)
    length = np.maximum(size, 1).astype(np.float32)
    for k in range(len(_CLASSES)):
        own[:, k] = np.add.reduceat(_TABLE[k][data], starts) / length
    space = (data == 32).astype(np.int64)
    word = np.add.reduceat(space, starts) + 1
    again = np.zeros(len(flat), np.float32)
    at = 0
    for part in lines:
        if len(part) > 1:
            seen: dict[bytes, int] = {}
            for x in part:
                seen[x] = seen.get(x, 0) + 1
            again[at : at + len(part)] = [min(seen[x] - 1, 4) / 4 if x else 0 for x in part]
        at += len(part)
    k = len(_CLASSES)
    mean = size / word
    own[:, k] = np.log1p(size) / 8
    own[:, k + 1] = again
    own[:, k + 2] = np.minimum(mean, 20) / 20
    own[:, k + 3] = size < 12
    own[:, k + 4] = own[:, 1] > 0.3
    own[:, k + 5] = (own[:, 5] + own[:, 6] + own[:, 7]) > 0.04
    own[:, k + 6] = own[:, 2] > 0.15
    own[:, k + 7] = size == 0
    at, _, word_of = word_hashes(data)
    echo = at[1:][word_of[1:] == word_of[:-1]]  # where words begin that repeat the one before
    own[:, k + 8] = np.bincount(np.searchsorted(starts, echo, "right") - 1, minlength=len(flat)) / word
    own[:, k + 9] = own[:, k + 8] > 0.3
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    firsts = np.cumsum(np.concatenate([[0], counts[:-1]]))
    before[firsts], after[firsts + counts - 1] = 0, 0
    return np.concatenate([own, before, after, np.ones((len(flat), 1), np.float32)], axis=1), size, counts


def _gathered(docs: list[str], rows: int = 128) -> tuple[np.ndarray, ...]:
    """`line_features`, some documents at a time, so that what is computed per byte stays small."""
    return tuple(np.concatenate(x) for x in zip(*(line_features(docs[k : k + rows]) for k in range(0, len(docs), rows))))


def _order(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by falling length, their first lines, and how many have more than t lines, for each t."""
    by = np.argsort(-counts, kind="stable")
    firsts = np.cumsum(np.concatenate([[0], counts[:-1]]))[by]
    more = np.searchsorted(-counts[by], -np.arange(counts.max()), "left")
    return by, firsts, more


def marginals(energy: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Chance of state 1 for each line, expected transitions (2, 2), and the sum of log partition values; `energy` is the
    log-odds that a line gives for state 1. Documents advance together, so a step costs one small array operation."""
    n = len(energy)
    alpha, beta, shift = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros(n)
    _, firsts, more = _order(counts)
    local = np.stack([np.zeros(n), energy], 1)
    peak = local.max(1)
    local, t_exp = np.exp(local - peak[:, None]), np.exp(trans)
    at = firsts
    alpha[at] = local[at]
    shift[at] = alpha[at].sum(1)
    alpha[at] /= shift[at, None]
    for t in range(1, len(more)):
        at = firsts[: more[t]] + t
        a = alpha[at - 1] @ t_exp * local[at]
        shift[at] = a.sum(1)
        alpha[at] = a / shift[at, None]
    beta[:] = 1
    pairs = np.zeros((2, 2))
    for t in range(len(more) - 1, 0, -1):
        at = firsts[: more[t]] + t
        right = local[at] * beta[at] / shift[at, None]
        beta[at - 1] = right @ t_exp.T
        pairs += np.einsum("ni,ij,nj->ij", alpha[at - 1], t_exp, right)
    both = alpha * beta
    return both[:, 1] / both.sum(1), pairs, float(np.log(shift).sum() + peak.sum())


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float

    def lines(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chance of each line of all documents to be good, its bytes, and the lines of each document."""
        x, size, counts = _gathered(docs)
        return marginals(x @ self.weights, self.trans, counts)[0], size, counts

    def raw(self, docs: list[str]) -> np.ndarray:
        good, size, counts = self.lines(docs)
        firsts = np.cumsum(np.concatenate([[0], counts[:-1]]))
        weight = size + 1.0
        return np.add.reduceat(good * weight, firsts) / np.add.reduceat(weight, firsts)

    def score(self, docs: list[str]) -> np.ndarray:
        """Chance of label 1 of each document."""
        return 1 / (1 + np.exp(-(self.slope * self.raw(docs) + self.offset)))


def compose(docs: list[str], labels: list[int], most: int = MIXED, seed: int = 5) -> tuple[list[str], list[np.ndarray]]:
    """Documents made of stretches of lines of documents with different labels in turn, and the labels of their lines."""
    rng, kinds = np.random.default_rng(seed), [[k for k, y in enumerate(labels) if y == label] for label in (0, 1)]
    out, marks = [], []
    for _ in range(min(most, *map(len, kinds))):
        label, lines, own = int(rng.integers(2)), [], []
        for _ in range(int(rng.integers(2, 5))):
            source = docs[kinds[label][int(rng.integers(len(kinds[label])))]].split("\n")
            first = int(rng.integers(len(source)))
            part = source[first : first + int(rng.integers(1, STRETCH + 1))]
            lines += part
            own += [label] * len(part)
            label = 1 - label
        out.append("\n".join(lines))
        marks.append(np.array(own, np.float64))
    return out, marks


def fit_model(docs: list[str], labels: list[int], rounds: int = 150, l2: float = 1e-3) -> Model:
    """Maximum likelihood of the chain by Adam, then the logistic map on the same documents."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        only = float(y[0]) if len(y) else 0.5
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, 20 * (2 * only - 1) if len(y) else 0.0)
    mixed, marks = compose(docs, labels)
    x, _, counts = _gathered([*docs, *mixed])
    x = x.astype(np.float64)
    state = np.concatenate([np.repeat(y, counts[: len(docs)]), *marks])
    inner = np.ones(len(x), bool)
    inner[np.cumsum(counts) - 1] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[at].astype(int), state[at + 1].astype(int)), 1)
    theta, m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for step in range(1, rounds + 1):
        p, pairs, _ = marginals(x @ theta[:FEATURES], theta[FEATURES:].reshape(2, 2), counts)
        grad = np.concatenate([(state - p) @ x, (seen - pairs).ravel()]) / len(x) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, trans = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
    model = Model(w, trans, 1.0, 0.0)
    z = model.raw(docs)
    a, b = 4.0, -2.0
    for _ in range(100):  # Newton steps with a weak pull to moderate slopes
        q = 1 / (1 + np.exp(-(a * z + b)))
        g, r = np.array([((y - q) * z).sum() - 0.01 * a, (y - q).sum()]), q * (1 - q) + 1e-9
        h = np.array([[(r * z * z).sum() + 0.01, (r * z).sum()], [(r * z).sum(), r.sum()]])
        move = np.linalg.solve(h, g)
        a, b = a + float(np.clip(move[0], -2, 2)), b + float(np.clip(move[1], -2, 2))
        if abs(move).max() < 1e-8:
            break
    return Model(w, trans, a, b)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on the labelled documents with the smallest hash of their id, up to `max_docs` and `max_bytes` of text; null labels,
    ids and texts do not count. An id with labels that conflict counts for none."""
    named = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y in (0, 1)")
    once = named.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    sample = once.orderBy(F.xxhash64("id"), "id").limit(max_docs)
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).where("text is not null")
    chosen = source.join(F.broadcast(sample), "id").withColumn("h", F.xxhash64("id"))
    before = Window.orderBy("h", "id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = chosen.withColumn("upto", F.sum(F.octet_length("text")).over(before)).where(F.col("upto") <= max_bytes)
    rows = sorted((r["id"], r["text"], r["y"]) for r in fits.select("id", "text", "y").collect())
    return fit_model([t for _, t, _ in rows], [y for _, _, y in rows])


def label_lines(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per line of each document: its id, line (from 0), start and end (UTF-8 bytes), good (chance of state 1), is_good (0.5 or
    more). A null or empty text is one empty line. Null and repeated ids are kept; other columns are not read."""
    schema = pa.schema([("id", pa.int64()), ("line", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("good", pa.float64()), ("is_good", pa.bool_())])

    def kernel(batch: pa.RecordBatch) -> dict:
        if not batch.num_rows:
            return {f.name: [] for f in schema}
        good, size, counts = model.lines(texts(batch))
        first = np.cumsum(counts) - counts
        ends = np.cumsum(size + 1) - 1
        origin = np.repeat((ends - size)[first], counts)
        return {"id": batch.column("id").take(pa.array(np.repeat(np.arange(len(counts)), counts))), "line": (np.arange(len(size)) - np.repeat(first, counts)).astype(np.int32), "start": ends - size - origin, "end": ends - origin, "good": good, "is_good": good >= 0.5}

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return map_batches(source, kernel, "id long, line int, start long, end long, good double, is_good boolean", schema, 256).withColumnRenamed("id", id_col)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, score (chance of label 1), predicted (1 if score >= threshold). A null text counts as the empty
    one, which is scored as one empty line. Null and repeated ids are kept; other columns are not read."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def kernel(batch: pa.RecordBatch) -> dict:
        score = model.score(texts(batch)) if batch.num_rows else np.zeros(0)
        return {"id": batch.column("id"), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return map_batches(source, kernel, "id long, score double, predicted int", schema, 256).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that `classify` predicts 1 for; no shuffle."""
    return filter_rows(docs, lambda own: model.score(own) >= threshold, text_col)
