"""Quality classifier: a linear support vector machine on naive-Bayes-scaled n-gram indicators.

Each text becomes a set of hashed n-grams. A class's smoothed document shares give each n-gram a
log-count ratio; the indicators, scaled by these ratios and brought to length 1, are fitted by dual
coordinate descent on the hinge loss. A logistic curve, fitted on rows left out of that descent,
turns margins into probabilities under the classes' shares among all labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simvane.llm import labelled
from simvane.llm import text as tx
from simvane.session import lean, share_path

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Parameters:
    """``per_class`` and ``most_bytes`` bound the labelled rows that the fit reads, ``bits`` the feature space."""

    label: str = "quality"
    folds: int = 5
    held_out: int = 0
    threshold: float = 0.3
    per_class: int = 3000
    most_bytes: int = 64 << 20
    bits: int = 18
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 20
    seed: int = 7


_LOWER, _UPPER, _DIGIT, _WIDE = (np.zeros(256, bool) for _ in range(4))
_LOWER[0x61:0x7B] = _UPPER[0x41:0x5B] = _DIGIT[0x30:0x3A] = _WIDE[0x80:] = True
_WORD = _LOWER | _UPPER | _DIGIT | _WIDE
_SINGLE = ~_WORD & ~tx.SPACE
_STEP = np.uint64(0xD6E8FEB86659FD93)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, hashes, shapes) of words and of single symbols, in their order.

    A shape is the symbol itself, or how a word is written: number, capitals, capitalised, plain,
    without ASCII letters, or the same as the word before.
    """
    ws, we = tx.runs(_WORD[data], offsets)
    single = np.flatnonzero(_SINGLE[data])
    starts, ends = np.concatenate([ws, single]), np.concatenate([we, single + 1])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    rows = tx.rows_of(starts, offsets)
    hashes = tx.SpanHash(data)(starts, ends)
    first = data[starts]
    lower, upper = tx.count_in(_LOWER[data], starts, ends), tx.count_in(_UPPER[data], starts, ends)
    shapes = np.full(len(starts), 5, np.uint64)
    shapes[_DIGIT[first]] = 1
    shapes[lower > 0] = 4
    shapes[_UPPER[first] & (lower > 0)] = 3
    shapes[(lower == 0) & (upper > 1)] = 2
    shapes[_SINGLE[first]] = 100 + first[_SINGLE[first]].astype(np.uint64)
    if len(starts):
        shapes[1:][(hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1]) & _WORD[first[1:]]] = 6
    return rows, hashes, shapes


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs, sorted: words, word pairs and one to three shapes in a row."""
    rows, hashes, shapes = tokens(data, offsets)
    shift = np.uint64(64 - bits)
    found = [(rows, hashes)]
    pair = rows[1:] == rows[:-1]
    triple = rows[2:] == rows[:-2]
    two = tx.mix(shapes[:-1] * _STEP + shapes[1:])
    found += [(rows[1:][pair], tx.mix(hashes[:-1] * _STEP + hashes[1:])[pair])]
    for kind, at, grams in ((1, slice(None), tx.mix(shapes)), (2, pair, two), (3, triple, tx.mix(two[:-1] * _STEP + shapes[2:]))):
        # few shapes occur: a row's are made distinct before they join the words
        key = np.unique((rows[kind - 1 :][at].astype(np.uint64) << np.uint64(bits)) | tx.mix(grams[at] + np.uint64(kind)) >> shift)
        found.append(((key >> np.uint64(bits)).astype(np.int64), None, key))
    keys = [f[2] if len(f) == 3 else (f[0].astype(np.uint64) << np.uint64(bits)) | (f[1] >> shift) for f in found]
    keys = np.unique(np.concatenate(keys))
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float

    def margins(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        r = self.ratio[buckets]
        norm = np.sqrt(tx.per_row(rows, n, r * r))
        return tx.per_row(rows, n, r * self.weights[buckets]) / np.where(norm > 0, norm, 1) + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
        n = len(offsets) - 1
        rows, buckets = features(data, offsets, bits)
        p = 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows, buckets, n) + self.shift, -40, 40)))
        p[tx.per_row(rows, n) == 0] = self.prior
        return p


def log_count_ratio(docs: list[np.ndarray], y: np.ndarray, size: int, smoothing: float) -> np.ndarray:
    counts = np.full((2, size), smoothing)
    for x, c in zip(docs, y, strict=True):
        counts[c, x] += 1
    shares = counts / counts.sum(1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(docs: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float, epochs: int, seed: int) -> np.ndarray:
    """Weights, the bias last, of min |w|^2 / 2 + cost * sum of hinge losses; rows have a constant feature of 1."""
    w, alpha = np.zeros(size + 1), np.zeros(len(docs))
    square = np.array([v @ v + 1.0 for v in values])
    sign = np.where(y > 0, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(docs)):
            x, v = docs[i], values[i]
            gradient = sign[i] * (w[x] @ v + w[-1]) - 1.0
            now = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = (now - alpha[i]) * sign[i]
            if step:
                w[x] += step * v
                w[-1] += step
                alpha[i] = now
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the weighted logistic curve: Newton's steps, halved until they gain, with a small ridge."""
    centre, width = float(margin.mean()), float(margin.std()) or 1.0
    x = np.stack([(margin - centre) / width, np.ones_like(margin)])
    ridge = 1e-3 * len(y)

    def loss(beta: np.ndarray) -> float:
        z = beta @ x
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge * (beta[0] ** 2) / 2)

    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -35, 35)))
        pull = np.array([ridge * beta[0], 0.0])
        curve = (x * (weight * p * (1 - p))) @ x.T + np.diag([ridge, 1e-9])
        step = np.linalg.solve(curve, x @ (weight * (p - y)) + pull)
        now = loss(beta)
        while loss(beta - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / width), float(beta[1] - beta[0] * centre / width)


def fit(rows: list[tuple[int, int, bytes | pa.Buffer]], sizes: dict[int, int], p: Parameters) -> Model:
    """Fits on sampled (doc_id, y, bucket list); without both classes the score is the constant prior."""
    size = 1 << p.bits
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.5
    y = np.array([r[1] for r in rows], int)
    docs = [np.frombuffer(r[2], np.int32) for r in rows]
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log((prior + 1e-9) / (1 - prior + 1e-9))), prior)
    part = np.random.default_rng(p.seed).random(len(docs)) < 0.75
    own = np.flatnonzero(part)
    ratio = log_count_ratio([docs[i] for i in own], y[own], size, p.smoothing)
    values = []
    for x in docs:
        v = ratio[x]
        values.append(v / (np.sqrt(v @ v) or 1.0))
    w = dual_coordinate_descent([docs[i] for i in own], [values[i] for i in own], y[own], size, p.cost, p.epochs, p.seed)
    margin = np.array([w[x] @ v + w[-1] for x, v in zip(docs, values, strict=True)])
    rest = ~part if len(set(y[~part].tolist())) == 2 else np.ones(len(y), bool)
    seen = np.bincount(y[rest], minlength=2)
    slope, shift = logistic(margin[rest], y[rest], np.array([(1 - prior) / seen[0], prior / seen[1]])[y[rest]] * rest.sum())
    return Model(ratio, w[:-1], float(w[-1]), slope, shift, prior)


def quality_classifier(documents: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """One row (SCHEMA) for each document: probability of label 1 and whether it reaches the threshold.

    Learns from at most ``2 * per_class`` labelled rows, of ``most_bytes`` of features, outside the held-out fold;
    only texts enter.
    Null or empty texts, and all texts if labels lack a class, score the classes' prior share.
    A null id counts as held out if the empty text's fold is. Repeated rows score alike, ids labelled
    twice take the larger label, and other columns are never read.
    """
    share_path(documents.sparkSession)
    fold = labelled.fold(F.col("doc_id"), p.folds)
    sample, sizes = labelled.class_sample(labels.where(fold != p.held_out), p.label, p.per_class)
    bits = p.bits

    def featurise(texts: pa.Array) -> list[bytes]:
        out = []
        for _, _, data, offsets in tx.blocks(texts):
            rows, buckets = features(data, offsets, bits)
            edges = np.searchsorted(rows, np.arange(len(offsets)))
            out += [buckets[a:b].astype(np.int32).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out

    model = documents.sparkSession.sparkContext.broadcast(fit(labelled.sampled_features(documents, sample, featurise, p.most_bytes), sizes, p))
    threshold = p.threshold

    def run(batches):
        m = model.value
        for b in batches:
            score = tx.per_block(b["text"], lambda data, offsets: {"score": m.scores(data, offsets, bits)})["score"]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents.select("doc_id", (fold == p.held_out).alias("held_out"), "text").mapInArrow(lean(run), SCHEMA)
