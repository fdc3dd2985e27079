"""Toxicity: embeddings of words and of their character n-grams, averaged into a linear softmax.

A word is the mean of the vectors of its own bucket and of its n-grams' buckets; a text is the mean
of its distinct words, each weighing log(1 + its count), and of some blank words, so that a handful
of words decides little. A linear softmax over that mean tells the classes. Vectors and softmax are
trained together in NumPy, a text at a time, both classes weighing alike. After each pass all vectors
shrink by one length, so that only n-grams that texts of a class share keep one: invented words, of
which every text has some, would else learn texts by heart. Several models, each trained without one
part of the rows, are averaged; a rising curve fitted on the logits of the parts left out turns logits
into probabilities under the classes' shares among all labelled rows.
A misspelt word shares most n-grams with the word meant, hence its vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simvane.llm import labelled
from simvane.llm import text as tx
from simvane.session import lean, share_path

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Parameters:
    """``per_class`` and ``most_bytes`` bound the labelled rows that the fit reads; ``bits`` and ``dimension`` the vectors.

    ``blank`` is the weight of the blank words. Only buckets of ``least_rows`` sampled rows or more are
    trained, others stay 0. A text's step moves its own logit by ``most_step`` times its error at most.
    ``parts`` models are averaged. For the curve half of label 1's texts keep ``disguised`` of their evidence.
    """

    label: str = "toxic"
    folds: int = 3
    held_out: int = 1
    threshold: float = 0.7
    per_class: int = 2500
    most_bytes: int = 64 << 20
    bits: int = 18
    dimension: int = 4
    grams: tuple[int, int] = (3, 5)
    blank: float = 30.0
    least_rows: int = 7
    epochs: int = 8
    rate: float = 0.01
    shrink: float = 0.01
    most_step: float = 5.0
    parts: int = 4
    disguised: float = 0.5
    seed: int = 11


_LETTER = np.zeros(256, bool)
_LETTER[0x30:0x3A] = _LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
#: Characters that stand for letters in disguised words.
_LETTER[list(b"@$*'")] = True


def word_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, spans: tx.SpanHash, p: Parameters) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, buckets): first of every given word itself, then of its n-grams by length; a word's ends are marked."""
    shift = np.uint64(64 - p.bits)
    yield np.arange(len(starts)), (tx.mix(hashes + np.uint64(1)) >> shift).astype(np.int64)
    leads = np.flatnonzero(tx.LEAD[data])
    at = np.searchsorted(leads, starts)
    lengths = np.searchsorted(leads, ends) - at
    bounds = np.append(leads, len(data))
    for k in range(p.grams[0], p.grams[1] + 1):
        n = np.maximum(lengths - k + 1, 0)
        word = np.repeat(np.arange(len(starts)), n)
        begin = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)  # place in its word
        place = at[word] + begin
        mark = (begin == 0).astype(np.uint64) + np.uint64(2) * (begin + k == lengths[word]).astype(np.uint64)
        keys = spans(bounds[place], bounds[place + k]) + mark * np.uint64(0x2545F4914F6CDD1D)
        yield word, (tx.mix(keys) >> shift).astype(np.int64)


def bags(data: np.ndarray, offsets: np.ndarray, p: Parameters):
    """Each row's distinct words: (rows, word numbers, weights, how many words), then the words' buckets by kind."""
    starts, ends = tx.runs(_LETTER[data], offsets)
    rows = tx.rows_of(starts, offsets)
    spans = tx.SpanHash(data)
    hashes = spans(starts, ends)
    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    buckets = word_buckets(data, starts[first], ends[first], distinct, spans, p)
    pairs, counts = np.unique(rows * max(1, len(distinct)) + inverse, return_counts=True)
    rows, numbers = np.divmod(pairs, max(1, len(distinct)))
    weights = np.log1p(counts)
    weights /= (tx.per_row(rows, len(offsets) - 1, weights) + p.blank)[rows]
    return rows, numbers, weights, len(distinct), buckets


def text_bag(data: np.ndarray, p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and the weight that each has in the text's mean."""
    _, numbers, weights, n, kinds = bags(data, np.array([0, len(data)]), p)
    words, buckets = (np.concatenate(x) for x in zip(*kinds, strict=True))
    share = np.bincount(numbers, weights, n) / np.maximum(np.bincount(words, minlength=n), 1)
    own, inverse = np.unique(buckets, return_inverse=True)
    return own.astype(np.int32), np.bincount(inverse, share[words], len(own)).astype(np.float32)


@dataclass
class Curve:
    """Probability of label 1: it rises from ``low`` to ``high``, since some labels no text explains."""

    centre: float
    slope: float
    low: float
    high: float

    def __call__(self, logit: np.ndarray) -> np.ndarray:
        return self.low + (self.high - self.low) / (1 + np.exp(-np.clip(self.slope * (logit - self.centre), -40, 40)))


def rising_curve(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Curve:
    """The likeliest curve over a grid of centres, slopes and ends; ``low`` is the share of 1 among the lower half of the 0s."""
    zeros = logit[y == 0]
    under = logit <= np.median(zeros)
    low = min(0.5, max(1e-4, float(weight[under] @ y[under] / weight[under].sum())))
    width = float(np.median(np.abs(zeros - np.median(zeros)))) or 1.0
    centres = np.quantile(logit, np.linspace(0.1, 0.998, 80))
    best, found = -np.inf, Curve(0.0, 1.0, low, 0.99)
    for high in (0.8, 0.9, 0.96, 0.99):
        for slope in 0.1 * 1.6 ** np.arange(10) / width:
            p = np.clip(Curve(centres[:, None], slope, low, max(high, low + 0.1))(logit[None, :]), 1e-6, 1 - 1e-6)
            gain = (np.log(p) @ (weight * y)) + (np.log1p(-p) @ (weight * (1 - y)))
            if gain.max() > best:
                best, found = gain.max(), Curve(float(centres[gain.argmax()]), float(slope), low, max(high, low + 0.1))
    return found


@dataclass
class Model:
    """``gain`` of a bucket: its vector times the difference of the two classes' softmax weights."""

    gain: np.ndarray
    bias: float
    curve: Curve
    prior: float

    def scores(self, data: np.ndarray, offsets: np.ndarray, p: Parameters) -> np.ndarray:
        n = len(offsets) - 1
        rows, numbers, weights, kinds, parts = bags(data, offsets, p)
        word_gain, pieces = np.zeros(kinds), np.zeros(kinds)
        for words, buckets in parts:
            word_gain += np.bincount(words, self.gain[buckets], kinds)
            pieces += np.bincount(words, minlength=kinds)
        word_gain /= np.maximum(pieces, 1)
        score = self.curve(tx.per_row(rows, n, weights * word_gain[numbers]) + self.bias)
        score[tx.per_row(rows, n) == 0] = self.prior
        return score


def train(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, p: Parameters) -> tuple[np.ndarray, float]:
    """Vectors and softmax together, a text at a time; returns (gain, bias).

    A bucket's rate falls with the root of its rows, and with the square of the weight that it usually has.
    """
    weigh = len(y) / 2 / np.maximum(np.bincount(y, minlength=2), 1)
    rng = np.random.default_rng(p.seed)
    in_rows, squares = np.zeros(1 << p.bits, np.int64), np.zeros(1 << p.bits)
    for x, v in docs:
        in_rows[x] += 1
        squares[x] += v * v
    usual = np.sqrt(squares / np.maximum(in_rows, 1)) + 1e-12
    rates = (p.rate / (usual**2 * np.sqrt(np.maximum(in_rows, 1)))).astype(np.float32)
    vectors = np.zeros((1 << p.bits, p.dimension), np.float32)
    soft = rng.normal(0, 0.5, (2, p.dimension)).astype(np.float32)
    bias = np.zeros(2)
    for epoch in range(p.epochs):
        rate = 1 - epoch / p.epochs
        for i in rng.permutation(len(docs)):
            x, v = docs[i]
            own = vectors[x]
            mean = v @ own
            z = soft @ mean + bias
            e = np.exp(z - z.max())
            error = e / e.sum()
            error[y[i]] -= 1
            error *= weigh[y[i]]
            back = error @ soft
            step = rate * v * rates[x]
            step *= min(1.0, p.most_step / max(float(step @ v), 1e-9))
            vectors[x] = own - (step[:, None] * back[None, :]).astype(np.float32)
            soft -= (0.05 * rate * error[:, None] * mean[None, :]).astype(np.float32)
            bias -= 0.01 * rate * error
        length = np.sqrt((vectors * vectors).sum(1)) * usual  # what the vector adds to a mean
        vectors *= np.maximum(0, 1 - p.shrink * rate / np.maximum(length, 1e-12))[:, None].astype(np.float32)
    return (vectors @ (soft[1] - soft[0])).astype(np.float64), float(bias[1] - bias[0])


def fit(rows: list[tuple[int, int, bytes | pa.Buffer]], sizes: dict[int, int], p: Parameters) -> Model:
    """Fits on sampled (doc_id, y, bag), which it uses up: the average of the parts' models, and the curve from their logits of rows they didn't see."""
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.5
    y = np.array([r[1] for r in rows], int)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << p.bits), 0.0, Curve(0.0, 0.0, prior, prior), prior)
    docs, in_rows = [], np.zeros(1 << p.bits, np.int32)
    for _, _, raw in rows:
        n = len(memoryview(raw)) // 8
        docs.append((np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.float32, n, 4 * n)))
        in_rows[docs[-1][0]] += 1
    common = in_rows >= min(p.least_rows, 1 + len(docs) // 20)
    rows.clear()  # from here on only what is learnt from is held
    for i, (x, v) in enumerate(docs):
        docs[i] = x[common[x]], v[common[x]]
    part = np.zeros(len(docs), int)
    for label in (0, 1):  # each part has its share of both classes
        own = np.flatnonzero(y == label)
        part[np.random.default_rng([p.seed, label]).permutation(own)] = np.arange(len(own)) % p.parts
    logit, gain, bias = np.zeros(len(docs)), np.zeros(1 << p.bits), 0.0
    for k in range(p.parts):
        own = np.flatnonzero(part != k)
        if len(set(y[own].tolist())) < 2:
            own = np.arange(len(docs))
        mine, offset = train([docs[i] for i in own], y[own], p)
        for i in np.flatnonzero(part == k):
            logit[i] = docs[i][1] @ mine[docs[i][0]] + offset
        gain, bias = gain + mine / p.parts, bias + offset / p.parts
    # every second text of label 1 counts as if half of what gives it away were spelt in ways not seen yet
    usual, ones = float(np.median(logit[y == 0])), np.flatnonzero(y == 1)[::2]
    logit[ones] = usual + p.disguised * (logit[ones] - usual)
    seen = np.bincount(y, minlength=2)
    return Model(gain, bias, rising_curve(logit, y, np.array([(1 - prior) / seen[0], prior / seen[1]])[y]), prior)


def toxicity(documents: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """One row (SCHEMA) for each document: probability of label 1 and whether it reaches the threshold.

    Learns from at most ``2 * per_class`` labelled rows, of ``most_bytes`` of features, outside the held-out fold;
    only texts enter.
    Null, empty and wordless texts, and all texts if labels lack a class, score the classes' prior
    share. A null id counts as held out if the empty text's fold is. Repeated rows score alike, ids
    labelled twice take the larger label, and other columns are never read.
    """
    share_path(documents.sparkSession)
    fold = labelled.fold(F.col("doc_id"), p.folds)
    sample, sizes = labelled.class_sample(labels.where(fold != p.held_out), p.label, p.per_class)

    def featurise(texts: pa.Array) -> list[bytes]:
        data, offsets = tx.utf8(pc.utf8_lower(texts))
        out = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            x, v = text_bag(data[a:b], p)
            out.append(x.tobytes() + v.tobytes())
        return out

    model = documents.sparkSession.sparkContext.broadcast(fit(labelled.sampled_features(documents, sample, featurise, p.most_bytes), sizes, p))

    def run(batches):
        m = model.value
        for b in batches:
            score = tx.per_block(pc.utf8_lower(b["text"]), lambda data, offsets: {"score": m.scores(data, offsets, p)})["score"]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(score), pa.array((score >= p.threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents.select("doc_id", (fold == p.held_out).alias("held_out"), "text").mapInArrow(lean(run), SCHEMA)
