"""Language identification: known words first, shorter and shorter character n-grams for the rest.

A word that the training texts contain often enough scores each language by its log frequency there.
An unseen word is read by overlapping n-grams of the longest length; an unknown n-gram gives way to
the n-grams one shorter that make it up, down to single characters. A text's score is the mean over
its words, and the languages' posterior shares follow from it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simvane.llm import labelled
from simvane.llm import text as tx
from simvane.session import lean, share_path

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
UNDETERMINED = "und"


@dataclass(frozen=True)
class Parameters:
    """``sample_rows`` bounds the texts that are learnt from, shared out evenly to the languages.

    A word or n-gram is known of a language from ``least_count`` occurrences in its texts on. ``evidence`` words' worth of mean
    score make up the posterior, since the words of one text aren't independent.
    """

    folds: int = 5
    held_out: int = 0
    sample_rows: int = 6000
    least_count: int = 3
    longest: int = 4
    smoothing: float = 0.5
    evidence: float = 20.0


_WORD = np.zeros(256, bool)
_WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
_LETTER = regex.compile(r"\p{L}")


def distinct_words(data: np.ndarray, offsets: np.ndarray):
    """Rows and word numbers of a block's words; then the distinct words' hashes, starts, ends and the span hash."""
    starts, ends = tx.runs(_WORD[data], offsets)
    spans = tx.SpanHash(data)
    hashes, first, inverse = np.unique(spans(starts, ends), return_index=True, return_inverse=True)
    return tx.rows_of(starts, offsets), inverse, hashes, starts[first], ends[first], spans


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, bounds: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, place of the first character) of every window of ``k`` characters inside the words."""
    n = np.maximum(lengths - k + 1, 0)
    word = np.repeat(np.arange(len(starts)), n)
    return word, np.repeat(at, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bounds of all code points, and each word's first one and length in code points."""
    leads = np.flatnonzero(tx.LEAD[data])
    at = np.searchsorted(leads, starts)
    return np.append(leads, len(data)), at, np.searchsorted(leads, ends) - at


def count_keys(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """(language number, key, n, occurrences) of a block's words (n = 0) and n-grams."""
    rows, inverse, hashes, starts, ends, spans = distinct_words(data, offsets)
    if not len(rows):
        return []
    pair, occurrences = np.unique(langs[rows].astype(np.int64) * len(hashes) + inverse, return_counts=True)
    lang, number = np.divmod(pair, len(hashes))
    out = [(lang, hashes[number], 0, occurrences)]
    bounds, at, lengths = characters(data, starts, ends)
    per_word = [np.bincount(number[lang == s], occurrences[lang == s], len(hashes)) for s in range(int(langs.max()) + 1)]
    for k in range(1, longest + 1):
        word, place = grams(data, starts, ends, k, bounds, at, lengths)
        keys, inverse_k = np.unique(spans(bounds[place], bounds[place + k]), return_inverse=True)
        for s, counts in enumerate(per_word):
            n = np.bincount(inverse_k, counts[word], len(keys)) if len(keys) else np.zeros(0)
            some = n > 0
            out.append((np.full(int(some.sum()), s), keys[some], k, n[some].astype(np.int64)))
    return out


@dataclass
class Model:
    """For n = 0 (words) and 1 to longest: sorted keys and a row of log frequencies by language for each."""

    langs: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    floor: np.ndarray

    def look_up(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.keys[n]
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return known[place] == keys, place

    def word_scores(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, spans: tx.SpanHash) -> np.ndarray:
        out = np.zeros((len(hashes), len(self.langs)))
        known, place = self.look_up(0, hashes)
        out[known] = self.logs[0][place[known]]
        new = np.flatnonzero(~known)
        if not len(new):
            return out
        starts, ends = starts[new], ends[new]
        bounds, at, lengths = characters(data, starts, ends)
        longest = len(self.keys) - 1
        total, parts = np.zeros((len(new), len(self.langs))), np.zeros(len(new))
        # windows still unknown, as (word, place); words shorter than n join when n comes down to their length
        word, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for n in range(longest, 0, -1):
            length = np.minimum(lengths, longest)
            w, p = grams(data, starts, ends, n, bounds, at, np.where(length == n, lengths, 0))
            if len(word):  # each unknown window of n + 1 characters splits into its two windows of n
                word, place = np.concatenate([word, word]), np.concatenate([place, place + 1])
                one = np.unique(place * (1 + len(new)) + word)
                place, word = np.divmod(one, 1 + len(new))
            word, place = np.concatenate([word, w]), np.concatenate([place, p])
            known, found = self.look_up(n, spans(bounds[place], bounds[place + n]))
            rows = self.logs[n][found[known]]
            for s in range(len(self.langs)):
                total[:, s] += np.bincount(word[known], rows[:, s], len(new))
            parts += np.bincount(word[known], minlength=len(new))
            word, place = word[~known], place[~known]
        for s in range(len(self.langs)):
            total[:, s] += self.floor[s] * np.bincount(word, minlength=len(new))
        parts += np.bincount(word, minlength=len(new))
        out[new] = total / np.maximum(parts, 1)[:, None]
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray, evidence: float) -> dict[str, np.ndarray]:
        n = len(offsets) - 1
        rows, inverse, hashes, starts, ends, spans = distinct_words(data, offsets)
        letters = tx.count_in(_ASCII_LETTER[data], offsets[:-1], offsets[1:]) > 0
        for i in np.flatnonzero(~letters & (tx.count_in(_WORD[data], offsets[:-1], offsets[1:]) > 0)):
            letters[i] = _LETTER.search(data[offsets[i] : offsets[i + 1]].tobytes().decode()) is not None
        if not self.langs:
            return {"best": np.full(n, -1), "score": np.zeros(n)}
        scores = self.word_scores(data, hashes, starts, ends, spans)
        count = tx.per_row(rows, n)
        mean = np.stack([tx.per_row(rows, n, scores[inverse, s]) for s in range(len(self.langs))], 1) / np.maximum(count, 1)[:, None]
        z = (mean - mean.max(1, keepdims=True)) * np.minimum(count, evidence)[:, None]
        share = np.exp(z)
        share /= share.sum(1, keepdims=True)
        best = np.where(letters, share.argmax(1), -1)
        return {"best": best, "score": np.where(letters, share.max(1), 0.0)}


def fit(counts: list[tuple[str, int, int, int]], p: Parameters) -> Model:
    """From (lang, n, key, occurrences), keys as signed 64-bit; languages in alphabetical order."""
    langs = sorted({c[0] for c in counts})
    number = {s: i for i, s in enumerate(langs)}
    keys, logs = [], []
    floor = np.zeros(len(langs))
    for n in range(p.longest + 1):
        own = [c for c in counts if c[1] == n]
        lang = np.array([number[c[0]] for c in own], np.int64)
        key = np.array([c[2] for c in own], np.int64).view(np.uint64)
        occurrences = np.array([c[3] for c in own], float)
        kinds, inverse = np.unique(key, return_inverse=True)
        table = np.full((len(kinds), len(langs)), p.smoothing)
        np.add.at(table, (inverse, lang), occurrences)
        totals = table.sum(0) if len(kinds) else np.ones(len(langs))
        keys.append(kinds)
        logs.append(np.log(table / totals))
        if n == 1 and len(kinds):
            floor = np.log(p.smoothing / totals)
    return Model(langs, keys, logs, floor)


def training_counts(documents: DataFrame, p: Parameters) -> list[tuple[str, int, int, int]]:
    """Occurrences of words and n-grams by language in the sample; as many rows as the sample has kinds of them."""
    own = documents.where((labelled.fold(F.col("doc_id"), p.folds) != p.held_out) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(p.sample_rows + 1).collect()}
    if not sizes:
        return []
    if len(sizes) > p.sample_rows:
        raise ValueError(f"more than {p.sample_rows} languages; raise sample_rows")
    each = max(1, p.sample_rows // len(sizes))
    # the ids of smallest hash: below a bound that leaves some more than ``each`` of a language
    spark = documents.sparkSession
    below = [(lang, min(2**63 - 1, -(2**63) + int((each + 6 * each**0.5) / n * 2**64))) for lang, n in sizes.items()]
    ranked = own.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(F.broadcast(spark.createDataFrame(below, "lang string, below long")), "lang").where("h <= below")
    chosen: dict[str, set] = {}
    for _, lang, i in sorted((r["h"], r["lang"], r["doc_id"]) for r in ranked.select("h", "lang", "doc_id").distinct().collect()):
        if len(chosen.setdefault(lang, set())) < each:
            chosen[lang].add(i)
    sample = spark.createDataFrame([(i, lang) for lang, ids in chosen.items() for i in ids], "doc_id long, lang string")
    longest = p.longest

    def run(batches):
        for b in batches:
            texts, lang = pc.utf8_lower(b["text"]), b["lang"].dictionary_encode()
            names, numbers = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in tx.blocks(texts):
                for s, key, n, occurrences in count_keys(data, offsets, numbers[lo:hi], longest):
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in s], pa.string()), pa.array(np.full(len(s), n, np.int32)), pa.array(key.view(np.int64)), pa.array(occurrences.astype(np.int64))], ["lang", "n", "key", "occurrences"])

    found = documents.select("doc_id", "lang", "text").join(F.broadcast(sample), ["doc_id", "lang"]).mapInArrow(run, "lang string, n int, key long, occurrences long")
    total = F.sum("occurrences").alias("occurrences")
    return [tuple(r) for r in found.groupBy("lang", "n", "key").agg(total).where(F.col("occurrences") >= p.least_count).collect()]


def language_id(documents: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """One row (SCHEMA) for each document: the likeliest of the learnt languages and its posterior share.

    Learns from text and language of at most ``sample_rows`` rows outside the held-out fold, and fails
    if there are more languages than that. A null text, one without a letter, and every text if nothing
    could be learnt give ``und`` with score 0. A null id counts as held out if the empty text's fold is.
    Repeated rows are judged alike; other columns are never read. Of equal languages the first in
    alphabetical order wins.
    """
    share_path(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(fit(training_counts(documents, p), p))
    evidence = p.evidence

    def run(batches):
        m = model.value
        names = np.array([*m.langs, UNDETERMINED], object)
        for b in batches:
            found = tx.per_block(pc.utf8_lower(b["text"]), lambda data, offsets: m.predict(data, offsets, evidence))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(names[found["best"].astype(int)], pa.string()), pa.array(found["score"])], ["doc_id", "held_out", "lang_pred", "score"])

    held_out = labelled.fold(F.col("doc_id"), p.folds) == p.held_out
    return documents.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(lean(run), SCHEMA)
