"""Quality rules: counts of words, symbols and repeats, and tokeniser fertility.

Public vocabularies cut each word of a text into pieces: one with byte fallback, and one of many
languages' byte pairs. Natural prose of a script yields a narrow range of characters per token under
both, few byte-fallback pieces and a tokens' entropy that grows with the length; junk, mojibake and
lists of symbols leave those bands and are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from simvane.llm import text as tx
from simvane.session import lean, share_path

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_token", "chars_per_pair", "fallback_share", "token_entropy")
SCHEMA = ", ".join(
    ["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "kept boolean", "script string", *(f"{c} double" for c in MEASURES)]
)


@dataclass(frozen=True)
class Band:
    """What a script's prose keeps to; ``chars_per_pair`` is under the byte-pair vocabulary, entropy in bits a token, against log2 of the number of tokens."""

    chars_per_token: tuple[float, float]
    chars_per_pair: tuple[float, float]
    fallback_share: float
    entropy_ratio: float


@dataclass(frozen=True)
class Rules:
    """Fixed limits: a text needs ``least_words`` and at most ``most_repeated`` percent of repeated words.

    ``vocabulary`` and ``pairs`` are the paths of a sentencepiece model with byte fallback and of a byte-pair rank file.
    """

    vocabulary: str = ""
    pairs: str = ""
    least_words: int = 50
    most_repeated: int = 50
    bands: dict[str, Band] = field(
        default_factory=lambda: {
            "latin": Band((1.15, 8.0), (1.75, 8.0), 0.02, 0.615),
            "cyrillic": Band((1.40, 8.0), (1.0, 8.0), 0.05, 0.55),
            "greek": Band((0.75, 6.0), (0.7, 8.0), 0.20, 0.50),
            "han": Band((0.40, 4.0), (0.4, 5.0), 0.80, 0.45),
            "other": Band((0.25, 8.0), (0.25, 8.0), 0.95, 0.40),
        }
    )


SCRIPTS = ("latin", "cyrillic", "greek", "han", "other")
#: The script that a first byte of UTF-8 points to, as an index of SCRIPTS; -1 for what tells nothing.
_SCRIPT_OF = np.full(256, -1, np.int8)
for _lo, _hi, _s in ((0x41, 0x5A, 0), (0x61, 0x7A, 0), (0xC3, 0xCA, 0), (0xCD, 0xCF, 2), (0xD0, 0xD4, 1), (0xD5, 0xDF, 4), (0xE0, 0xE0, 4), (0xE1, 0xE1, 4), (0xE3, 0xED, 3), (0xF0, 0xF4, 4)):
    _SCRIPT_OF[_lo : _hi + 1] = _s
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated_windows(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of words, numbered by their bytes, in the order of rows: whether each lies in a window of three that its row has twice or more."""
    repeated = np.zeros(len(words), bool)
    at = np.flatnonzero(rows[2:] == rows[:-2]) if len(words) > 2 else np.zeros(0, np.int64)
    if len(at):
        pairs = words[:-1] << 32 | words[1:]
        if int(words.max()) >= 1 << 21:  # else three numbers fit in one
            pairs = np.unique(pairs, return_inverse=True)[1]
            windows = pairs[at] << 32 | words[at + 2]
        else:
            windows = words[at] << 42 | words[at + 1] << 21 | words[at + 2]
        order = np.argsort(windows, kind="stable")  # a row's own windows stay together
        alike = (windows[order[1:]] == windows[order[:-1]]) & (rows[at[order[1:]]] == rows[at[order[:-1]]])
        hit = at[np.unique(np.concatenate([order[1:][alike], order[:-1][alike]]))]
        for k in range(3):
            repeated[hit + k] = True
    return repeated


def base_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], tuple]:
    """The counts of COUNTS by row, and the words: (starts, ends, rows), the distinct ones, and which one each is."""
    n = len(offsets) - 1
    inside = ~tx.SPACE[data]
    starts, ends = tx.runs(inside, offsets)
    rows = tx.rows_of(starts, offsets)
    distinct, words = tx.distinct(data[inside], ends - starts)
    out = {"n_words": tx.per_row(rows, n)}
    out["word_chars"] = tx.count_in(inside & tx.LEAD[data], offsets[:-1], offsets[1:])
    out["n_symbols"] = tx.count_in(_SYMBOL[data], offsets[:-1], offsets[1:])

    solid = data != 0x0A
    line_start, line_end = tx.runs(solid, offsets)
    with_word = tx.count_in(inside, line_start, line_end) > 0
    lines = tx.distinct(data[solid], line_end - line_start)[1][with_word]
    line_rows = tx.rows_of(line_start[with_word], offsets)
    again = np.ones(len(lines), bool)
    again[np.unique(line_rows << 32 | lines, return_index=True)[1]] = False
    out["n_dup_lines"] = tx.per_row(line_rows[again], n)
    out["n_repeat_words"] = tx.per_row(rows[repeated_windows(rows, words)], n)
    return out, (starts, ends, rows, distinct, words)


class Fertility:
    """Cuts words by the public vocabularies, each distinct word of a block once."""

    #: Words kept between blocks, and their bytes; beyond it the memory starts anew, which only costs time.
    MOST, MOST_BYTES = 300_000, 12 << 20

    def __init__(self, rules: Rules):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=rules.vocabulary)
        self.is_byte = np.array([self.pieces.IsByte(i) for i in range(self.pieces.GetPieceSize())])
        self.pairs = byte_pairs(rules.pairs)
        self.pair_bytes = np.array([len(x) for x in self.pairs.decode_tokens_bytes(range(self.pairs.n_vocab))], np.int64)
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.first = np.zeros(1, np.int64)  # ids of word w: ids[first[w]:first[w + 1]]
        self.ids, self.paired = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _pairs(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """The number of byte pairs in each word with a space before it; the encoder's pattern never joins two words."""
        ids = np.array(self.pairs.encode_ordinary(" " + " ".join(words)), np.int64)
        begins = np.cumsum(self.pair_bytes[ids]) - self.pair_bytes[ids]
        return np.diff(np.searchsorted(begins, tx.sums(sizes + 1)))

    def of(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words where their ids begin and how many they are, and their numbers of byte pairs."""
        place = pc.fill_null(pc.index_in(distinct, self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.known) + len(new) > self.MOST or self.known.nbytes > self.MOST_BYTES:
                self._clear()
                new, place = np.arange(len(distinct)), np.zeros(len(distinct), np.int64)
            fresh = distinct.take(pa.array(new))
            words = fresh.cast(pa.large_string()).to_pylist()
            cut = self.pieces.encode(words, num_threads=1)
            lengths = np.fromiter(map(len, cut), np.int64, len(cut))
            place[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, fresh])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(cut), np.int32, int(lengths.sum()))])
            self.paired = np.concatenate([self.paired, self._pairs(words, pc.binary_length(fresh).to_numpy())])
        return self.first[place], self.first[place + 1] - self.first[place], self.paired[place]


def byte_pairs(ranks: str):
    """The encoder of a byte-pair rank file; words come one by one, so that its pattern hardly matters."""
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("pairs", pat_str=r" ?[^ ]{1,64}", mergeable_ranks=table, special_tokens={})


def fertility(found: Fertility, data: np.ndarray, n: int, words: tuple) -> dict[str, np.ndarray]:
    """Characters a token, share of byte-fallback tokens and entropy in bits, by row; 0 where a row has no token."""
    starts, ends, rows, distinct, number = words
    first, lengths, paired = (x[number] for x in found.of(distinct))
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    ids = found.ids[np.repeat(first - begin, lengths) + np.arange(total)]
    row = np.repeat(rows, lengths)
    tokens = tx.per_row(row, n)
    chars = tx.per_row(rows, n, tx.count_in(tx.LEAD[data], starts, ends))
    fallback = tx.per_row(row, n, found.is_byte[ids])
    keys = np.sort(row.astype(np.int64) << 32 | ids)
    edges = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(edges, append=len(keys)).astype(float)
    loss = tx.per_row((keys[edges] >> 32).astype(np.int64), n, counts * np.log2(counts)) if len(edges) else np.zeros(n)
    some = np.maximum(tokens, 1)
    return {
        "tokens": tokens,
        "chars_per_token": chars / some,
        "chars_per_pair": chars / np.maximum(tx.per_row(rows, n, paired), 1),
        "fallback_share": fallback / some,
        "token_entropy": np.maximum(0.0, np.log2(some) - loss / some),
    }


def scripts_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The most frequent script of each row's letters, as an index of SCRIPTS; ``other`` without any."""
    kinds = _SCRIPT_OF[data]
    counts = np.stack([tx.count_in(kinds == s, offsets[:-1], offsets[1:]) for s in range(len(SCRIPTS))])
    return np.where(counts.max(0) > 0, counts.argmax(0), len(SCRIPTS) - 1)


def judge(data: np.ndarray, offsets: np.ndarray, rules: Rules, found: Fertility) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    out, words = base_counts(data, offsets)
    out |= fertility(found, data, n, words)
    script = scripts_of(data, offsets)
    out["script"] = np.array(SCRIPTS, object)[script]
    bands = [rules.bands[s] for s in SCRIPTS]
    low, high, fewest, most, fallback, ratio = (np.array(x)[script] for x in zip(*((*b.chars_per_token, *b.chars_per_pair, b.fallback_share, b.entropy_ratio) for b in bands), strict=True))
    out["base_failed"] = (out["n_words"] < rules.least_words) | (100 * out["n_repeat_words"] > rules.most_repeated * out["n_words"])
    # a text of n tokens can't have more than log2(n) bits, nor does prose go far beyond 2 ** 10 kinds
    reach = np.minimum(np.log2(np.maximum(out["tokens"], 2)), 10.0)
    fits = (out["chars_per_token"] >= low) & (out["chars_per_token"] <= high) & (out["chars_per_pair"] >= fewest) & (out["chars_per_pair"] <= most)
    fits &= (out["fallback_share"] <= fallback) & (out["token_entropy"] >= ratio * reach)
    out["kept"] = ~out["base_failed"] & fits
    return out


def quality_rules(documents: DataFrame, rules: Rules, keep: list[str] | None = None) -> DataFrame:
    """Counts, measures and verdict for every document, by one narrow pass without a shuffle.

    Null and empty texts have no word: all counts are 0, base_failed is true and kept false.
    Repeated rows are judged alike, each on its own; ids may be null. Other columns are not read,
    unless ``keep`` names columns of the documents: then these columns alone, of kept rows alone, return.
    """
    share_path(documents.sparkSession)
    names = SCHEMA if keep is None else documents.select(*keep).schema

    def run(batches):
        found = Fertility(rules)
        for b in batches:
            cols = tx.per_block(b["text"], lambda data, offsets: judge(data, offsets, rules, found), 8 * tx.BLOCK_BYTES)
            if keep is not None:
                yield b.filter(pa.array(cols["kept"], pa.bool_()))
                continue
            fields = [c.split()[0] for c in SCHEMA.split(", ")[1:]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(cols[c]) for c in fields)], ["doc_id", *fields])

    source = documents.select("doc_id", "text") if keep is None else documents.select(*keep)
    return source.mapInArrow(lean(run), names)
