"""BPE encoding by an automaton over tokens, and decoding by its arcs' labels.

The automaton's state is the token read last, its arcs are labelled with tokens, and the paths from
the start are exactly the token sequences that applying all merges can yield. It is compiled by one
gadget a merge, in the merges' order. The gadget of (u, v) -> w

- adds the state w, with the arcs that state v has by now,
- adds an arc w wherever an arc u stands by now,
- takes away the arc v of state u, and for u = v also the new arc w of state u: of three u in a row
  the first two merge.

A state's row and a token's column are thus copies of others' but for what gadgets took away. They are
compiled into integer tables that keep it so: which row and column each token copied, at which gadget,
and a hash table of the arcs taken away; a full table of 49,000 x 49,000 arcs would say the same in 300
MB. A transition reads these tables alone, for many words at once. The vocabulary's spellings are a trie
in a hash table. The driver compiles once and broadcasts the tables, some 15 MB whatever the corpus.

A word has one path. Of the tokens that begin at a position, read from the trie, those with an arc from
the position's state set the states of the positions where they end; every position that a path reaches
has one state. Texts are split, words made distinct and paths followed in blocks, by array operations;
words met before come from a memory of bounded size that lives as long as a task.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from simvane.llm.text import binary, spread, sums
from simvane.session import lean, share_path

END = "</w>"
#: Fixed pattern of the vocabulary's words; marks of elision stand alone, digits too.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Ranges on whose letters, digits, spaces and cases the installed libraries' versions of Unicode agree.
AGREED = ((0x0, 0x557), (0x20A0, 0xA7CA), (0xAC00, 0xD7A3))
#: Bytes of text split and encoded at once; a longer text forms a block of its own, in pieces cut at spaces.
BLOCK = 1 << 20
#: Distinct words that a task keeps, and their bytes; beyond it the memory starts anew, which only costs time.
MOST_WORDS, MOST_BYTES = 250_000, 8 << 20
#: Words longer than this follow their path one by one, and aren't kept.
LONG = 64


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Lookup:
    """A hash table of non-negative 64-bit keys with open addressing, for arrays of keys."""

    def __init__(self, items: dict[int, int]):
        self.bits = max(4, int(np.ceil(np.log2(2 * len(items) + 1))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys, values = np.fromiter(items, np.int64, len(items)), np.fromiter(items.values(), np.int32, len(items))
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = left[self.keys[at] < 0]
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]  # of several for one slot the last one stays
            left = left[self.keys[at] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 for others."""
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[left]]
            same = held == keys[left]
            out[left[same]] = self.values[slot[left[same]]]
            left = left[~same & (held >= 0)]
        return out


class Automaton:
    """Tokens are numbers; ``letters`` have no parts. START precedes every token."""

    START, NONE = -1, -2

    def __init__(self, size: int, letters: list[int], merges: list[tuple[int, int, int]]):
        # the gadget that made a token, -1 for letters; the tokens whose column and row it copied
        self.born, self.column, self.row = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.column[letters] = self.row[letters] = letters
        gone: dict[int, int] = {}
        for step, (u, v, w) in enumerate(merges):  # the gadget of (u, v) -> w
            self.born[w], self.column[w], self.row[w] = step, u, v
            gone[u << 20 | v] = step
            if u == v:
                gone[u << 20 | w] = step
        self.gone, self.steps = Lookup(gone), len(merges)

    def arcs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether arc b leaves state a, for arrays of states and tokens."""
        stands = a == self.START
        at = np.flatnonzero(~stands)
        a, b, step = a[at], b[at], np.full(len(at), self.steps, np.int32)
        while len(at):
            taken = self.gone(a.astype(np.int64) << 20 | b)
            age_a, age_b = self.born[a], self.born[b]
            age = np.maximum(age_a, age_b)
            whole = (taken < 0) | (taken >= step)  # an arc that no gadget before took away
            stands[at[whole & (age < 0)]] = True
            left = np.flatnonzero(whole & (age >= 0))
            at, a, b, step = at[left], a[left], b[left], age[left]
            a, b = np.where(age_a[left] == step, self.row[a], a), np.where(age_b[left] == step, self.column[b], b)
        return stands


class Tables:
    """A vocabulary file of lower-case words with word ends, compiled: what the encoder and decoder read."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            self.file = f.read()
        spec = json.loads(self.file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for label, i in [*vocab.items(), *self.special.items()]:
            names[i] = label
        self.labels = pa.array([f"{label} " for label in names], pa.large_string())
        symbols = {c: b for b, c in enumerate(letters)} | {c + END: 256 + b for b, c in enumerate(letters)}
        spelling = {vocab[s]: (n,) for s, n in symbols.items()}
        merges = []
        for pair in spec["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            merges.append((u, v, w))
            spelling[w] = spelling[u] + spelling[v]
        self.automaton = Automaton(len(names), [vocab[s] for s in symbols], merges)
        # special tokens are spelled by bytes that no text holds
        spelling |= {i: tuple(mark(k)[:-1]) + (256 + mark(k)[-1],) for k, i in enumerate(self.special.values())}
        trie: dict[int, int] = {}
        ends = [-1]
        for token, word in spelling.items():
            node = 0
            for s in word:
                key = node << 9 | s
                if key not in trie:
                    trie[key] = len(ends)
                    ends.append(-1)
                node = trie[key]
            ends[node] = token
        self.trie, self.ends = Lookup(trie), np.array(ends, np.int32)


def mark(k: int) -> bytes:
    """Stands for the special token of number k, below 256, among the words."""
    return bytes([0xFF, k])


def character_classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 digit, 3 anything else; 4 more outside AGREED."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(0x110000, 3, np.uint8)
    for number, kind in enumerate((r"\p{White_Space}+", r"\p{L}+", r"\p{N}+")):
        for found in regex.finditer(kind, every):
            out[found.start() : found.end()] = number
    apart = np.ones(0x110000, bool)
    for lo, hi in AGREED:
        apart[lo : hi + 1] = False
    return out + np.uint8(4) * apart


def normalise(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    # one character at a time where lower case depends on its neighbours
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class Codec:
    """Encodes and decodes by compiled tables, with a memory of words."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.special = regex.compile("|".join(map(regex.escape, tables.special))) if tables.special else None
        self._classes = self._library = None
        self._byte = {c: b for b, c in enumerate(byte_letters())}
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)  # ids of word w: ids[first[w]:first[w + 1]]

    def _class_of(self, points: np.ndarray) -> np.ndarray:
        if self._classes is None:
            self._classes = character_classes()
        return self._classes[points]

    def _agreed(self, text: str) -> bool:
        return text.isascii() or bool((self._class_of(np.frombuffer(text.encode("utf-32-le"), np.uint32)) < 4).all())

    def _split(self, text: str) -> list[bytes]:
        """The words of a text with special tokens, which are found as it stands, or beyond AGREED, where the library decides."""
        out, at = [], 0
        for found in [*(self.special.finditer(text) if self.special else ()), None]:
            plain = text[at : found.start() if found else None]
            if self._agreed(plain):
                out += [w.encode() for w in WORDS.findall(normalise(plain))]
            else:
                if self._library is None:
                    from tokenizers import Tokenizer

                    self._library = Tokenizer.from_str(self.tables.file)
                words = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(plain))
                out += [bytes(self._byte[c] for c in w) for w, _ in words]
            if found:
                out.append(mark([*self.tables.special].index(found[0])))
                at = found.end()
        return out

    def words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The normalised words of texts, text by text, and each one's text."""
        odd = {i: self._split(t) for i, t in enumerate(texts) if ("<" in t and self.special and self.special.search(t)) or not self._agreed(t)}
        plain = ["" if i in odd else normalise(t) for i, t in enumerate(texts)]
        joined = "\n".join(plain)
        data = np.frombuffer(joined.encode(), np.uint8)
        if len(joined) == len(data):  # ASCII
            kind, lead = self._class_of(data), np.ones(len(data), bool)
        else:
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            width = np.ones(len(points), np.int8)
            for least in (0x80, 0x800, 0x10000):
                width += points >= least
            kind, lead = np.repeat(self._class_of(points) & 3, width), (data & 0xC0) != 0x80
        begins = np.ones(len(data), bool)
        begins[1:] = kind[1:] != kind[:-1]
        begins |= (kind == 2) & lead  # digits stand alone
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        solid = kind[starts] > 0
        starts, ends = starts[solid], ends[solid]
        # an apostrophe alone takes the letters of an elision from the word behind it
        at = np.flatnonzero((ends[:-1] - starts[:-1] == 1) & (data[starts[:-1]] == 0x27) & (starts[1:] == ends[:-1]) & (kind[starts[1:]] == 1)) if len(starts) > 1 else np.zeros(0, np.int64)
        if len(at):
            one = data[starts[at + 1]]
            two = np.where(ends[at + 1] - starts[at + 1] > 1, data[np.minimum(starts[at + 1] + 1, len(data) - 1)], 0)
            taken = np.where(np.isin(one, list(b"stmd")), 1, 0)
            for a, b in ("re", "ve", "ll"):
                taken[(one == ord(a)) & (two == ord(b))] = 2
            ends[at] += taken
            starts[at + 1] += taken
            some = ends > starts
            starts, ends = starts[some], ends[some]
        rows = np.searchsorted(sums(np.array([len(t.encode()) + 1 for t in plain])), starts, "right") - 1
        lengths, data = ends - starts, data[kind > 0]  # words hold all that isn't white space
        if odd:
            more = [w for i in odd for w in odd[i]]
            data = np.concatenate([data, np.frombuffer(b"".join(more), np.uint8)])
            lengths = np.concatenate([lengths, np.array([len(w) for w in more], np.int64)])
            rows = np.concatenate([rows, np.repeat([*odd], [len(w) for w in odd.values()])])
        found = binary(data, sums(lengths))
        if odd:
            order = np.argsort(rows, kind="stable")
            found, rows = found.take(pa.array(order)), rows[order]
        return found, rows

    def paths(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one word after another, and how many each has."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
        symbols = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)
        first, size = (offsets[:-1] - offsets[0]).astype(np.int32), np.diff(offsets).astype(np.int32)
        symbols[first + size - 1] += 256
        # all tokens that begin at each symbol, by walking the trie from all symbols at once
        tables, spans = self.tables, []
        begin = at = np.arange(len(symbols), dtype=np.int32)
        last, node = np.repeat(first + size, size), np.zeros(len(symbols), np.int64)
        while len(at):
            node = tables.trie(node << 9 | symbols[at])
            live = np.flatnonzero(node >= 0)
            begin, at, last, node = begin[live], at[live] + np.int32(1), last[live], node[live]
            token = tables.ends[node]
            ends = np.flatnonzero(token >= 0)
            spans.append((begin[ends], at[ends], token[ends]))
            live = np.flatnonzero(at < last)
            begin, at, last, node = begin[live], at[live], last[live], node[live].astype(np.int64)
        begin, end, token = (np.concatenate(x) for x in zip(*spans, strict=True))
        # states of positions: position p lies before symbol p of its word, the one behind its last symbol is its own too
        arcs, word = tables.automaton.arcs, np.repeat(np.arange(n, dtype=np.int32), size)
        home, own = first + np.arange(n, dtype=np.int32), word[begin]
        state, came = np.full(len(symbols) + n, Automaton.NONE, np.int32), np.zeros(len(symbols) + n, np.int32)
        state[home] = Automaton.START
        place = begin - first[own]
        begin, end = begin + own, end + own
        long = size[own] > LONG
        some = np.flatnonzero(~long)
        some = some[np.argsort(place[some].astype(np.uint8), kind="stable")]
        near = begin[some], end[some], token[some]
        edges = np.append(np.flatnonzero(np.diff(place[some], prepend=-1)), len(some))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):  # all words' tokens of one position at once
            b, e, t = (x[lo:hi] for x in near)
            m = np.flatnonzero((state[b] != Automaton.NONE) & (state[e] == Automaton.NONE))
            b, e, t = b[m], e[m], t[m]
            m = arcs(state[b], t)
            state[e[m]], came[e[m]] = t[m], b[m]
        some = np.flatnonzero(long)
        self._follow(begin, end, token, some[np.argsort(begin[some], kind="stable")], state, came)
        # back from the words' ends
        count, live, taken = np.zeros(n, np.int32), np.arange(n, dtype=np.int32), []
        now = home + size
        while len(live):
            taken.append((live, state[now]))
            count[live] += 1
            now = came[now]
            left = np.flatnonzero(now > home[live])
            live, now = live[left], now[left]
        out, place = np.zeros(int(count.sum()), np.uint32), np.cumsum(count) - 1
        for back, (w, t) in enumerate(taken):
            out[place[w] - back] = t
        return out, count

    def _follow(self, begin: np.ndarray, end: np.ndarray, token: np.ndarray, some: np.ndarray, state: np.ndarray, came: np.ndarray) -> None:
        """Sets the states of long words, whose tokens ``some`` come by position."""
        memory: dict[tuple[int, int], bool] = {}
        for lo in range(0, len(some), 1 << 16):
            part = some[lo : lo + (1 << 16)]
            for b, e, t in zip(begin[part].tolist(), end[part].tolist(), token[part].tolist(), strict=True):
                s = int(state[b])
                if s == Automaton.NONE or state[e] != Automaton.NONE:
                    continue
                stands = memory.get((s, t))
                if stands is None:
                    if len(memory) > MOST_WORDS:
                        memory.clear()
                    stands = memory[s, t] = bool(self.tables.automaton.arcs(np.array([s]), np.array([t]))[0])
                if stands:
                    state[e], came[e] = t, b

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, rows = self.words(texts)
        counts = np.zeros(len(texts), np.int64)
        if not len(words):
            return np.zeros(0, np.uint32), counts
        coded = words.dictionary_encode()
        distinct, code = coded.dictionary, coded.indices.to_numpy()
        place = pc.fill_null(pc.index_in(distinct, self.known), -1).to_numpy().astype(np.int64)
        new = place < 0
        known, first, all_ids = self.known, self.first, self.ids
        if new.any():
            fresh = distinct.filter(pa.array(new))
            ids, count = self.paths(fresh)
            place[new] = len(known) + np.arange(len(fresh))
            first, all_ids = np.concatenate([first, first[-1] + np.cumsum(count)]), np.concatenate([all_ids, ids])
            self._keep(fresh, ids, count)
        slot = place[code]
        lengths = first[slot + 1] - first[slot]
        counts += np.bincount(rows, lengths, len(texts)).astype(np.int64)
        return all_ids[spread(first[slot], lengths)], counts

    def _keep(self, fresh: pa.Array, ids: np.ndarray, count: np.ndarray) -> None:
        """Adds words to the memory, the long ones apart; it starts anew where it would grow too large."""
        short = pc.binary_length(fresh).to_numpy() <= LONG
        if not short.all():
            fresh, ids, count = fresh.filter(pa.array(short)), ids[np.repeat(short, count)], count[short]
        if len(self.known) + len(fresh) > MOST_WORDS or self.known.nbytes + fresh.nbytes > MOST_BYTES:
            self._clear()
        if len(fresh) <= MOST_WORDS and fresh.nbytes <= MOST_BYTES:
            self.known = pa.concat_arrays([self.known, fresh])
            self.first, self.ids = np.concatenate([self.first, self.first[-1] + np.cumsum(count)]), np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, one text after another, and how many each has."""
        ids, counts, block, size = [], np.zeros(len(texts), np.int64), [], 0
        for i, text in enumerate(texts):
            for piece in pieces(text):
                if block and size + len(piece) > BLOCK:
                    self._add(block, ids, counts)
                    block, size = [], 0
                block.append((i, piece))
                size += len(piece)
        if block:
            self._add(block, ids, counts)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts

    def _add(self, block: list[tuple[int, str]], ids: list[np.ndarray], counts: np.ndarray) -> None:
        found, n = self._block([piece for _, piece in block])
        ids.append(found)
        np.add.at(counts, [i for i, _ in block], n)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The labels of the arcs taken, joined by spaces, by text."""
        if not len(ids):
            return pa.array([""] * len(counts), pa.large_string())
        taken = self.tables.labels.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(ids) + 1]
        edges = ends[sums(counts)] - ends[0]
        data = np.frombuffer(taken.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        some = counts > 0
        kept = np.ones(len(data), bool)
        kept[edges[1:][some] - 1] = False  # the space behind a text's last label
        return binary(data[kept], edges - sums(some)).cast(pa.large_string())


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of some BLOCK characters, cut before an ASCII space, where no word, mark or special token spans."""
    at = 0
    while len(text) - at > BLOCK:
        cut = text.find(" ", at + BLOCK)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _mapped(df: DataFrame, vocabulary: str, source: str, added: str, columns: Callable[[Codec, pa.Array], list[pa.Array]]) -> DataFrame:
    """Adds ``columns(codec, values)`` of the column ``source``, in small batches; columns of these names are replaced."""
    share_path(df.sparkSession)
    names = [a.split()[0] for a in added.split(", ")]
    kept = [c for c in df.columns if c not in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{c}`" for c in kept]).schema.fields), added])
    types = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}
    kinds = [types[a.split()[1]] for a in added.split(", ")]
    tables = df.sparkSession.sparkContext.broadcast(Tables(vocabulary))

    def run(batches):
        codec = Codec(tables.value)
        for b in batches:
            lo, values = 0, b.column(b.schema.get_field_index(source))
            sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy()
            while lo < len(values):
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(sizes[lo:]), 2 * BLOCK, "right")))
                found = columns(codec, values.slice(lo, hi - lo))
                own = [b.column(b.schema.get_field_index(c)).slice(lo, hi - lo) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, *(x.cast(t) for x, t in zip(found, kinds, strict=True))], [*kept, *names])
                lo = hi

    return df.mapInArrow(lean(run), schema)


def _encoded(codec: Codec, values: pa.Array) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    ids, counts = codec.encode([x or "" for x in values.to_pylist()])
    return ids, counts, [pa.array(counts), binary(ids.astype("<u4").view(np.uint8), 4 * sums(counts))]


def encode_documents(documents: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens`` and ``ids``, the whole text's ids as little-endian unsigned 32-bit integers.

    A null text counts as an empty one and has no ids. Every row stands alone: repeated rows, null ids
    and other columns pass through, but for columns named like the added ones, which are replaced.
    """
    return _mapped(documents, vocabulary, text, "n_tokens long, ids binary", lambda codec, values: _encoded(codec, values)[2])


def decode_documents(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text that ``ids`` spell; null ids spell an empty text. Else as for encoding."""

    def columns(codec: Codec, values: pa.Array) -> list[pa.Array]:
        rows = [x or b"" for x in values.to_pylist()]
        return [codec.decode(np.frombuffer(b"".join(rows), "<u4"), np.array([len(x) // 4 for x in rows], np.int64))]

    return _mapped(encoded, vocabulary, ids, "decoded string", columns)


def encode_and_decode(documents: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Encoding, then decoding of the ids found, in one pass over the texts: adds ``n_tokens``, ``ids`` and ``decoded``."""

    def columns(codec: Codec, values: pa.Array) -> list[pa.Array]:
        ids, counts, found = _encoded(codec, values)
        return [*found, codec.decode(ids, counts)]

    return _mapped(documents, vocabulary, text, "n_tokens long, ids binary, decoded string", columns)
