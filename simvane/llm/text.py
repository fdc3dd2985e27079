"""Vectorised views of Arrow text columns: bytes, spans of words or lines, and 64-bit span hashes.

All functions work on UTF-8 bytes, so that one pass over a block of documents costs a few
NumPy operations a byte. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a single longer document forms a block of its own.
BLOCK_BYTES = 1 << 17

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that begin a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows (first, last + 1, bytes, offsets) of at most ``most`` bytes, or one row."""
    data, offsets = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def per_block(column: pa.Array, f: Callable[[np.ndarray, np.ndarray], dict], most: int = BLOCK_BYTES) -> dict[str, np.ndarray]:
    """Concatenates what ``f(bytes, offsets)`` returns, an array a row for each name, over all blocks."""
    parts = [f(data, offsets) for _, _, data, offsets in blocks(column, most)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else f(np.zeros(0, np.uint8), np.zeros(1, np.int64))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` bytes; a run never crosses a row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each start lies in."""
    return np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for blocks, made anew for a longer text."""
    if "up" not in _powers or n > len(_powers["up"]):
        made = {}
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            table = np.full(max(n, 2 * BLOCK_BYTES + 1), base, np.uint64)
            table[0] = 1
            made[name] = np.multiply.accumulate(table)
        if n > 2 * BLOCK_BYTES + 1:
            return made["up"], made["down"]
        _powers.update(made)
    return _powers["up"], _powers["down"]


class SpanHash:
    """Hashes any span of a block in constant time, alike for alike bytes: for features, where a rare collision changes nothing; equality is told by ``distinct``."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self._down = _power_table(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * up[:n], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])


def spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run, one run after another."""
    begin = np.cumsum(lengths) - lengths
    return np.repeat(first - begin, lengths) + np.arange(int(lengths.sum()))


def sums(lengths: np.ndarray) -> np.ndarray:
    """Running sums, from 0 on."""
    return np.concatenate([[0], np.cumsum(lengths)])


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow array over the bytes between offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def distinct(data: np.ndarray, lengths: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct ones of spans that follow one another in ``data``, compared byte by byte, and the number of each span's."""
    if not len(lengths):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    coded = binary(data, sums(lengths)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def count_in(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each span."""
    sums = np.zeros(len(flags) + 1, np.int32)  # a row holds less than 2 ** 31 bytes
    np.cumsum(flags.view(np.uint8), dtype=np.int32, out=sums[1:])
    return (sums[ends] - sums[starts]).astype(np.int64)


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts, or sums of weights, by row."""
    found = np.bincount(rows, weights, n)
    return found if weights is not None else found.astype(np.int64)
