"""Groups of a task's rows that come sorted by key, without holding more than one group and one batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each run of equal keys; runs of over ``most`` rows come in parts of that many."""
    import numpy as np

    open_key, parts, size = None, [], 0

    def close():
        return open_key, pa.Table.from_batches(parts)

    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(len(batch), bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for lo, hi in zip(starts, [*starts[1:], len(batch)], strict=True):
            key = tuple(c[lo] for c in columns)
            if key != open_key:
                if size:
                    yield close()
                open_key, parts, size = key, [], 0
            while lo < hi:
                take = hi - lo if most is None else min(hi - lo, most - size)
                parts.append(batch.slice(lo, take))
                size, lo = size + take, lo + take
                if size == most:
                    yield close()
                    parts, size = [], 0
    if size:
        yield close()
