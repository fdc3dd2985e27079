"""Parameters of the two approximate indexes, checked when made."""

from __future__ import annotations

import math
from dataclasses import dataclass

from simvane.errors import InvalidConfig


def _check(ok: bool, reason: str) -> None:
    if not ok:
        raise InvalidConfig(reason)


@dataclass(frozen=True)
class HnswConfig:
    """Edges kept a layer (m; m0 on layer 0), beam widths of build and search, and the level draw's scale."""

    m: int = 16
    m0: int | None = None
    ef_construction: int = 100
    ef_search: int = 50
    ml: float | None = None
    heuristic: bool = True
    seed: int = 42

    def __post_init__(self) -> None:
        _check(self.m >= 2, "m must be 2 or more")
        if self.m0 is None:
            object.__setattr__(self, "m0", 2 * self.m)
        if self.ml is None:
            object.__setattr__(self, "ml", 1 / math.log(self.m))
        _check(self.m0 >= self.m, "m0 must not be less than m")
        _check(self.ef_construction > 0 and self.ef_search > 0, "beam widths must be positive")
        _check(self.ml > 0, "ml must be positive")

    def max_edges(self, layer: int) -> int:
        return self.m0 if layer == 0 else self.m


@dataclass(frozen=True)
class IvfPqConfig:
    """Coarse lists and probes, subspaces and entries of the codebook, and the training's limits.

    ``max_train_points`` None trains on all rows; a number trains on that many, by the order of an id's hash.
    """

    nlist: int = 64
    nprobe: int = 8
    m: int = 8
    ksub: int = 256
    max_iters: int = 25
    tolerance: float = 1e-4
    max_train_points: int | None = None
    seed: int = 42

    def __post_init__(self) -> None:
        _check(self.nlist > 0, "nlist must be positive")
        _check(0 < self.nprobe <= self.nlist, "nprobe must lie in 1..nlist")
        _check(self.m > 0, "m must be positive")
        _check(1 <= self.ksub <= 256, "ksub must lie in 1..256")
        _check(self.max_iters > 0, "max_iters must be positive")
        _check(self.tolerance >= 0, "tolerance must not be negative")

    def check_dimension(self, dimension: int) -> None:
        _check(dimension % self.m == 0, f"dimension {dimension} is not a multiple of m = {self.m}")
