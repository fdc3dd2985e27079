"""Ten vector metrics: as SQL expressions over two arrays and as NumPy kernels over blocks of vectors.

Both forms compute in double precision. A similarity (dot product, cosine) is better when higher, a
distance when lower; scores are the raw values of the metric, never negated.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from simvane.errors import VectorIndexError

#: Denominators up to this count as zero: such a cosine or Jaccard score is 0.
TINY = 1e-9
#: Components differ, for Hamming, by more than this.
DIFFERS = 1e-6


class Metric(Enum):
    """Value: (name, code in files, code on the wire)."""

    # The codes of the file formats and of the search protocol.
    L2 = ("l2", 0, 1)
    DOT = ("dot", 1, 2)
    COSINE = ("cosine", 2, 3)
    MANHATTAN = ("manhattan", 3, 4)
    MINKOWSKI = ("minkowski", 4, 5)
    CHEBYSHEV = ("chebyshev", 5, 6)
    HAMMING = ("hamming", 6, 7)
    MAHALANOBIS = ("mahalanobis", 7, 8)
    JACCARD = ("jaccard", 8, 9)
    HELLINGER = ("hellinger", 9, 10)

    @property
    def label(self) -> str:
        return self.value[0]

    @property
    def file_code(self) -> int:
        return self.value[1]

    @property
    def wire_code(self) -> int:
        return self.value[2]

    @property
    def higher_is_better(self) -> bool:
        return self in (Metric.DOT, Metric.COSINE)


#: Order of Minkowski's metric where an index uses it.
MINKOWSKI_ORDER = 3.0

# Names accepted for each metric, beside its label.
ALIASES = {
    Metric.L2: "l2_squared l2squared euclidean",
    Metric.DOT: "dot_product dotproduct inner_product",
    Metric.COSINE: "cosine_similarity cos",
    Metric.MANHATTAN: "l1",
    Metric.MINKOWSKI: "lp",
    Metric.CHEBYSHEV: "linf l_inf",
    Metric.HAMMING: "l0",
    Metric.MAHALANOBIS: "",
    Metric.JACCARD: "tanimoto",
    Metric.HELLINGER: "",
}
_BY_NAME = {name: m for m, names in ALIASES.items() for name in (m.label, *names.split())}


@dataclass(frozen=True)
class Order:
    """Minkowski's metric of any order above 0, for exact searches."""

    p: float
    higher_is_better = False

    def __post_init__(self) -> None:
        if not self.p > 0:
            raise VectorIndexError("the order must be positive")

    @property
    def label(self) -> str:
        return f"minkowski({self.p:g})"


@dataclass(frozen=True)
class Precision:
    """Mahalanobis' metric under an inverse covariance, for exact searches: one value a component, or all rows one after another."""

    values: tuple[float, ...]
    higher_is_better = False
    label = "mahalanobis(precision)"

    def matrix(self, dim: int) -> np.ndarray:
        if len(self.values) == dim:
            return np.diag(self.values)
        if len(self.values) == dim * dim:
            return np.array(self.values).reshape(dim, dim)
        raise VectorIndexError("the precision fits neither a diagonal nor a matrix of this dimension")


def parse(name: str | Metric | Order | Precision, strict: bool = True) -> Metric | Order | Precision:
    """The metric of a name in any case; an unknown one raises, or without ``strict`` means L2. Metrics stay themselves."""
    if isinstance(name, Metric | Order | Precision):
        return name
    found = _BY_NAME.get(name.strip().lower())
    if found is None:
        if strict:
            raise VectorIndexError(f"unknown metric {name!r}")
        return Metric.L2
    return found


def from_file_code(code: int) -> Metric:
    for m in Metric:
        if m.file_code == code:
            return m
    raise VectorIndexError(f"unknown metric code {code}")


def from_wire_code(code: int) -> Metric | None:
    """None for 0 and for unknown codes: the request leaves the metric open."""
    return next((m for m in Metric if m.wire_code == code), None)


# SQL expressions


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _paired(a: Column, b: Column, f) -> Column:
    return F.zip_with(doubles(a), doubles(b), f)


def minkowski_expr(a: Column, b: Column, p: float) -> Column:
    """The order-p metric for any p > 0, with plain forms for 1, 2 and 3."""
    if p <= 0:
        raise VectorIndexError("the order must be positive")
    if abs(p - 1) < 1e-5:
        return total(_paired(a, b, lambda x, y: F.abs(x - y)))
    if abs(p - 2) < 1e-5:
        return F.sqrt(total(_paired(a, b, lambda x, y: (x - y) * (x - y))))
    if abs(p - 3) < 1e-5:
        return F.cbrt(total(_paired(a, b, lambda x, y: F.abs(x - y) * (x - y) * (x - y))))
    return F.pow(total(_paired(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1 / p))


def mahalanobis_expr(a: Column, b: Column, precision: list[float]) -> Column:
    """With an inverse covariance: one value a component, or all rows one after another; negative sums count as 0."""
    side = int(round(len(precision) ** 0.5))
    difference = _paired(a, b, lambda x, y: x - y)
    weights = F.array(*[F.lit(float(x)) for x in precision])
    diagonal = total(F.zip_with(difference, weights, lambda d, w: d * d * w))
    row = F.transform(difference, lambda d, i: d * total(F.zip_with(difference, F.slice(weights, i * F.size(difference) + 1, F.size(difference)), lambda e, w: e * w)))
    whole = total(row)
    size = F.size(difference)
    chosen = F.when(size == len(precision), diagonal)
    if side * side == len(precision):
        chosen = chosen.when(size == side, whole)
    failed = F.raise_error(F.lit("the precision fits neither a diagonal nor a matrix of this dimension")).cast("double")
    return F.sqrt(F.greatest(chosen.otherwise(failed), F.lit(0.0)))


def score_expr(metric: str | Metric, a: Column, b: Column) -> Column:
    """The score of two arrays of one length, as a double."""
    m = parse(metric)
    if isinstance(m, Order):
        return minkowski_expr(a, b, m.p)
    if isinstance(m, Precision):
        return mahalanobis_expr(a, b, list(m.values))
    if m is Metric.L2:
        return total(_paired(a, b, lambda x, y: (x - y) * (x - y)))
    if m is Metric.DOT:
        return total(_paired(a, b, lambda x, y: x * y))
    if m is Metric.COSINE:
        norms = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
        return F.when(norms <= TINY, F.lit(0.0)).otherwise(total(_paired(a, b, lambda x, y: x * y)) / norms)
    if m is Metric.MANHATTAN:
        return minkowski_expr(a, b, 1)
    if m is Metric.MINKOWSKI:
        return F.cbrt(total(_paired(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(3.0)))))
    if m is Metric.CHEBYSHEV:
        return F.coalesce(F.array_max(_paired(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0))
    if m is Metric.HAMMING:
        return total(_paired(a, b, lambda x, y: F.when(F.abs(x - y) > DIFFERS, F.lit(1.0)).otherwise(F.lit(0.0))))
    if m is Metric.MAHALANOBIS:
        return minkowski_expr(a, b, 2)
    if m is Metric.JACCARD:
        larger = total(_paired(a, b, lambda x, y: F.greatest(F.abs(x), F.abs(y))))
        return F.when(larger <= TINY, F.lit(0.0)).otherwise(1 - total(_paired(a, b, lambda x, y: F.least(F.abs(x), F.abs(y)))) / larger)
    return F.sqrt(0.5 * total(_paired(a, b, lambda x, y: F.pow(F.sqrt(F.abs(x)) - F.sqrt(F.abs(y)), F.lit(2.0)))))


def squared_norm(v: Column) -> Column:
    return total(F.transform(doubles(v), lambda x: x * x))


def residual(v: Column, centroid: Column) -> Column:
    return _paired(v, centroid, lambda x, y: x - y)


def subvector(v: Column, m: int | Column, size: int) -> Column:
    """Components ``m * size`` to ``(m + 1) * size - 1``."""
    return F.slice(v, (F.lit(m) if isinstance(m, int) else m) * size + 1, size)


# NumPy kernels

_BLOCK = 1 << 21  # doubles of differences held at once


def score_matrix(metric: str | Metric, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Scores of each query (row) with each vector (column), in double precision."""
    m = parse(metric)
    q, x = np.asarray(queries, np.float64), np.asarray(vectors, np.float64)
    if m in (Metric.DOT, Metric.COSINE):
        dots = q @ x.T
        if m is Metric.DOT:
            return dots
        norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
        return np.where(norms <= TINY, 0.0, dots / np.where(norms <= TINY, 1.0, norms))
    out = np.empty((len(q), len(x)))
    width = max(1, _BLOCK // max(1, x.shape[1] * max(1, len(q))))
    for lo in range(0, len(x), width):
        part = x[None, lo : lo + width, :]
        out[:, lo : lo + width] = _distances(m, q[:, None, :], part)
    return out


def _distances(m: Metric | Order | Precision, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if isinstance(m, Precision):
        d = q - x
        return np.sqrt(np.maximum(np.einsum("...i,...i", d @ m.matrix(d.shape[-1]), d), 0.0))
    if isinstance(m, Order):
        return (np.abs(q - x) ** m.p).sum(-1) ** (1 / m.p)
    if m is Metric.HELLINGER:
        return np.sqrt(0.5 * ((np.sqrt(np.abs(q)) - np.sqrt(np.abs(x))) ** 2).sum(-1))
    if m is Metric.JACCARD:
        a, b = np.abs(q), np.abs(x)
        larger = np.maximum(a, b).sum(-1)
        return np.where(larger <= TINY, 0.0, 1 - np.minimum(a, b).sum(-1) / np.where(larger <= TINY, 1.0, larger))
    d = q - x
    if m is Metric.L2:
        return np.einsum("...i,...i", d, d)
    if m is Metric.MAHALANOBIS:
        return np.sqrt(np.einsum("...i,...i", d, d))
    d = np.abs(d)
    if m is Metric.MANHATTAN:
        return d.sum(-1)
    if m is Metric.MINKOWSKI:
        return np.cbrt((d * d * d).sum(-1))
    if m is Metric.CHEBYSHEV:
        return d.max(-1, initial=0.0)
    return (d > DIFFERS).sum(-1).astype(float)


def badness(metric: str | Metric, scores: np.ndarray) -> np.ndarray:
    """Keys that sort best first: similarities negated, NaN last."""
    keys = -scores if parse(metric).higher_is_better else scores
    return np.where(np.isnan(keys), np.inf, keys)
