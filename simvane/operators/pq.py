"""Product quantization: codebooks for slices of a vector, codes, decoding and table lookups."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from simvane.errors import InvalidConfig
from simvane.functions.metrics import Metric, parse, score_matrix
from simvane.operators import kmeans
from simvane.operators.vectors import check_dimension, dimension, listed, matrix
from simvane.session import share_path


@dataclass(frozen=True)
class ProductQuantizer:
    """A codebook (m, ksub, d / m); a code holds one entry number a slice."""

    codebook: np.ndarray

    def __post_init__(self) -> None:
        if self.codebook.ndim != 3 or not 1 <= self.codebook.shape[1] <= 256:
            raise InvalidConfig("a codebook has shape (m, 1 to 256, d / m)")

    @property
    def m(self) -> int:
        return self.codebook.shape[0]

    @property
    def ksub(self) -> int:
        return self.codebook.shape[1]

    @property
    def dimension(self) -> int:
        return self.codebook.shape[0] * self.codebook.shape[2]

    def sub_centroid(self, m: int, k: int) -> np.ndarray:
        return self.codebook[m, k]

    def slices(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), self.m, -1)

    def encode(self, x: np.ndarray, metric: str | Metric = "l2") -> np.ndarray:
        """Codes (n, m) as unsigned bytes; of equal entries the first."""
        parts = self.slices(x)
        return np.stack([kmeans.nearest(parts[:, i], self.codebook[i], metric)[0] for i in range(self.m)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.codebook[i][codes[:, i]] for i in range(self.m)], 1)

    def lookup_table(self, query: np.ndarray, metric: str | Metric) -> np.ndarray:
        """(m, ksub) scores of a query's slices with the codebook's entries."""
        parts = query.reshape(self.m, 1, -1)
        return np.concatenate([score_matrix(metric, parts[i], self.codebook[i]) for i in range(self.m)])

    def table_scores(self, table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Sums of the table's entries that the codes select: the slices' scores, not the whole vectors'."""
        return table[np.arange(self.m), codes].sum(1)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(m, k, centroid)."""
        rows = [(i, j, self.codebook[i, j].tolist()) for i in range(self.m) for j in range(self.ksub)]
        return spark.createDataFrame(rows, "m int, k int, centroid array<double>")


def train(vectors: DataFrame, m: int, ksub: int = 256, max_iters: int = 25, tolerance: float = 1e-4, metric: str | Metric = "l2", seed: int = 42) -> ProductQuantizer:
    """k-means in every slice, all slices in one job a step.

    With fewer rows than entries the rest of the codebook is zero vectors, which codes may select.
    """
    dim = dimension(vectors)
    if m <= 0 or dim % m:
        raise InvalidConfig(f"dimension {dim} is not a multiple of m = {m}")
    share_path(vectors.sparkSession)
    start = kmeans.random_rows(vectors, ksub, seed)
    own = start.reshape(len(start), m, dim // m).transpose(1, 0, 2)
    codebook = np.zeros((m, ksub, dim // m))
    codebook[:, : len(start)] = kmeans.lloyd(vectors, own, max_iters, tolerance, parse(metric), seed)[0]
    return ProductQuantizer(codebook)


def encode(vectors: DataFrame, quantizer: ProductQuantizer, metric: str | Metric = "l2") -> DataFrame:
    """(id, code array<smallint>) of ``vectors`` (id, embedding)."""
    check_dimension(quantizer.dimension, vectors)
    share_path(vectors.sparkSession)
    sent, m = vectors.sparkSession.sparkContext.broadcast(quantizer), parse(metric)

    def run(batches):
        for b in batches:
            codes = sent.value.encode(matrix(b["embedding"], sent.value.dimension), m)
            yield pa.RecordBatch.from_arrays([b["id"], code_list(codes)], ["id", "code"])

    return vectors.select("id", "embedding").mapInArrow(run, "id long, code array<smallint>")


def decode(codes: DataFrame, quantizer: ProductQuantizer) -> DataFrame:
    """(id, embedding array<double>) that the codes (id, code) stand for."""
    share_path(codes.sparkSession)
    sent = codes.sparkSession.sparkContext.broadcast(quantizer)

    def run(batches):
        for b in batches:
            q = sent.value
            yield pa.RecordBatch.from_arrays([b["id"], listed(q.decode(code_matrix(b["code"], q.m)))], ["id", "embedding"])

    return codes.select("id", "code").mapInArrow(run, "id long, embedding array<double>")


def lookup_tables(queries: DataFrame, quantizer: ProductQuantizer, metric: str | Metric = "l2") -> DataFrame:
    """(query_id, m, k, score): each query's whole table, a row an entry."""
    check_dimension(quantizer.dimension, queries)
    share_path(queries.sparkSession)
    sent, metric = queries.sparkSession.sparkContext.broadcast(quantizer), parse(metric)

    def run(batches):
        q = sent.value
        m, k = (x.ravel().astype(np.int32) for x in np.meshgrid(np.arange(q.m), np.arange(q.ksub), indexing="ij"))
        for b in batches:
            for i, x in zip(b["query_id"].to_pylist(), matrix(b["embedding"], q.dimension), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), i, np.int64)), pa.array(m), pa.array(k), pa.array(q.lookup_table(x, metric).ravel())], ["query_id", "m", "k", "score"])

    return queries.select("query_id", "embedding").mapInArrow(run, "query_id long, m int, k int, score double")


def code_list(codes: np.ndarray) -> pa.Array:
    n, m = codes.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m), pa.int32()), pa.array(codes.astype(np.int16).ravel()))


def code_matrix(column: pa.Array, m: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(-1, m)
