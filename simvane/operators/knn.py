"""Exact k-nearest-neighbour joins of a query set with a vector table.

Queries that fit in one block go out to every task, which scores its vectors with NumPy, tile by tile, and
keeps k candidates a query; one shuffle of these candidates and a top-k a query give the result. More
queries than that are packed into blocks where they are, and meet the packed blocks of vectors in a product
of blocks: vectors are scanned once, no query passes through the driver, and a task holds one block of each.
In the replicated form the vectors go out instead, if they are few enough, and the queries stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simvane.errors import DimensionMismatch, InvalidArgument
from simvane.functions.metrics import Metric, parse, score_expr, score_matrix
from simvane.operators.topk import BlockTopK, top_k
from simvane.operators.vectors import check_dimension, dimension, matrix
from simvane.session import share_path

#: Bytes of vectors, as doubles, that are sent to every task at once; blocks that meet one another have a quarter.
SENT_BYTES = 64 << 20
RESULT = "query_id long, id long, score double"


def query_blocks(queries: DataFrame, dim: int, most_bytes: int = SENT_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the queries in blocks; the driver holds one block at a time."""
    size = max(1, most_bytes // (8 * dim))
    ids: list[int] = []
    rows: list[list[float]] = []
    for r in queries.select("query_id", "embedding").toLocalIterator(prefetchPartitions=False):
        ids.append(r["query_id"])
        rows.append(r["embedding"])
        if len(ids) == size:
            yield np.array(ids, np.int64), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float64)


_Block = tuple[np.ndarray, np.ndarray, np.ndarray | None]  # query ids, vectors, and the shards that they ask


def _one_block(queries: DataFrame, dim: int, own_shards: bool) -> _Block | None:
    """The queries if they fit in one block."""
    size = max(1, SENT_BYTES // (8 * dim))
    rows = queries.select("query_id", "embedding", *(["shard_id"] if own_shards else [])).limit(size + 1).collect()
    if len(rows) > size:
        return None
    ids, x = np.array([r["query_id"] for r in rows], np.int64), np.array([r["embedding"] for r in rows], np.float64).reshape(-1, dim)
    return ids, x, np.array([r["shard_id"] for r in rows], np.int32) if own_shards else None


class _Meeting:
    """What a task holds for a block of queries: the best rows of all, or of each shard, or of the queries' own shards."""

    def __init__(self, block: _Block, k: int, metric: Metric):
        self.ids, self.q, self.own = block
        self.k, self.metric = k, metric
        self.held: dict[int | None, tuple[np.ndarray, BlockTopK]] = {}

    def add(self, x: np.ndarray, ids: np.ndarray, shards: np.ndarray | None) -> None:
        for shard in np.unique(shards).tolist() if shards is not None else (None,):
            if shard not in self.held:
                asking = np.arange(len(self.q)) if self.own is None else np.flatnonzero(self.own == shard)
                self.held[shard] = asking, BlockTopK(len(asking), self.k, self.metric)
            asking, best = self.held[shard]
            mine = slice(None) if shard is None else shards == shard
            q, xs = self.q[asking], x[mine]
            best.add(lambda a, b, q=q, xs=xs: score_matrix(self.metric, q[a], xs[b]), ids[mine])

    def candidates(self) -> Iterator[pa.RecordBatch]:
        for shard, (asking, best) in self.held.items():
            i, found, score = best.columns()
            columns, names = [pa.array(self.ids[asking][i]), pa.array(found), pa.array(score)], ["query_id", "id", "score"]
            if shard is not None:
                columns.append(pa.array(np.full(len(i), shard, np.int32)))
                names.append("shard_id")
            yield pa.RecordBatch.from_arrays(columns, names)


def packed(df: DataFrame, key: str, dim: int, rows: int, shards: bool = False) -> DataFrame:
    """A table's vectors in blocks of at most ``rows`` rows: (ids, x, shards) as bytes."""

    def run(batches):
        ids, x, own = [], [], []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (np.concatenate(ids), np.concatenate(x), np.concatenate(own))], ["ids", "x", "shards"])

        held = 0
        for b in batches:
            for lo in range(0, len(b), rows):
                part = b.slice(lo, min(rows, len(b) - lo))
                if held + len(part) > rows:
                    yield block()
                    ids, x, own, held = [], [], [], 0
                ids.append(part[key].to_numpy(zero_copy_only=False).astype(np.int64))
                x.append(matrix(part["embedding"], dim))
                own.append(part["shard_id"].to_numpy(zero_copy_only=False).astype(np.int32) if shards else np.zeros(0, np.int32))
                held += len(part)
        if held:
            yield block()

    return df.select(key, "embedding", *(["shard_id"] if shards else [])).mapInArrow(run, "ids binary, x binary, shards binary")


def _local(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric, dim: int, per_shard: bool, own_shards: bool = False) -> DataFrame | None:
    """Candidates of every query: a task's k best; with ``per_shard`` each shard's, and its number, with ``own_shards`` of the query's own alone. None without queries."""
    schema = RESULT + (", shard_id int" if per_shard else "")
    one = _one_block(queries, dim, own_shards)
    if one is not None:
        if not len(one[0]):
            return None
        sent = vectors.sparkSession.sparkContext.broadcast(one)

        def run(batches):
            met = _Meeting(sent.value, k, metric)
            for b in batches:
                met.add(matrix(b["embedding"], dim), b["id"].to_numpy(zero_copy_only=False), b["shard_id"].to_numpy(zero_copy_only=False) if per_shard else None)
            yield from met.candidates()

        return vectors.select("id", "embedding", *(["shard_id"] if per_shard else [])).mapInArrow(run, schema)
    rows = max(1, SENT_BYTES // (32 * dim))
    mine = packed(vectors, "id", dim, rows, per_shard)
    others = packed(queries, "query_id", dim, rows, own_shards).select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "x", "shards")])

    def meet(batches):
        for b in batches:
            for row in zip(*(b[c] for c in ("ids", "x", "shards", "q_ids", "q_x", "q_shards")), strict=True):
                ids, x, shards, q_ids, q_x, q_shards = (np.frombuffer(v.as_buffer(), t) for v, t in zip(row, (np.int64, np.float64, np.int32) * 2, strict=True))
                met = _Meeting((q_ids, q_x.reshape(-1, dim), q_shards if own_shards else None), k, metric)
                met.add(x.reshape(-1, dim), ids, shards if per_shard else None)
                yield from met.candidates()

    return mine.crossJoin(others).mapInArrow(meet, schema)


def _empty(vectors: DataFrame, extra: str = "") -> DataFrame:
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double" + extra)


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2", strategy: str = "sharded") -> DataFrame:
    """(query_id, rank, id, score): each query's k best rows of ``vectors`` (id, embedding), ties by id.

    ``strategy`` "sharded" sends the queries (query_id, embedding) to the vectors, "replicated" the
    vectors to the queries, which fails beyond SENT_BYTES. k beyond the number of rows returns them all.
    Without vectors it raises EmptyIndex, for other lengths DimensionMismatch; without queries or for
    k = 0 there are no rows. Repeated ids are rows of their own; other columns are not read.
    """
    m = parse(metric)
    if k < 0:
        raise InvalidArgument("k must not be negative")
    dim = dimension(vectors)
    check_dimension(dim, queries)
    share_path(vectors.sparkSession)
    if k == 0:
        return _empty(vectors)
    if strategy == "replicated":
        return _replicated(vectors, queries, k, m, dim)
    if strategy != "sharded":
        raise InvalidArgument(f"unknown strategy {strategy!r}")
    found = _local(vectors, queries, k, m, dim, False)
    if found is None:
        return _empty(vectors)
    return top_k(found, k, m).select("query_id", "rank", "id", "score")


def _replicated(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric, dim: int) -> DataFrame:
    most = SENT_BYTES // (8 * dim)
    rows = vectors.select("id", "embedding").limit(most + 1).collect()
    if len(rows) > most:
        raise InvalidArgument(f"more than {most} vectors can't be replicated; use the sharded strategy")
    sent = vectors.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), np.array([r["embedding"] for r in rows], np.float64)))

    def run(batches):
        ids, x = sent.value
        for b in batches:
            q, own = matrix(b["embedding"], dim), b["query_id"].to_numpy(zero_copy_only=False)
            for lo in range(0, len(q), 1024):
                met = _Meeting((own[lo : lo + 1024], q[lo : lo + 1024], None), k, metric)
                met.add(x, ids, None)
                yield from met.candidates()

    return top_k(queries.select("query_id", "embedding").mapInArrow(run, RESULT), k, metric).select("query_id", "rank", "id", "score")


def local_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2") -> DataFrame:
    """(query_id, shard_id, rank, id, score): the k best rows inside each shard of ``vectors`` (shard_id, id, embedding)."""
    m, dim = parse(metric), dimension(vectors)
    check_dimension(dim, queries)
    share_path(vectors.sparkSession)
    found = _local(vectors, queries, k, m, dim, True) if k else None
    if found is None:
        return _empty(vectors, ", shard_id int").select("query_id", "shard_id", "rank", "id", "score")
    return top_k(found, k, m, by=("query_id", "shard_id")).select("query_id", "shard_id", "rank", "id", "score")


def within(vectors: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2") -> DataFrame:
    """(query_id, rank, id, score): the k best rows whose shard_id is the query's own; other rows are not scored. Null shards match nothing."""
    m, dim = parse(metric), dimension(vectors)
    check_dimension(dim, queries)
    share_path(vectors.sparkSession)
    found = _local(vectors.where("shard_id IS NOT NULL"), queries.where("shard_id IS NOT NULL"), k, m, dim, True, True) if k else None
    if found is None:
        return _empty(vectors)
    return top_k(found, k, m).select("query_id", "rank", "id", "score")


def search(vectors: DataFrame, query: list[float], k: int, metric: str | Metric = "l2") -> DataFrame:
    """(rank, id, score) of one query, by expressions and a take-ordered plan alone."""
    m, dim = parse(metric), dimension(vectors)
    if len(query) != dim:
        raise DimensionMismatch(dim, len(query))
    scored = vectors.select("id", score_expr(m, F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])).alias("score"), F.lit(0).cast("long").alias("query_id"))
    return top_k(scored, k, m).select("rank", "id", "score")


def pair_scores(pairs: DataFrame, metric: str | Metric, left: str = "left", right: str = "right") -> DataFrame:
    """``pairs`` with the ``score`` of its two vector columns, by expressions alone."""
    return pairs.withColumn("score", score_expr(metric, F.col(left), F.col(right)))


