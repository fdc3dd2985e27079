"""k-means over DataFrames: assignment, one step, the whole fit, and its initial centroids.

A step sends the centroids to all tasks; each task sums its rows by cluster, and one shuffle of these
partial sums, a row for each task and cluster, adds them up. Only centroids reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simvane.errors import InvalidArgument
from simvane.functions.metrics import Metric, badness, parse, score_matrix
from simvane.operators.topk import RunningTopK
from simvane.operators.vectors import check_dimension, dimension, listed, matrix
from simvane.session import share_path


@dataclass(frozen=True)
class KMeansResult:
    """Centroids by cluster number, how many steps were made, and the last step's inertia.

    Inertia sums the best scores at the centroids before that step's update; without a step it is infinite.
    """

    centroids: np.ndarray
    iterations: int
    inertia: float
    metric: Metric

    @property
    def k(self) -> int:
        return len(self.centroids)

    @property
    def dimension(self) -> int:
        return self.centroids.shape[1] if self.centroids.ndim == 2 else 0

    def frame(self, spark: SparkSession) -> DataFrame:
        """(cluster_id, centroid)."""
        return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "cluster_id int, centroid array<double>")

    def meta(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.dimension, self.k, self.metric.label, self.iterations, float(self.inertia))], "dimension int, k int, metric string, iterations int, inertia double")


@dataclass(frozen=True)
class Step:
    """Sums of one assignment by group and cluster, and the sum of the best scores."""

    counts: np.ndarray  # (groups, k)
    sums: np.ndarray  # (groups, k, d)
    inertia: np.ndarray  # (groups,)

    def moved(self, centroids: np.ndarray) -> np.ndarray:
        """Means of the clusters that have rows; others stay where they are."""
        some = self.counts > 0
        return np.where(some[..., None], self.sums / np.maximum(self.counts, 1)[..., None], centroids)

    def shift(self, centroids: np.ndarray) -> float:
        """The largest squared movement among clusters that have rows."""
        moved = ((self.moved(centroids) - centroids) ** 2).sum(-1)
        return float(np.where(self.counts > 0, moved, 0.0).max(initial=0.0))


def nearest(x: np.ndarray, centroids: np.ndarray, metric: str | Metric) -> tuple[np.ndarray, np.ndarray]:
    """The best cluster of each row and its score; of equal ones the first. All-NaN rows go to cluster 0."""
    scores = score_matrix(metric, x, centroids)
    at = badness(metric, scores).argmin(1)
    return at, scores[np.arange(len(x)), at]


def assign(vectors: DataFrame, centroids: np.ndarray, metric: str | Metric = "l2") -> DataFrame:
    """(id, cluster_id, score) of each row of ``vectors`` (id, embedding), without a shuffle."""
    m, dim = parse(metric), centroids.shape[1]
    check_dimension(dim, vectors)
    share_path(vectors.sparkSession)
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for b in batches:
            at, score = nearest(matrix(b["embedding"], dim), sent.value, m)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(at.astype(np.int32)), pa.array(score)], ["id", "cluster_id", "score"])

    return vectors.select("id", "embedding").mapInArrow(run, "id long, cluster_id int, score double")


def top_centroids(queries: DataFrame, centroids: np.ndarray, nprobe: int, metric: str | Metric = "l2") -> DataFrame:
    """(query_id, rank, cluster_id, score): the nprobe best centroids of each query, ties by cluster; 0 gives none."""
    m, dim = parse(metric), centroids.shape[1]
    check_dimension(dim, queries)
    share_path(queries.sparkSession)
    sent = queries.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for b in batches:
            scores = score_matrix(m, matrix(b["embedding"], dim), sent.value)
            order = np.argsort(badness(m, scores), axis=1, kind="stable")[:, :nprobe]
            n, width = order.shape
            ids = np.repeat(b["query_id"].to_numpy(zero_copy_only=False), width)
            ranks = np.tile(np.arange(1, width + 1, dtype=np.int32), n)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ranks), pa.array(order.ravel().astype(np.int32)), pa.array(np.take_along_axis(scores, order, 1).ravel())], ["query_id", "rank", "cluster_id", "score"])

    return queries.select("query_id", "embedding").mapInArrow(run, "query_id long, rank int, cluster_id int, score double")


def step(vectors: DataFrame, centroids: np.ndarray, metric: str | Metric) -> Step:
    """Assigns and sums: centroids are (groups, k, d), each group for its own d components of the vectors."""
    m = parse(metric)
    groups, k, d = centroids.shape
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def partial(batches):
        counts, sums, inertia = np.zeros((groups, k)), np.zeros((groups, k, d)), np.zeros(groups)
        for b in batches:
            x = matrix(b["embedding"], groups * d)
            for g in range(groups):
                own = x[:, g * d : (g + 1) * d]
                at, score = nearest(own, sent.value[g], m)
                counts[g] += np.bincount(at, minlength=k)
                np.add.at(sums[g], at, own)
                inertia[g] += np.nansum(score)
        yield from _rows(counts, sums, inertia)

    def _rows(counts, sums, inertia):
        g, c = np.nonzero(counts)
        if len(g):
            first = np.zeros(len(g))  # a group's inertia goes with its first cluster
            first[np.unique(g, return_index=True)[1]] = inertia[np.unique(g)]
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(counts[g, c]), listed(sums[g, c]), pa.array(first)], ["g", "c", "n", "s", "inertia"])

    def merged(batches):
        counts, sums, inertia = {}, {}, {}
        for b in batches:
            for g, c, n, s, i in zip(b["g"].to_pylist(), b["c"].to_pylist(), b["n"].to_pylist(), matrix(b["s"], d), b["inertia"].to_pylist(), strict=True):
                counts[g, c] = counts.get((g, c), 0.0) + n
                sums[g, c] = sums[g, c] + s if (g, c) in sums else s.copy()
                inertia[g, c] = inertia.get((g, c), 0.0) + i
        if counts:
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in keys], pa.int32()), pa.array([c for _, c in keys], pa.int32()), pa.array([counts[x] for x in keys]), listed(np.array([sums[x] for x in keys])), pa.array([inertia[x] for x in keys])], ["g", "c", "n", "s", "inertia"])

    schema = "g int, c int, n double, s array<double>, inertia double"
    rows = vectors.select("embedding").mapInArrow(partial, schema).repartition("g", "c").mapInArrow(merged, schema).collect()
    counts, sums, inertia = np.zeros((groups, k)), np.zeros((groups, k, d)), np.zeros(groups)
    for r in rows:
        counts[r["g"], r["c"]], sums[r["g"], r["c"]] = r["n"], r["s"]
        inertia[r["g"]] += r["inertia"]
    return Step(counts, sums, inertia)


def draw(*salt: int) -> Column:
    """An id's place in a random order that any run and any engine repeats: the MD5 of id and salt, joined by colons."""
    return F.md5(F.concat_ws(":", F.col("id").cast("string"), *[F.lit(str(s)) for s in salt]))


def even(*salt: int) -> Column:
    """An id's number in (0, 1) from the first 52 bits of its draw."""
    return (F.conv(F.substring(draw(*salt), 1, 13), 16, 10).cast("double") + 1) / F.lit(float((1 << 52) + 1))


def random_rows(vectors: DataFrame, k: int, *salt: int) -> np.ndarray:
    """k rows by the order of their draws: a sample without replacement."""
    rows = vectors.select("id", "embedding").orderBy(draw(*salt), "id").limit(k).collect()
    return np.array([r["embedding"] for r in rows], np.float64)


def first_rows(vectors: DataFrame, salts: list[tuple[int, ...]]) -> np.ndarray:
    """For each salt the row of the least draw, all by one pass over the table."""
    found = vectors.agg(*[F.min_by("embedding", F.struct(draw(*salt), F.col("id"))).alias(f"r{i}") for i, salt in enumerate(salts)]).first()
    return np.array(list(found), np.float64)


def plus_plus_rows(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """k-means++: each next row is drawn with a chance that follows its squared distance to the rows drawn before.

    Every row draws an exponential time with that rate; the earliest one is taken. If all rows lie on
    drawn ones the choice is even.
    """
    chosen = random_rows(vectors, 1, seed)
    dim = chosen.shape[1]
    share_path(vectors.sparkSession)
    while len(chosen) < k:
        sent = vectors.sparkSession.sparkContext.broadcast(chosen)

        def distances(batches, sent=sent):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b["id"], b["embedding"], b["even"], pa.array(score_matrix("l2", matrix(b["embedding"], dim), sent.value).min(1))], ["id", "embedding", "even", "w"])

        kind = dict(vectors.dtypes)["embedding"]
        weighed = vectors.select("id", "embedding", even(seed, len(chosen)).alias("even")).mapInArrow(distances, f"id long, embedding {kind}, even double, w double")
        time = F.when(F.col("w") > 0, F.struct((-F.log("even") / F.col("w")).alias("t"), F.col("id")))
        row = weighed.agg(F.sum("w").alias("total"), F.min_by("embedding", time).alias("drawn"), F.min_by("embedding", F.struct("even", "id")).alias("any")).first()
        sent.destroy()
        chosen = np.vstack([chosen, row["drawn"] if (row["total"] or 0) > 1e-6 else row["any"]])
    return chosen


def fit(vectors: DataFrame, k: int, max_iters: int = 30, tolerance: float = 1e-4, metric: str | Metric = "l2", init: str | np.ndarray = "random", seed: int = 42) -> KMeansResult:
    """Lloyd's steps until no cluster's centroid moves by more than ``tolerance``, squared, or ``max_iters`` are done.

    ``init`` is "random", "k-means++" or a matrix of centroids. k beyond the number of rows counts as that
    number; no rows or k = 0 give an empty result. A cluster without rows takes the row whose draw, salted
    with step and cluster, is least, and doesn't count for the movement.
    """
    m = parse(metric)
    if isinstance(init, str) and init not in ("random", "k-means++"):
        raise InvalidArgument(f"unknown init {init!r}")
    dim = dimension(vectors, empty="allow")
    if dim == 0 or k == 0:
        return KMeansResult(np.zeros((0, dim)), 0, 0.0, m)
    share_path(vectors.sparkSession)
    if isinstance(init, str):
        k = min(k, vectors.count())
        start = random_rows(vectors, k, seed) if init == "random" else plus_plus_rows(vectors, k, seed)
    else:
        start = np.asarray(init, np.float64)
    centroids, iterations, inertia = lloyd(vectors, start[None], max_iters, tolerance, m, seed)
    return KMeansResult(centroids[0], int(iterations[0]), float(inertia[0]), m)


def lloyd(vectors: DataFrame, start: np.ndarray, max_iters: int, tolerance: float, metric: Metric, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroids, steps, inertia) of several groups of components at once, each stopping on its own."""
    centroids = start.copy()
    groups, k, d = centroids.shape
    steps, inertia, open_ = np.zeros(groups, int), np.full(groups, np.inf), np.ones(groups, bool)
    for i in range(max_iters):
        now = step(vectors, centroids, metric)
        moved = now.moved(centroids)
        shifts = np.where(now.counts > 0, ((moved - centroids) ** 2).sum(-1), 0.0).max(1)
        empty = list(zip(*(x.tolist() for x in np.nonzero((now.counts == 0) & open_[:, None])), strict=True))
        numbers = sorted({c for _, c in empty})
        rows = dict(zip(numbers, first_rows(vectors, [(seed, i, c) for c in numbers]), strict=True)) if numbers else {}
        for g, c in empty:
            moved[g, c] = rows[c][g * d : (g + 1) * d]
        centroids[open_], inertia[open_] = moved[open_], now.inertia[open_]
        steps[open_] += 1
        open_ &= shifts > tolerance
        if not open_.any():
            break
    return centroids, steps, inertia


def probe_lists(queries: np.ndarray, centroids: np.ndarray, nprobe: int, metric: str | Metric) -> list[np.ndarray]:
    """The clusters that each query of a block probes, on the driver."""
    held = RunningTopK(len(queries), min(nprobe, len(centroids)), metric)
    for i, row in enumerate(score_matrix(metric, queries, centroids)):
        held.add(i, row, np.arange(len(centroids)))
    return held.ids
