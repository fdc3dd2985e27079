"""IVF-PQ: coarse clusters, product-quantized residuals in posting lists, and search of a few lists.

The postings are a table (cluster_id, id, code); saved, it is partitioned by cluster_id, so that a
search reads the probed clusters' files alone. A score is the sum over slices of the metric between the
query's residual and the code's entry: for L2 and Manhattan the metric up to quantization, for others a
value of that table's own. ``rerank`` scores the best candidates anew by the true metric.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simvane.config import IvfPqConfig
from simvane.errors import DimensionMismatch, InvalidArgument
from simvane.functions.metrics import Metric, parse, score_expr
from simvane.operators import kmeans, pq, recall
from simvane.operators.knn import RESULT, knn, query_blocks
from simvane.operators.topk import RunningTopK, top_k
from simvane.operators.vectors import check_dimension, dimension, listed, matrix
from simvane.session import cut, share_path


@dataclass(frozen=True)
class IvfPqIndex:
    config: IvfPqConfig
    metric: Metric
    centroids: np.ndarray
    quantizer: pq.ProductQuantizer
    postings: DataFrame

    @property
    def dimension(self) -> int:
        return self.centroids.shape[1]

    @property
    def nlist(self) -> int:
        return len(self.centroids)

    def total_vectors(self) -> int:
        return self.postings.count()

    def posting_list(self, cluster: int) -> DataFrame:
        return self.postings.where(F.col("cluster_id") == cluster).select("id", "code")

    def list_sizes(self) -> DataFrame:
        return self.postings.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, rerank: DataFrame | None = None, candidates: int | None = None, least_recall: float | None = None) -> DataFrame:
        """(query_id, rank, id, score): the k best postings of each query's nprobe nearest lists, ties by id.

        nprobe None or 0 means the configuration's; more than nlist means all. With ``rerank`` (id,
        embedding) the ``candidates`` best (10 k by default) are scored by the true metric instead. With
        ``least_recall`` both are only where ``reaching`` starts from.
        """
        if k < 0:
            raise InvalidArgument("k must not be negative")
        check_dimension(self.dimension, queries)
        spark = queries.sparkSession
        share_path(spark)
        empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
        if k == 0:
            return empty
        if least_recall is not None:
            if rerank is None:
                raise InvalidArgument("recall is measured against rerank's vectors")
            nprobe, candidates = self.reaching(least_recall, queries, k, rerank, nprobe, candidates)
        probes = min(max(1, nprobe or self.config.nprobe), self.nlist)
        wide = max(k, candidates or 10 * k) if rerank is not None else k
        parts = [self._scan(ids, block, probes, wide) for ids, block in query_blocks(queries, self.dimension)]
        if not parts:
            return empty
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        if rerank is None:
            return top_k(found, k, self.metric).select("query_id", "rank", "id", "score")
        kept = top_k(found, wide, self.metric).select("query_id", "id")
        exact = kept.join(rerank.select("id", "embedding"), "id").join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
        return top_k(exact.withColumn("score", score_expr(self.metric, F.col("_q"), F.col("embedding"))), k, self.metric).select("query_id", "rank", "id", "score")

    def reaching(self, least_recall: float, queries: DataFrame, k: int, rerank: DataFrame, nprobe: int | None = None, candidates: int | None = None, sample: int = 200) -> tuple[int, int]:
        """(nprobe, candidates), doubled until a sample of the queries has the recall against exact search.

        A sample's mean must lie a standard error above it, unless the sample is all queries. All lists
        with all rows as candidates are exact search, so the doubling ends.
        """
        some = cut(queries.select("query_id", "embedding").orderBy(F.xxhash64("query_id"), "query_id").limit(sample))
        whole, total = queries.count() <= sample, rerank.count()
        truth = cut(knn(rerank, some, k, self.metric))
        probes, wide = min(max(1, nprobe or self.config.nprobe), self.nlist), max(k, candidates or 10 * k)
        while probes < self.nlist or wide < total:
            row = recall.recall(self.search(some, k, probes, rerank, wide), truth, some).agg(F.avg("recall").alias("r"), F.stddev_pop("recall").alias("d"), F.count(F.lit(1)).alias("n")).first()
            if not row["n"] or row["r"] - (0 if whole else row["d"] / row["n"] ** 0.5) >= least_recall:
                break
            probes, wide = min(2 * probes, self.nlist), min(2 * wide, max(k, total))
        return probes, wide

    def _scan(self, ids: np.ndarray, block: np.ndarray, probes: int, k: int) -> DataFrame:
        lists = kmeans.probe_lists(block, self.centroids, probes, self.metric)
        asking: dict[int, list[int]] = {}
        for i, clusters in enumerate(lists):
            for c in clusters:
                asking.setdefault(int(c), []).append(i)
        sent = self.postings.sparkSession.sparkContext.broadcast((ids, block, asking, self.centroids, self.quantizer))
        metric = self.metric

        def run(batches):
            own_ids, q, by_cluster, centroids, quantizer = sent.value
            held = RunningTopK(len(q), k, metric)
            tables: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                clusters, n, codes = b["cluster_id"].to_numpy(zero_copy_only=False), b["id"].to_numpy(zero_copy_only=False), pq.code_matrix(b["code"], quantizer.m)
                for c in np.unique(clusters):
                    mine = clusters == c
                    for i in by_cluster.get(int(c), ()):
                        if (i, c) not in tables:
                            if len(tables) > 2000:
                                tables.clear()
                            tables[i, c] = quantizer.lookup_table(q[i] - centroids[c], metric)
                        held.add(i, quantizer.table_scores(tables[i, c], codes[mine]), n[mine])
            i, found, score = held.columns()
            yield pa.RecordBatch.from_arrays([pa.array(own_ids[i]), pa.array(found), pa.array(score)], ["query_id", "id", "score"])

        return self.postings.where(F.col("cluster_id").isin(sorted(asking))).select("cluster_id", "id", "code").mapInArrow(run, RESULT)

    def save(self, path: str) -> None:
        """Tables centroids, codebook, postings (by cluster) and meta under a folder."""
        spark = self.postings.sparkSession
        c = self.config
        kmeans.KMeansResult(self.centroids, 0, 0.0, self.metric).frame(spark).write.mode("overwrite").parquet(f"{path}/centroids")
        self.quantizer.frame(spark).write.mode("overwrite").parquet(f"{path}/codebook")
        self.postings.repartition("cluster_id").write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/postings")
        meta = [(self.metric.label, self.dimension, c.nlist, c.nprobe, c.m, c.ksub, c.max_iters, c.tolerance)]
        spark.createDataFrame(meta, "metric string, dimension int, nlist int, nprobe int, m int, ksub int, max_iters int, tolerance double").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, expected_dimension: int | None = None) -> IvfPqIndex:
        """A saved index; the training sample's limit isn't saved and loads as None."""
        meta = spark.read.parquet(f"{path}/meta").first()
        if expected_dimension not in (None, meta["dimension"]):
            raise DimensionMismatch(expected_dimension, meta["dimension"])
        centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cluster_id").collect()])
        rows = spark.read.parquet(f"{path}/codebook").orderBy("m", "k").collect()
        codebook = np.array([r["centroid"] for r in rows]).reshape(meta["m"], meta["ksub"], -1)
        config = IvfPqConfig(meta["nlist"], meta["nprobe"], meta["m"], meta["ksub"], meta["max_iters"], meta["tolerance"])
        return cls(config, parse(meta["metric"]), centroids, pq.ProductQuantizer(codebook), spark.read.parquet(f"{path}/postings").select("cluster_id", "id", "code"))


def postings(vectors: DataFrame, centroids: np.ndarray, quantizer: pq.ProductQuantizer, metric: str | Metric = "l2") -> DataFrame:
    """(cluster_id, id, code): each row's nearest cluster and the code of its residual, without a shuffle."""
    m, dim = parse(metric), centroids.shape[1]
    check_dimension(dim, vectors)
    share_path(vectors.sparkSession)
    sent = vectors.sparkSession.sparkContext.broadcast((centroids, quantizer))

    def run(batches):
        for b in batches:
            c, q = sent.value
            x = matrix(b["embedding"], dim)
            at, _ = kmeans.nearest(x, c, m)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b["id"], pq.code_list(q.encode(x - c[at], m))], ["cluster_id", "id", "code"])

    return vectors.select("id", "embedding").mapInArrow(run, "cluster_id int, id long, code array<smallint>")


def residuals(vectors: DataFrame, centroids: np.ndarray, metric: str | Metric = "l2") -> DataFrame:
    """(id, cluster_id, embedding): each row less its nearest centroid."""
    m, dim = parse(metric), centroids.shape[1]
    share_path(vectors.sparkSession)
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for b in batches:
            x = matrix(b["embedding"], dim)
            at, _ = kmeans.nearest(x, sent.value, m)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(at.astype(np.int32)), listed(x - sent.value[at])], ["id", "cluster_id", "embedding"])

    return vectors.select("id", "embedding").mapInArrow(run, "id long, cluster_id int, embedding array<double>")


def build(vectors: DataFrame, config: IvfPqConfig = IvfPqConfig(), metric: str | Metric = "l2") -> IvfPqIndex:
    """Trains coarse clusters on the vectors and the codebook on residuals, then encodes every row.

    EmptyIndex without rows, InvalidConfig if the dimension is no multiple of m.
    """
    m = parse(metric)
    config.check_dimension(dimension(vectors))
    sample = vectors.select("id", "embedding")
    if config.max_train_points is not None:
        sample = cut(sample.orderBy(F.xxhash64("id", F.lit(config.seed)), "id").limit(config.max_train_points))
    coarse = kmeans.fit(sample, config.nlist, config.max_iters, config.tolerance, m, seed=config.seed).centroids
    # read once a step; the residuals are computed once
    quantizer = pq.train(cut(residuals(sample, coarse, m)), config.m, config.ksub, config.max_iters, config.tolerance, m, config.seed)
    return IvfPqIndex(config, m, coarse, quantizer, postings(vectors, coarse, quantizer, m))
