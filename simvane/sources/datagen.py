"""Synthetic vector sets: Gaussian clusters, the unit sphere, and the cube; and their exact neighbours as JSON."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simvane.errors import InvalidArgument
from simvane.functions.metrics import Metric
from simvane.operators.knn import knn
from simvane.session import share_path

CENTERS = 8
SPREAD = 10.0
KINDS = ("gaussian", "sphere", "uniform")


def generate(spark: SparkSession, n: int, dim: int = 128, kind: str = "gaussian", seed: int = 42, first: int = 0) -> DataFrame:
    """(id, embedding): ids from ``first`` on. A row depends on seed and id alone, however the table is cut."""
    if kind not in KINDS:
        raise InvalidArgument(f"unknown distribution {kind!r}")
    share_path(spark)

    def run(batches):
        centers = np.random.default_rng(seed).uniform(-SPREAD, SPREAD, (CENTERS, dim))
        for b in batches:
            ids = b["id"].to_numpy()
            x = np.empty((len(ids), dim))
            for row, i in enumerate(ids.tolist()):
                g = np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, 0, i]))
                x[row] = g.uniform(-1, 1, dim) if kind == "uniform" else g.normal(size=dim)
                if kind == "gaussian":
                    x[row] += centers[g.integers(CENTERS)]
            if kind == "sphere":
                x /= np.linalg.norm(x, axis=1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim), pa.int32()), pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([b["id"], lists], ["id", "embedding"])

    return spark.range(first, first + n).mapInArrow(run, "id long, embedding array<float>")


def sharded(vectors: DataFrame, shards: int, n: int) -> DataFrame:
    """(shard_id, id, embedding): ids dense from 0 cut into runs of ceil(n / shards)."""
    size = -(-n // shards)
    return vectors.select(F.floor(F.col("id") / size).cast("int").alias("shard_id"), "id", "embedding")


def ground_truth(vectors: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2") -> DataFrame:
    """(query_id, top_k array<struct<id, distance>>) in the order of ranks; ``write.json`` makes the file."""
    found = knn(vectors, queries, k, metric)
    ranked = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.col("score").alias("distance")))).alias("r"))
    return ranked.select("query_id", F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["distance"].alias("distance"))).alias("top_k"))
