"""Command line: generate vector sets, train centroids, and search, over files that Spark reads.

    python -m simvane.cli generate --rows 10000 --dimension 128 --kind gaussian --shards 3 --out DIR
    python -m simvane.cli train-centroids --data DIR --k 64 --out FILE
    python -m simvane.cli search --data DIR --queries DIR --k 10 --metric cosine --out DIR
    python -m simvane.cli build-index --data DIR --kind hnsw --metric l2 --out INDEX
    python -m simvane.cli search-index --index INDEX --kind hnsw --queries DIR --k 10 --parameter 60 --out DIR
    python -m simvane.cli bench --data DIR --queries DIR --kind flat --k 10 --repeat 20 --out FILE
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simvane.functions.metrics import parse
from simvane.operators import cluster, hnsw, ivf, kmeans, knn, recall
from simvane.sources import datagen, index_files, vector_file


def generate(spark: SparkSession, rows: int, dimension: int, kind: str, shards: int, seed: int, out: str) -> None:
    """Writes vector files shard_0.bin and so on."""
    vector_file.write_vectors(datagen.generate(spark, rows, dimension, kind, seed), out, shards)


def train_centroids(spark: SparkSession, data: str, k: int, iters: int, tolerance: float, metric: str, seed: int, out: str) -> kmeans.KMeansResult:
    """k-means over all vector files of a folder; writes a centroid file."""
    vectors = vector_file.read_vectors(spark, data)
    found = kmeans.fit(vectors, k, iters, tolerance, metric, seed=seed)
    index_files.save(out, index_files.encode_centroids(index_files.CentroidFile(found.metric, found.centroids, found.iterations, found.inertia)))
    return found


def search(spark: SparkSession, data: str, queries: str, k: int, metric: str, out: str) -> None:
    """Exact neighbours of the query files' vectors, as JSON (query_id, top_k)."""
    asked = vector_file.read_vectors(spark, queries).withColumnRenamed("id", "query_id")
    datagen.ground_truth(vector_file.read_vectors(spark, data), asked, k, parse(metric)).write.mode("overwrite").json(out)


def _named(vectors: DataFrame) -> DataFrame:
    """Ids that no two shards share: the shard's number above the row's."""
    return vectors.withColumn("id", F.shiftleft(F.col("shard_id").cast("long"), 40) + F.col("id"))


def build_index(spark: SparkSession, data: str, kind: str, metric: str, out: str) -> None:
    """Graphs of all vector files, or one inverted file over them, saved under a folder."""
    vectors = _named(vector_file.read_vectors(spark, data))
    index = hnsw.build(hnsw.shard(vectors), metric) if kind == "hnsw" else ivf.build(vectors, metric=metric)
    index.save(out)


def search_index(spark: SparkSession, index: str, kind: str, queries: str, k: int, parameter: int, out: str) -> None:
    """A saved index's neighbours of the query files' vectors, as JSON (query_id, rank, id, score)."""
    loaded = (hnsw.HnswIndex if kind == "hnsw" else ivf.IvfPqIndex).load(spark, index)
    asked = vector_file.read_vectors(spark, queries).withColumnRenamed("id", "query_id")
    loaded.search(asked, k, parameter or None).write.mode("overwrite").json(out)


def bench(spark: SparkSession, data: str, queries: str, kind: str, metric: str, k: int, parameter: int, repeat: int, out: str) -> dict:
    """Checks every shard's health, then searches again and again; writes latencies, shard counts and queries a second as JSON."""
    index = cluster.ShardedIndex.build(vector_file.read_vectors(spark, data), kind, metric)
    asked = vector_file.read_vectors(spark, queries).withColumnRenamed("id", "query_id").select("query_id", "embedding")
    runs = [index.search(asked, k, parameter) for _ in range(repeat)]
    found = {
        "ready": sum(index.ping().values()), "shards": len(index), "answered": min((r.successful_shards for r in runs), default=0), "queries": asked.count(),
        "seconds": recall.latency_percentiles([r.latency_ms / 1000 for r in runs]),
    }
    index_files.save(out, json.dumps(found).encode())
    return found


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    g = commands.add_parser("generate")
    g.add_argument("--rows", type=int, default=10_000)
    g.add_argument("--dimension", type=int, default=128)
    g.add_argument("--kind", choices=datagen.KINDS, default="gaussian")
    g.add_argument("--shards", type=int, default=1)
    t = commands.add_parser("train-centroids")
    t.add_argument("--data", required=True)
    t.add_argument("--k", type=int, default=64)
    t.add_argument("--iters", type=int, default=30)
    t.add_argument("--tolerance", type=float, default=1e-4)
    t.add_argument("--metric", default="l2")
    s = commands.add_parser("search")
    s.add_argument("--data", required=True)
    s.add_argument("--queries", required=True)
    s.add_argument("--k", type=int, default=10)
    s.add_argument("--metric", default="l2")
    b = commands.add_parser("build-index")
    i = commands.add_parser("search-index")
    n = commands.add_parser("bench")
    i.add_argument("--index", required=True)
    n.add_argument("--repeat", type=int, default=20)
    for p in (b, n):
        p.add_argument("--data", required=True)
        p.add_argument("--metric", default="l2")
    for p in (i, n):
        p.add_argument("--queries", required=True)
        p.add_argument("--k", type=int, default=10)
        p.add_argument("--parameter", type=int, default=0)
    for p, kinds in ((b, ("hnsw", "ivf_pq")), (i, ("hnsw", "ivf_pq")), (n, tuple(cluster.KINDS))):
        p.add_argument("--kind", choices=kinds, default=kinds[0])
    for p in (g, t, s, b, i, n):
        p.add_argument("--out", required=True)
    for p in (g, t):
        p.add_argument("--seed", type=int, default=42)
    given = vars(parser.parse_args(args))
    run = {"generate": generate, "train-centroids": train_centroids, "search": search, "build-index": build_index, "search-index": search_index, "bench": bench}[given.pop("command")]
    run(SparkSession.builder.appName("simvane").getOrCreate(), **given)


if __name__ == "__main__":
    main()
