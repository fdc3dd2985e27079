"""Registered queries of the vector engine over whole tables, with the SQL that states their results.

Searches take as queries the rows whose id is divisible by 100, against all rows. To tell metrics apart
on vectors of length 1, row i is scaled by 1 + i mod 3. Fixed centroids are the labels' mean vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simvane.config import HnswConfig, IvfPqConfig
from simvane.errors import VectorIndexError
from simvane.functions import metrics
from simvane.functions.metrics import Metric
from simvane.operators import cluster, hnsw, ivf, kmeans, knn, pq, recall, topk
from simvane.sources import datagen, index_files, vector_file
from simvane.session import checkpoint_dir, table

K, SHARDS, DIM, M = 10, 4, 64, 8
_Query = Callable[[SparkSession, str], DataFrame]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumn("embedding", F.transform(metrics.doubles(F.col("embedding")), lambda x: x * (1 + F.col("id") % 3)))


def asked(df: DataFrame) -> DataFrame:
    """The query set of a vector table."""
    return df.where(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id")


def sharded(df: DataFrame) -> DataFrame:
    return df.withColumn("shard_id", (F.col("id") % SHARDS).cast("int"))


def label_means(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """Mean vectors in the order of labels, of which there are few."""
    means = vectors(spark, sf_dir).groupBy("label").agg(*[F.avg(F.col("embedding")[i].cast("double")).alias(f"c{i}") for i in range(DIM)])
    return np.array([list(r)[1:] for r in means.orderBy("label").collect()])


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names or ("score",)})


def _neighbours(df: DataFrame) -> DataFrame:
    """Each row beside the row of the next id."""
    right = df.select((F.col("id") - 1).alias("id"), F.col("id").alias("other_id"), F.col("embedding").alias("right"))
    return df.select("id", F.col("embedding").alias("left")).join(right, "id")


def _scored(expression: Callable) -> _Query:
    def query(spark, sf_dir):
        pairs = _neighbours(scaled(spark, sf_dir))
        return rounded(pairs.select("id", "other_id", expression(F.col("left"), F.col("right")).alias("score")))

    return query


def _knn(metric: Metric, strategy: str = "sharded") -> _Query:
    def query(spark, sf_dir):
        v = scaled(spark, sf_dir)
        return rounded(knn.knn(v, asked(v), K, metric, strategy))

    return query


def knn_single(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(knn.search(v, label_means(spark, sf_dir).mean(0).tolist(), K, "l2"))


def knn_local_topk(spark, sf_dir):
    v = scaled(spark, sf_dir)
    return rounded(knn.local_top_k(sharded(v), asked(v), K, "l2"))


def knn_merge(spark, sf_dir):
    v = scaled(spark, sf_dir)
    lists = [knn.knn(sharded(v).where(F.col("shard_id") == s), asked(v), K, "l2") for s in range(SHARDS)]
    return rounded(topk.merge_local_results(lists, K, "l2").select("query_id", "rank", "id", "score"))


def knn_filtered(spark, sf_dir):
    """Neighbours of the query's own label."""
    v = scaled(spark, sf_dir)
    own = v.withColumn("shard_id", F.col("label").cast("int"))
    return rounded(knn.within(own, asked(own), K, "l2"))


def norms(spark, sf_dir):
    return rounded(scaled(spark, sf_dir).select("id", metrics.squared_norm(F.col("embedding")).alias("norm2")), "norm2")


def kmeans_assign(spark, sf_dir):
    return rounded(kmeans.assign(vectors(spark, sf_dir), label_means(spark, sf_dir), "l2"))


def _exploded(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    rows = [(c, i, float(x)) for c, row in enumerate(centroids) for i, x in enumerate(row)]
    return rounded(spark.createDataFrame(rows, "cluster_id int, pos int, value double"), "value")


def kmeans_step(spark, sf_dir):
    c = label_means(spark, sf_dir)
    return _exploded(spark, kmeans.step(vectors(spark, sf_dir), c[None], "l2").moved(c[None])[0])


def kmeans_sizes(spark, sf_dir):
    c = label_means(spark, sf_dir)
    s = kmeans.step(vectors(spark, sf_dir), c[None], "l2")
    return rounded(spark.createDataFrame([(int(s.counts.sum()), float(s.inertia[0]), s.shift(c[None]))], "n long, inertia double, shift double"), "inertia", "shift")


def kmeans_fit(spark, sf_dir):
    return _exploded(spark, kmeans.fit(vectors(spark, sf_dir), 10, 3, 0.0, "l2", label_means(spark, sf_dir)).centroids)


def kmeans_plus_plus(spark, sf_dir):
    return _exploded(spark, kmeans.plus_plus_rows(vectors(spark, sf_dir), 5, 42))


def kmeans_random_rows(spark, sf_dir):
    return _exploded(spark, kmeans.random_rows(vectors(spark, sf_dir), 5, 42))


def residual(spark, sf_dir):
    own = ivf.residuals(vectors(spark, sf_dir), label_means(spark, sf_dir))
    return rounded(own.select("id", "cluster_id", F.posexplode("embedding").alias("pos", "value")), "value")


def ivf_probe(spark, sf_dir):
    return rounded(kmeans.top_centroids(asked(vectors(spark, sf_dir)), label_means(spark, sf_dir), 3, "l2"))


def _slices(c: np.ndarray) -> pq.ProductQuantizer:
    return pq.ProductQuantizer(c.reshape(len(c), M, -1).transpose(1, 0, 2))


def _half_steps(c: np.ndarray) -> np.ndarray:
    """Half the way from each label's mean to the next one's: entries for residuals."""
    return (np.roll(c, -1, 0) - c) / 2


def ivf_postings(spark, sf_dir):
    c = label_means(spark, sf_dir)
    own = ivf.postings(vectors(spark, sf_dir), c, _slices(_half_steps(c)))
    return own.select("cluster_id", "id", F.posexplode("code").alias("m", "code")).withColumn("code", F.col("code").cast("int"))


def pq_encode(spark, sf_dir):
    codes = pq.encode(vectors(spark, sf_dir), _slices(label_means(spark, sf_dir)))
    return codes.select("id", F.posexplode("code").alias("m", "code")).withColumn("code", F.col("code").cast("int"))


def pq_decode(spark, sf_dir):
    q = _slices(label_means(spark, sf_dir))
    return rounded(pq.decode(pq.encode(vectors(spark, sf_dir), q), q).select("id", F.posexplode("embedding").alias("pos", "value")), "value")


def pq_lut(spark, sf_dir):
    return rounded(pq.lookup_tables(asked(vectors(spark, sf_dir)), _slices(label_means(spark, sf_dir)), "l2"))


def _index(spark, sf_dir, centroids: np.ndarray, quantizer: pq.ProductQuantizer, metric: Metric = Metric.L2) -> ivf.IvfPqIndex:
    config = IvfPqConfig(len(centroids), min(3, len(centroids)), M, quantizer.ksub)
    return ivf.IvfPqIndex(config, metric, centroids, quantizer, ivf.postings(vectors(spark, sf_dir), centroids, quantizer, metric))


def pq_adc_search(spark, sf_dir):
    """One list around the origin: table lookups alone."""
    index = _index(spark, sf_dir, np.zeros((1, DIM)), _slices(label_means(spark, sf_dir)))
    return rounded(index.search(asked(vectors(spark, sf_dir)), K))


def ivfpq_search(spark, sf_dir):
    c = label_means(spark, sf_dir)
    return rounded(_index(spark, sf_dir, c, _slices(_half_steps(c))).search(asked(vectors(spark, sf_dir)), K))


def ivfpq_build_search(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(ivf.build(v, IvfPqConfig(16, 4, M, 32, 5)).search(asked(v), K, rerank=v, least_recall=0.9))


def _reached(found: DataFrame, truth: DataFrame, queries: DataFrame, least: float, rule: Callable) -> DataFrame:
    """One row: how many queries there are, how many neighbours they have, and whether their mean recall reaches ``least``."""
    shares = rule(found, truth, queries).agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("mean"))
    return shares.crossJoin(truth.agg(F.count(F.lit(1)).alias("neighbours"))).select("queries", "neighbours", (F.col("mean") >= least).alias("reached"))


def ivfpq_recall(spark, sf_dir):
    """Over the searches of ``ivfpq_build_search``."""
    v = vectors(spark, sf_dir)
    return _reached(ivfpq_build_search(spark, sf_dir), knn.knn(v, asked(v), K), asked(v), 0.9, recall.prefix_recall)


def _searched(metric: Metric) -> _Query:
    def query(spark, sf_dir):
        c = label_means(spark, sf_dir)
        return rounded(_index(spark, sf_dir, c, _slices(_half_steps(c)), metric).search(asked(vectors(spark, sf_dir)), K))

    return query


def ivfpq_saved_search(spark, sf_dir):
    """As ``ivfpq_search``, by an index saved and loaded."""
    c, path = label_means(spark, sf_dir), f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    _index(spark, sf_dir, c, _slices(_half_steps(c))).save(path)
    return rounded(ivf.IvfPqIndex.load(spark, path, DIM).search(asked(vectors(spark, sf_dir)), K))


def ivf_file_roundtrip(spark, sf_dir):
    """The postings of ``ivf_postings`` through the exchange file."""
    c = label_means(spark, sf_dir)
    f = index_files.decode_ivf(index_files.encode_ivf(index_files.ivf_file(_index(spark, sf_dir, c, _slices(_half_steps(c))))))
    rows = [(cluster, int(i), m, int(x)) for cluster, (ids, codes) in enumerate(f.lists) for i, code in zip(ids, codes, strict=True) for m, x in enumerate(code)]
    return spark.createDataFrame(rows, "cluster_id int, id long, m int, code int")


def centroid_file_roundtrip(spark, sf_dir):
    c = label_means(spark, sf_dir)
    return _exploded(spark, index_files.decode_centroids(index_files.encode_centroids(index_files.CentroidFile(Metric.L2, c, 0, 0.0))).centroids.astype(float))


def _graphs(spark, sf_dir) -> tuple[hnsw.HnswIndex, DataFrame, int]:
    v = vectors(spark, sf_dir)
    return hnsw.build(hnsw.shard(v), "l2", HnswConfig(8, ef_construction=60)), asked(v), v.count()


def hnsw_search(spark, sf_dir):
    """With a beam as wide as the table, a connected graph's search is exact."""
    index, queries, n = _graphs(spark, sf_dir)
    return rounded(index.search(queries, K, n))


def hnsw_recall(spark, sf_dir):
    """With a beam of 60."""
    index, queries, _ = _graphs(spark, sf_dir)
    return _reached(index.search(queries, K, 60), knn.knn(vectors(spark, sf_dir), queries, K), queries, 0.9, recall.recall)


def hnsw_saved_search(spark, sf_dir):
    """As ``hnsw_search``, by an index saved and loaded."""
    (index, queries, n), path = _graphs(spark, sf_dir), f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    index.save(path)
    return rounded(hnsw.HnswIndex.load(spark, path).search(queries, K, n))


def graph_rules(spark, sf_dir):
    """(shard_id, nodes, ...): what holds of each shard's graph, and whether its exchange file holds it too."""
    v = sharded(vectors(spark, sf_dir)).select("shard_id", "id", "embedding")
    config = HnswConfig(8, ef_construction=60)
    index = hnsw.build(v, "l2", config)
    links = index.edges.withColumn("most", F.when(F.col("layer") == 0, config.m0).otherwise(config.m))
    own = links.groupBy("shard_id").agg(
        F.sum((F.col("layer") == 0).cast("long")).alias("nodes"),
        F.min(F.size("neighbors") <= F.col("most")).alias("within_caps"),
        F.min(~F.array_contains("neighbors", F.col("src"))).alias("no_loops"),
        F.min(F.size(F.array_distinct("neighbors")) == F.size("neighbors")).alias("no_repeats"),
        F.max("layer").alias("top"),
    )
    own = own.join(index.meta, "shard_id").select("shard_id", "nodes", "within_caps", "no_loops", "no_repeats", (F.col("top") == F.col("max_level")).alias("entry_on_top"), (F.col("num_nodes") == F.col("nodes")).alias("counted"))
    same = []
    for shard in range(SHARDS):
        f, _ = index_files.graph_file(index, shard)
        again = index_files.decode_graph(index_files.encode_graph(f))
        same.append((shard, (again.layers, again.entry, again.max_level) == (f.layers, f.entry, f.max_level)))
    return own.join(spark.createDataFrame(same, "shard_id int, file_holds_it boolean"), "shard_id")


def _cluster(spark, sf_dir, kind: str, config=None, parameter: int = 0) -> DataFrame:
    v = vectors(spark, sf_dir)
    local = sharded(v).withColumn("id", F.floor(F.col("id") / SHARDS).cast("long"))
    return rounded(cluster.ShardedIndex.build(local, kind, "l2", config).search(asked(v), K, parameter).complete())


def cluster_search(spark, sf_dir):
    return _cluster(spark, sf_dir, "flat")


def cluster_search_hnsw(spark, sf_dir):
    return _cluster(spark, sf_dir, "hnsw", HnswConfig(8, ef_construction=60), 1 << 20)


def cluster_search_ivf_pq(spark, sf_dir):
    """How many rows each query gets from shards of inverted files, and how many shards answered."""
    v = vectors(spark, sf_dir)
    index = cluster.ShardedIndex.build(sharded(v), "ivf_pq", "l2", IvfPqConfig(4, 4, M, 16, 3))
    found = index.search(asked(v), K)
    return found.complete().groupBy("query_id").agg(F.count(F.lit(1)).alias("neighbours"), F.lit(found.successful_shards).alias("shards"))


def cluster_stats(spark, sf_dir):
    """What an index says of its shards, and whether they answer."""
    index = cluster.ShardedIndex.build(sharded(vectors(spark, sf_dir)), "flat")
    ready = index.ping()
    return spark.createDataFrame([(*row, ready[row[0]]) for row in index.stats()], "shard_id int, num_vectors long, dimension int, index_type string, ready boolean")


def shard_stats(spark, sf_dir):
    return cluster.shard_stats(sharded(vectors(spark, sf_dir)))


def vector_file_roundtrip(spark, sf_dir):
    """All vectors written as binary files into the shared folder and read again."""
    folder = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    v = vectors(spark, sf_dir)
    vector_file.write_vectors(v, folder)
    return rounded(vector_file.read_vectors(spark, folder).select("id", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.col("value").cast("double")), "value")


def ground_truth_json(spark, sf_dir):
    """Exact neighbours written as JSON and read again."""
    v, path = vectors(spark, sf_dir), f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    datagen.ground_truth(v, asked(v), K).write.json(path)
    rows = spark.read.schema("query_id long, top_k array<struct<id: long, distance: double>>").json(path)
    flat = rows.select("query_id", F.posexplode("top_k").alias("place", "n"))
    return rounded(flat.select("query_id", (F.col("place") + 1).alias("rank"), F.col("n.id").alias("id"), F.col("n.distance").alias("score")))


def generated_neighbours(spark, sf_dir):
    """Among generated vectors each one's own row is its nearest."""
    v = datagen.generate(spark, 2_000, 32)
    return rounded(knn.knn(v, asked(v), K).where("rank = 1"))


def generated_sets(spark, sf_dir):
    """(kind, rows, dimension, first_id, last_id, fits): what holds of each kind of generated set."""
    parts = []
    for kind in datagen.KINDS:
        v = datagen.generate(spark, 1_000, 16, kind, first=500)
        norm = metrics.squared_norm(F.col("embedding"))
        largest = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
        fits = {"sphere": F.abs(norm - 1) < 1e-5, "uniform": largest <= 1, "gaussian": largest < datagen.SPREAD + 8}[kind]
        parts.append(v.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"), F.max(F.size("embedding")).alias("dimension"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min(fits).alias("fits")))
    return reduce(DataFrame.unionByName, parts)


def knn_all_rows(spark, sf_dir):
    """k beyond the number of rows returns them all: nations by their keys."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array(F.col("n_nationkey").cast("float"), F.col("n_regionkey").cast("float")).alias("embedding"))
    return rounded(knn.knn(rows, rows.withColumnRenamed("id", "query_id"), 1_000))


def metric_names(spark, sf_dir):
    """(name, metric, file_code, wire_code, higher_is_better) of every accepted name, in capitals and with spaces; an unknown one means l2 if that is asked for."""
    names = [n for m, more in metrics.ALIASES.items() for n in (m.label, *more.split())]
    rows = [(n, metrics.parse(f" {n.upper()} ")) for n in names] + [("unknown", metrics.parse("unknown", strict=False))]
    coded = [(n, m.label, metrics.from_file_code(m.file_code).file_code, metrics.from_wire_code(m.wire_code).wire_code, m.higher_is_better) for n, m in rows]
    return spark.createDataFrame(coded, "name string, metric string, file_code int, wire_code int, higher_is_better boolean")


def guards(spark, sf_dir):
    """(case, raised): what wrong requests raise."""
    v = vectors(spark, sf_dir)
    none, short = v.where("false"), asked(v).withColumn("embedding", F.slice("embedding", 1, 3))
    flat = cluster.ShardedIndex.build(sharded(v), "flat", "cosine")
    cases = {
        "no vectors": lambda: knn.knn(none, asked(v), K),
        "other dimension": lambda: knn.knn(v, short, K),
        "negative k": lambda: knn.knn(v, asked(v), -1),
        "unknown metric": lambda: knn.knn(v, asked(v), K, "nearest"),
        "unknown strategy": lambda: knn.knn(v, asked(v), K, strategy="both"),
        "no slices": lambda: pq.train(v, 7),
        "lists": lambda: IvfPqConfig(0),
        "probes": lambda: IvfPqConfig(4, 5),
        "entries": lambda: IvfPqConfig(ksub=257),
        "edges": lambda: HnswConfig(1),
        "beam": lambda: HnswConfig(ef_search=0),
        "unknown kind": lambda: cluster.ShardedIndex.build(sharded(v), "tree"),
        "no query": lambda: flat.search(asked(none), K),
        "no neighbours": lambda: flat.search(asked(v), 0),
        "other metric": lambda: flat.search(asked(v), K, metric="l2"),
        "no vector file": lambda: vector_file.parse_header(b"\0" * 24, 24),
        "short vector file": lambda: vector_file.parse_header(vector_file.HEADER.pack(vector_file.MAGIC, 2, 2), 30),
        "no graph file": lambda: index_files.decode_graph(b"\0" * 64),
        "short centroid file": lambda: index_files.decode_centroids(index_files.encode_centroids(index_files.CentroidFile(Metric.L2, np.ones((2, 2)), 1, 0.0))[:-1]),
    }
    rows = []
    for case, run in cases.items():
        try:
            run()
            rows.append((case, "nothing"))
        except VectorIndexError as error:
            rows.append((case, type(error).__name__))
    return spark.createDataFrame(rows, "case string, raised string")


def latencies(spark, sf_dir):
    """Percentiles of the nations' keys, taken as seconds."""
    found = recall.latency_percentiles([float(r[0]) for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()])
    return spark.createDataFrame([tuple(found[x] for x in ("p50", "p90", "p95", "p99", "min", "max"))], "p50 double, p90 double, p95 double, p99 double, least double, most double")


def queries() -> dict[str, _Query]:
    found: dict[str, _Query] = {f"score_{m.label}": _scored(lambda a, b, m=m: metrics.score_expr(m, a, b)) for m in Metric}
    found |= {f"minkowski_p{p}": _scored(lambda a, b, p=p: metrics.minkowski_expr(a, b, p)) for p in (1, 2, 4)}
    found["mahalanobis_diag"] = _scored(lambda a, b: metrics.mahalanobis_expr(a, b, [1 / (1 + i) for i in range(DIM)]))
    found["mahalanobis_full"] = _scored(lambda a, b: metrics.mahalanobis_expr(F.slice(a, 1, 4), F.slice(b, 1, 4), [x for i in range(4) for x in [0.25] * i + [2.0] + [0.25] * (3 - i)]))
    whole = [x for i in range(DIM) for x in [0.25] * i + [2.0] + [0.25] * (DIM - 1 - i)]
    found["mahalanobis_whole"] = _scored(lambda a, b: metrics.mahalanobis_expr(a, b, whole))
    found |= {f"knn_{m.label}": _knn(m) for m in Metric}
    found["knn_replicated"] = _knn(Metric.L2, "replicated")
    found["knn_minkowski_p4"] = _knn(metrics.Order(4))
    found["knn_mahalanobis_whole"] = _knn(metrics.Precision(tuple(whole)))
    found |= {f"ivfpq_search_{m.label}": _searched(m) for m in (Metric.DOT, Metric.COSINE)}
    own = (
        knn_single, knn_local_topk, knn_merge, knn_filtered, norms, residual, kmeans_assign, kmeans_step, kmeans_sizes, kmeans_fit, kmeans_plus_plus, ivf_probe, ivf_postings,
        pq_encode, pq_decode, pq_lut, pq_adc_search, ivfpq_search, ivfpq_build_search, ivfpq_recall, hnsw_search, hnsw_recall, cluster_search, cluster_search_hnsw, shard_stats,
        vector_file_roundtrip, generated_neighbours, ivfpq_saved_search, ivf_file_roundtrip, centroid_file_roundtrip, hnsw_saved_search, graph_rules, cluster_search_ivf_pq, cluster_stats,
        ground_truth_json, generated_sets, knn_all_rows, metric_names, guards, latencies, kmeans_random_rows,
    )
    return found | {f.__name__: f for f in own}


# The oracles: plain formulas over lists of doubles.


def _fold(expression: str, a: str, b: str, how: str = "list_sum") -> str:
    body = expression.replace("X", f"{a}[i]").replace("Y", f"{b}[i]")
    return f"coalesce({how}(list_transform(range(1, len({a}) + 1), lambda i: {body})), 0.0)"


def _metric_sql(m: Metric | metrics.Order, a: str, b: str) -> str:
    if isinstance(m, metrics.Order):
        return f"pow({_fold(f'pow(abs(X - Y), {m.p})', a, b)}, 1.0 / {m.p})"
    square = _fold("(X - Y) * (X - Y)", a, b)
    larger = _fold("greatest(abs(X), abs(Y))", a, b)
    norms_ = f"(sqrt({_fold('X * X', a, b)}) * sqrt({_fold('Y * Y', a, b)}))"
    return {
        Metric.L2: square,
        Metric.DOT: _fold("X * Y", a, b),
        Metric.COSINE: f"CASE WHEN {norms_} <= 1e-9 THEN 0.0 ELSE {_fold('X * Y', a, b)} / {norms_} END",
        Metric.MANHATTAN: _fold("abs(X - Y)", a, b),
        Metric.MINKOWSKI: f"cbrt({_fold('abs(X - Y) * abs(X - Y) * abs(X - Y)', a, b)})",
        Metric.CHEBYSHEV: _fold("abs(X - Y)", a, b, "list_max"),
        Metric.HAMMING: _fold("CASE WHEN abs(X - Y) > 1e-6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", a, b),
        Metric.MAHALANOBIS: f"sqrt({square})",
        Metric.JACCARD: f"CASE WHEN {larger} <= 1e-9 THEN 0.0 ELSE 1 - {_fold('least(abs(X), abs(Y))', a, b)} / {larger} END",
        Metric.HELLINGER: f"sqrt(0.5 * {_fold('pow(sqrt(abs(X)) - sqrt(abs(Y)), 2)', a, b)})",
    }[m]


_V = "v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_S = f"{_V}, s AS (SELECT id, label, list_transform(e, lambda x: x * (1 + id % 3)) AS e FROM v)"
_C = f"""{_V}, c AS (SELECT (row_number() OVER (ORDER BY label) - 1)::INTEGER AS cluster_id, c FROM (
  SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(e[i]) AS m FROM v, range(1, {DIM} + 1) r(i) GROUP BY label, i) GROUP BY label))"""


def _pairs_sql(expression: str) -> str:
    return f"WITH {_S} SELECT a.id, b.id AS other_id, round({expression}, 6) AS score FROM s a JOIN s b ON b.id = a.id + 1"


def _ranked(source: str, expression: str, metric: Metric = Metric.L2, by: str = "query_id", ties: str = "id") -> str:
    """Ranks ``source`` (query_id, q, id, e, ...) by an expression."""
    way = "DESC" if metric.higher_is_better else "ASC"
    return f"SELECT *, (row_number() OVER (PARTITION BY {by} ORDER BY score {way}, {ties}))::INTEGER AS rank FROM (SELECT *, {expression} AS score FROM ({source}))"


def _knn_sql(m: Metric) -> str:
    source = "SELECT a.id AS query_id, a.e AS q, b.id, b.e FROM s a, s b WHERE a.id % 100 = 0"
    return f"WITH {_S} SELECT query_id, rank, id, round(score, 6) AS score FROM ({_ranked(source, _metric_sql(m, 'q', 'e'), m)}) WHERE rank <= {K}"


def _assigned(name: str, centroids: str, metric: Metric = Metric.L2) -> str:
    source = f"SELECT v.id AS query_id, v.e AS q, k.cluster_id AS id, k.c AS e FROM v, {centroids} k"
    return f"{name} AS (SELECT query_id AS id, q AS e, e AS c, id AS cluster_id, score FROM ({_ranked(source, _metric_sql(metric, 'q', 'e'), metric)}) WHERE rank = 1)"


def _moved(name: str, assigned: str, before: str) -> str:
    return f"""{name} AS (SELECT k.cluster_id, coalesce(n.c, k.c) AS c FROM {before} k LEFT JOIN (
  SELECT cluster_id, list(m ORDER BY i) AS c FROM (SELECT cluster_id, i, avg(e[i]) AS m FROM {assigned}, range(1, {DIM} + 1) r(i) GROUP BY cluster_id, i) GROUP BY cluster_id) n ON n.cluster_id = k.cluster_id)"""


_EXPLODED = "SELECT cluster_id, (i - 1)::INTEGER AS pos, round(c[i], 6) AS value FROM {}, range(1, 65) r(i)"
_SUB = DIM // M


def _part(m: Metric, a: str, b: str) -> str:
    """The metric between slice m of two lists; a similarity counts negative, so that the least is best."""
    cut = f"[m * {_SUB} + 1 : m * {_SUB} + {_SUB}]"
    return ("-" if m.higher_is_better else "") + f"({_metric_sql(m, f'({a}{cut})', f'({b}{cut})')})"


def _encoded(source: str, entries: str, metric: Metric = Metric.L2) -> str:
    """(id, m, code, cluster_id, entry) of a source (id, cluster_id, e) by entries (code, c)."""
    return f"""SELECT id, cluster_id, m, code, entry FROM (SELECT s.id, s.cluster_id, m, k.code, k.c AS entry, row_number() OVER (PARTITION BY s.id, m ORDER BY {_part(metric, 's.e', 'k.c')}, k.code) AS n
  FROM {source} s, {entries} k, range(0, {M}) r(m)) WHERE n = 1"""


_ENTRIES = "k AS (SELECT cluster_id AS code, c FROM c)"
_HALVES = f"k AS (SELECT a.cluster_id AS code, list_transform(range(1, {DIM} + 1), lambda i: (b.c[i] - a.c[i]) / 2) AS c FROM c a JOIN c b ON b.cluster_id = (a.cluster_id + 1) % (SELECT count(*) FROM c))"
_RESIDUALS = f"res AS (SELECT id, cluster_id, list_transform(range(1, {DIM} + 1), lambda i: e[i] - c[i]) AS e FROM a)"


def _adc(codes: str, probes: str, metric: Metric = Metric.L2) -> str:
    """Table lookups: probes (query_id, cluster_id, q) are the queries' residuals at their clusters."""
    scores = f"SELECT p.query_id, x.id, sum({_part(metric, 'p.q', 'x.entry')}) AS score FROM {probes} p JOIN {codes} x ON x.cluster_id = p.cluster_id GROUP BY p.query_id, x.id"
    sign = "-" if metric.higher_is_better else ""
    # sums are rounded before ranks, since equal codes must tie whatever the order of addition
    return f"SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12), id))::INTEGER AS rank, id, round({sign}score, 6) + 0.0 AS score FROM ({scores}) QUALIFY rank <= {K}"


def _names_sql() -> str:
    rows = [(n, m) for m, more in metrics.ALIASES.items() for n in (m.label, *more.split())] + [("unknown", Metric.L2)]
    higher = "metric IN ('dot', 'cosine')"
    # fixed values: codes count from 0 in files and from 1 on the wire, in the order of the metrics' definition
    order = "['" + "', '".join(m.label for m in Metric) + "']"
    values = ", ".join(f"('{n}', '{m.label}')" for n, m in rows)
    return f"SELECT name, metric, (list_position({order}, metric) - 1)::INTEGER AS file_code, list_position({order}, metric)::INTEGER AS wire_code, {higher} AS higher_is_better FROM (VALUES {values}) t(name, metric)"


#: What each case of ``guards`` raises.
_RAISED = {
    "EmptyIndex": ("no vectors",),
    "DimensionMismatch": ("other dimension",),
    "InvalidArgument": ("negative k", "unknown strategy", "unknown kind", "no query", "no neighbours"),
    "Unavailable": ("other metric",),
    "VectorIndexError": ("unknown metric",),
    "InvalidConfig": ("no slices", "lists", "probes", "entries", "edges", "beam"),
    "InvalidHeader": ("no vector file", "no graph file", "short centroid file"),
    "FileSizeMismatch": ("short vector file",),
}


def _draw_sql(*salt: object) -> str:
    return "md5(concat_ws(':', id" + "".join(f", '{x}'" for x in salt) + "))"


def _plus_plus_sql(k: int, seed: int) -> str:
    """Rows drawn one after another, each by exponential times whose rates are the squared distances to those before."""
    parts = [f"{_V}, d0 AS (SELECT 0 AS cluster_id, e AS c FROM v ORDER BY {_draw_sql(seed)}, id LIMIT 1)"]
    for j in range(1, k):
        before = " UNION ALL ".join(f"SELECT c FROM d{i}" for i in range(j))
        even = f"((('0x' || left({_draw_sql(seed, j)}, 13))::BIGINT + 1) / {float((1 << 52) + 1)!r})"
        weighed = f"SELECT id, e, (SELECT min({_metric_sql(Metric.L2, 'v.e', 'b.c')}) FROM ({before}) b) AS w FROM v"
        parts.append(f"d{j} AS MATERIALIZED (SELECT {j} AS cluster_id, e AS c FROM ({weighed}) WHERE w > 0 ORDER BY -ln({even}) / w, id LIMIT 1)")
    every = " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(k))
    return f"WITH {', '.join(parts)}, d AS ({every}) {_EXPLODED.format('d')}"


def _whole_sql(a: str, b: str) -> str:
    row = f"list_sum(list_transform(range(1, {DIM} + 1), lambda j: (CASE WHEN i = j THEN 2.0::DOUBLE ELSE 0.25::DOUBLE END) * ({a}[j] - {b}[j])))"
    return f"sqrt(greatest(list_sum(list_transform(range(1, {DIM} + 1), lambda i: ({a}[i] - {b}[i]) * {row})), 0))"


def oracle_sql() -> dict[str, str]:
    out = {f"score_{m.label}": _pairs_sql(_metric_sql(m, "a.e", "b.e")) for m in Metric}
    out |= {f"minkowski_p{p}": _pairs_sql(f"pow({_fold(f'pow(abs(X - Y), {p})', 'a.e', 'b.e')}, 1.0 / {p})") for p in (1, 2, 4)}
    out["mahalanobis_diag"] = _pairs_sql(f"sqrt({_fold('(X - Y) * (X - Y) / i', 'a.e', 'b.e')})")
    terms = " + ".join(f"{2.0 if i == j else 0.25} * (a.e[{i}] - b.e[{i}]) * (a.e[{j}] - b.e[{j}])" for i in range(1, 5) for j in range(1, 5))
    out["mahalanobis_full"] = _pairs_sql(f"sqrt(greatest({terms}, 0))")
    out["mahalanobis_whole"] = _pairs_sql(_whole_sql("a.e", "b.e"))
    out |= {f"knn_{m.label}": _knn_sql(m) for m in Metric}
    out["knn_replicated"] = out["knn_merge"] = out["knn_l2"]
    out["knn_single"] = f"""WITH {_C}, m AS (SELECT list(x ORDER BY i) AS q FROM (SELECT i, avg(c[i]) AS x FROM c, range(1, {DIM} + 1) r(i) GROUP BY i))
SELECT rank, id, round(score, 6) AS score FROM ({_ranked('SELECT 0 AS query_id, q, id, e FROM m, v', _metric_sql(Metric.L2, 'q', 'e'))}) WHERE rank <= {K}"""
    both = "SELECT a.id AS query_id, a.e AS q, a.label AS own, b.id, b.e, b.label, (b.id % 4)::INTEGER AS shard_id FROM {0} a, {0} b WHERE a.id % 100 = 0"
    out["knn_local_topk"] = f"WITH {_S} SELECT query_id, shard_id, rank, id, round(score, 6) AS score FROM ({_ranked(both.format('s'), _metric_sql(Metric.L2, 'q', 'e'), by='query_id, shard_id')}) WHERE rank <= {K}"
    out["knn_filtered"] = f"WITH {_S} SELECT query_id, rank, id, round(score, 6) AS score FROM ({_ranked(both.format('s') + ' AND a.label = b.label', _metric_sql(Metric.L2, 'q', 'e'))}) WHERE rank <= {K}"
    out["norms"] = f"WITH {_S} SELECT id, round({_fold('X * Y', 'e', 'e')}, 6) AS norm2 FROM s"
    first = f"{_C}, {_assigned('a', 'c')}"
    out["kmeans_assign"] = f"WITH {first} SELECT id, cluster_id, round(score, 6) AS score FROM a"
    out["kmeans_step"] = f"WITH {first}, {_moved('c1', 'a', 'c')} {_EXPLODED.format('c1')}"
    out["kmeans_sizes"] = f"""WITH {first}, {_moved('c1', 'a', 'c')} SELECT (SELECT count(*) FROM a) AS n, (SELECT round(sum(score), 6) FROM a) AS inertia,
  (SELECT round(max({_metric_sql(Metric.L2, 'c.c', 'c1.c')}), 6) FROM c JOIN c1 ON c.cluster_id = c1.cluster_id) AS shift"""
    out["kmeans_fit"] = f"WITH {first}, {_moved('c1', 'a', 'c')}, {_assigned('a1', 'c1')}, {_moved('c2', 'a1', 'c1')}, {_assigned('a2', 'c2')}, {_moved('c3', 'a2', 'c2')} {_EXPLODED.format('c3')}"
    out["residual"] = f"WITH {first} SELECT id, cluster_id, (i - 1)::INTEGER AS pos, round(e[i] - c[i], 6) AS value FROM a, range(1, {DIM} + 1) r(i)"
    probe = f"{_ranked('SELECT v.id AS query_id, v.e AS q, c.cluster_id AS id, c.c AS e FROM v, c WHERE v.id % 100 = 0', _metric_sql(Metric.L2, 'q', 'e'))}"
    out["ivf_probe"] = f"WITH {_C} SELECT query_id, rank, id AS cluster_id, round(score, 6) AS score FROM ({probe}) WHERE rank <= 3"
    coded = f"{first}, {_HALVES}, {_RESIDUALS}, x AS ({_encoded('res', 'k')})"
    out["ivf_postings"] = f"WITH {coded} SELECT cluster_id, id, m::INTEGER AS m, code FROM x"
    whole = f"{_C}, {_ENTRIES}, w AS (SELECT id, 0 AS cluster_id, e FROM v), x AS ({_encoded('w', 'k')})"
    out["pq_encode"] = f"WITH {whole} SELECT id, m::INTEGER AS m, code FROM x"
    out["pq_decode"] = f"WITH {whole} SELECT id, (m * {_SUB} + i - 1)::INTEGER AS pos, round(entry[m * {_SUB} + i], 6) AS value FROM x, range(1, {_SUB + 1}) r(i)"
    part = f"list_sum(list_transform(range(1, {_SUB + 1}), lambda i: pow(v.e[m * {_SUB} + i] - k.c[m * {_SUB} + i], 2)))"
    out["pq_lut"] = f"WITH {_C}, {_ENTRIES} SELECT v.id AS query_id, m::INTEGER AS m, k.code AS k, round({part}, 6) AS score FROM v, k, range(0, {M}) r(m) WHERE v.id % 100 = 0"
    out["pq_adc_search"] = f"WITH {whole}, p AS (SELECT id AS query_id, 0 AS cluster_id, e AS q FROM v WHERE id % 100 = 0) {_adc('x', 'p')}"
    out["ivfpq_search"] = f"""WITH {coded}, p AS (SELECT query_id, id AS cluster_id, list_transform(range(1, {DIM} + 1), lambda i: q[i] - e[i]) AS q FROM ({probe}) WHERE rank <= 3) {_adc('x', 'p')}"""
    for m in (Metric.DOT, Metric.COSINE):
        own = f"{_C}, {_assigned('a', 'c', m)}, {_HALVES}, {_RESIDUALS}, x AS ({_encoded('res', 'k', m)})"
        near = f"{_ranked('SELECT v.id AS query_id, v.e AS q, c.cluster_id AS id, c.c AS e FROM v, c WHERE v.id % 100 = 0', _metric_sql(m, 'q', 'e'), m)}"
        out[f"ivfpq_search_{m.label}"] = f"""WITH {own}, p AS (SELECT query_id, id AS cluster_id, list_transform(range(1, {DIM} + 1), lambda i: q[i] - e[i]) AS q FROM ({near}) WHERE rank <= 3) {_adc('x', 'p', m)}"""
    out["ivfpq_saved_search"], out["ivf_file_roundtrip"] = out["ivfpq_search"], out["ivf_postings"]
    out["centroid_file_roundtrip"] = f"WITH {_C} SELECT cluster_id, (i - 1)::INTEGER AS pos, round(c[i]::FLOAT::DOUBLE, 6) AS value FROM c, range(1, {DIM + 1}) r(i)"
    out["kmeans_random_rows"] = f"WITH {_V}, d AS (SELECT (row_number() OVER (ORDER BY {_draw_sql(42)}, id) - 1)::INTEGER AS cluster_id, e AS c FROM v QUALIFY cluster_id < 5) {_EXPLODED.format('d')}"
    out["kmeans_plus_plus"] = _plus_plus_sql(5, 42)
    out["knn_minkowski_p4"] = _knn_sql(metrics.Order(4))
    out["knn_mahalanobis_whole"] = f"WITH {_S} SELECT query_id, rank, id, round(score, 6) AS score FROM ({_ranked('SELECT a.id AS query_id, a.e AS q, b.id, b.e FROM s a, s b WHERE a.id % 100 = 0', _whole_sql('q', 'e'))}) WHERE rank <= {K}"
    asked_ = "(SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0)"
    out["hnsw_recall"] = out["ivfpq_recall"] = f"SELECT {asked_} AS queries, {asked_} * least({K}, (SELECT count(*) FROM embeddings)) AS neighbours, true AS reached"
    out["cluster_search_ivf_pq"] = f"SELECT vec_id AS query_id, {K}::BIGINT AS neighbours, {SHARDS}::INTEGER AS shards FROM embeddings WHERE vec_id % 100 = 0"
    own = f"SELECT (vec_id % {SHARDS})::INTEGER AS shard_id, count(*) AS n FROM embeddings GROUP BY 1"
    out["cluster_stats"] = f"SELECT shard_id, n AS num_vectors, {DIM}::INTEGER AS dimension, 'Flat' AS index_type, true AS ready FROM ({own})"
    out["graph_rules"] = f"SELECT shard_id, n AS nodes, true AS within_caps, true AS no_loops, true AS no_repeats, true AS entry_on_top, true AS counted, true AS file_holds_it FROM ({own})"
    out["generated_neighbours"] = "SELECT i AS query_id, 1::INTEGER AS rank, i AS id, 0.0::DOUBLE AS score FROM range(0, 2000, 100) r(i)"
    out["generated_sets"] = "SELECT kind, 1000::BIGINT AS rows, 16::INTEGER AS dimension, 500::BIGINT AS first_id, 1499::BIGINT AS last_id, true AS fits FROM (VALUES ('gaussian'), ('sphere'), ('uniform')) t(kind)"
    keys = "[n_nationkey::DOUBLE, n_regionkey::DOUBLE]"
    out["knn_all_rows"] = f"SELECT query_id, rank, id, round(score, 6) AS score FROM ({_ranked(f'SELECT a.n_nationkey::BIGINT AS query_id, b.n_nationkey::BIGINT AS id, a.q, b.q AS e FROM (SELECT *, {keys} AS q FROM nation) a, (SELECT *, {keys} AS q FROM nation) b', _metric_sql(Metric.L2, 'q', 'e'))})"
    out["metric_names"] = _names_sql()
    out["guards"] = "SELECT * FROM (VALUES " + ", ".join(f"('{case}', '{raised}')" for raised, cases in _RAISED.items() for case in cases) + ') t("case", raised)'
    at = lambda p: f"s[1 + least(len(s) - 1, len(s) * {p} // 100)]"
    out["latencies"] = f"SELECT {', '.join(f'{at(p)} AS p{p}' for p in (50, 90, 95, 99))}, s[1] AS least, s[-1] AS most FROM (SELECT list(n_nationkey::DOUBLE ORDER BY n_nationkey) AS s FROM nation)"
    out["hnsw_search"] = f"WITH {_V} SELECT query_id, rank, id, round(score, 6) AS score FROM ({_ranked(both.format('v'), _metric_sql(Metric.L2, 'q', 'e'))}) WHERE rank <= {K}"
    local = "SELECT a.id AS query_id, a.e AS q, b.id // 4 AS id, b.e, (b.id % 4)::INTEGER AS shard_id FROM v a, v b WHERE a.id % 100 = 0"
    out["cluster_search"] = f"WITH {_V} SELECT query_id, rank, shard_id, id, round(score, 6) AS score FROM ({_ranked(local, _metric_sql(Metric.L2, 'q', 'e'), ties='shard_id, id')}) WHERE rank <= {K}"
    out["cluster_search_hnsw"] = out["cluster_search"]
    out["hnsw_saved_search"] = out["ground_truth_json"] = out["hnsw_search"]
    out["shard_stats"] = "SELECT (vec_id % 4)::INTEGER AS shard_id, count(*) AS num_vectors, max(len(embedding))::INTEGER AS dimension, 'HNSW' AS index_type FROM embeddings GROUP BY 1"
    out["vector_file_roundtrip"] = f"WITH {_V} SELECT id, (i - 1)::INTEGER AS pos, round(e[i], 6) AS value FROM v, range(1, {DIM} + 1) r(i)"
    return out
