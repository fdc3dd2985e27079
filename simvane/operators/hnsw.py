"""Navigable small-world graphs, one for each shard of a vector table.

A graph is built and searched by one task, since every insertion depends on those before it; shards are
the unit of parallel work and of memory. ``shard`` deals a table into as many shards as keep each below
a row limit. Graphs are tables: edges (shard_id, layer, src, neighbors) and meta, a row a shard.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simvane.config import HnswConfig
from simvane.errors import InvalidArgument, VectorIndexError
from simvane.functions.metrics import Metric, parse, score_matrix
from simvane.operators.knn import query_blocks
from simvane.operators.topk import top_k
from simvane.operators.vectors import check_dimension, dimension
from simvane.session import cut, share_path

#: Rows that one shard may hold; a larger one fails rather than exhaust a task.
MOST_ROWS = 200_000
#: Up to this many rows a node's distances to the whole shard are computed at once and kept: fewer, larger steps
#: cost less there. Beyond it a build computes the distances that it asks for alone.
WHOLE_ROWS = 4096

EDGES = "shard_id int, layer int, src long, neighbors array<long>"
META = "shard_id int, m int, m0 int, ef_construction int, ef_search int, use_heuristic boolean, max_level int, entry_point long, num_nodes long"


@dataclass
class Graph:
    """Nodes are row numbers of the shard; ``links[layer][node]`` lists a node's neighbours."""

    config: HnswConfig
    vectors: np.ndarray
    metric: Metric
    levels: list[int] = field(default_factory=list)
    links: list[dict[int, list[int]]] = field(default_factory=list)
    entry: int | None = None
    rows: dict[int, np.ndarray] = field(default_factory=dict)
    evaluated: int = 0  # distances computed so far

    def apart(self, x: np.ndarray | int, nodes: list[int] | np.ndarray) -> np.ndarray:
        """How far nodes lie from a vector, or from a node: lower is nearer, whichever way the metric points."""
        if isinstance(x, int):
            if len(self.vectors) > WHOLE_ROWS:
                return self._far(self.vectors[x], self.vectors[nodes])
            if x not in self.rows:
                self.rows[x] = self._far(self.vectors[x], self.vectors)
            return self.rows[x][nodes]
        return self._far(x, self.vectors[nodes])

    def _far(self, x: np.ndarray, others: np.ndarray) -> np.ndarray:
        self.evaluated += len(others)
        if self.metric is Metric.L2:
            d = others - x
            return np.einsum("ij,ij->i", d, d)
        if self.metric is Metric.DOT:
            return -(others @ x)
        scores = score_matrix(self.metric, x[None], others)[0]
        return 1 - scores if self.metric is Metric.COSINE else scores

    def neighbours(self, node: int, layer: int) -> list[int]:
        return self.links[layer].get(node, []) if layer < len(self.links) else []

    def beam(self, x: np.ndarray | int, starts: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes met, nearest first: expand the nearest open node until it's beyond the worst kept."""
        seen = set(starts)
        first = list(zip(self.apart(x, starts).tolist(), starts, strict=True))
        ahead = list(first)
        heapq.heapify(ahead)
        kept = [(-d, n) for d, n in first]
        heapq.heapify(kept)
        while len(kept) > width:
            heapq.heappop(kept)
        while ahead:
            d, node = heapq.heappop(ahead)
            if len(kept) >= width and d > -kept[0][0]:
                break
            fresh = [n for n in self.neighbours(node, layer) if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for e, n in zip(self.apart(x, fresh).tolist(), fresh, strict=True):
                if len(kept) < width or e < -kept[0][0]:
                    heapq.heappush(ahead, (e, n))
                    heapq.heappush(kept, (-e, n))
                    if len(kept) > width:
                        heapq.heappop(kept)
        return sorted((-d, n) for d, n in kept)

    def choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """The nearest nodes; with the heuristic, nodes nearer to the base than to any chosen one come first."""
        found = sorted(found)
        if not self.config.heuristic or len(found) <= 1:
            return [n for _, n in found[:most]]
        nodes = np.array([n for _, n in found])
        to_chosen = np.full(len(nodes), np.inf)  # each node's distance to the nearest chosen one
        chosen, passed = [], []
        for i, (d, n) in enumerate(found):
            if len(chosen) == most:
                break
            if to_chosen[i] <= d:
                passed.append(n)
            else:
                chosen.append(n)
                to_chosen = np.minimum(to_chosen, self.apart(n, nodes))
        return (chosen + passed)[:most]

    def connect(self, a: int, b: int, layer: int) -> None:
        """Adds b to a's list; an overfull list is chosen anew, which drops edges in this direction alone."""
        own = self.links[layer].setdefault(a, [])
        if a == b or b in own:
            return
        own.append(b)
        most = self.config.max_edges(layer)
        if len(own) > most:
            self.links[layer][a] = self.choose(list(zip(self.apart(a, own).tolist(), own, strict=True)), most)

    def insert(self, node: int, level: int) -> None:
        self.levels.append(level)
        while len(self.links) <= level:
            self.links.append({})
        for layer in range(level + 1):
            self.links[layer].setdefault(node, [])
        if self.entry is None:
            self.entry = node
            return
        x, top = node, self.levels[self.entry]
        starts = [self.entry]
        for layer in range(top, level, -1):
            starts = [self.beam(x, starts, 1, layer)[0][1]]
        for layer in range(min(level, top), -1, -1):
            found = self.beam(x, starts, self.config.ef_construction, layer)
            for other in self.choose(found, self.config.max_edges(layer)):
                self.connect(node, other, layer)
                self.connect(other, node, layer)
            starts = [n for _, n in found]
        if level > top:
            self.entry = node

    def search(self, x: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry is None:
            return []
        starts = [self.entry]
        for layer in range(self.levels[self.entry], 0, -1):
            starts = [self.beam(x, starts, 1, layer)[0][1]]
        return self.beam(x, starts, max(ef, k), 0)[:k]


def draw_levels(n: int, config: HnswConfig, shard: int) -> list[int]:
    """Geometric levels from a generator seeded for the shard."""
    u = np.random.default_rng([config.seed, shard]).random(n)
    return np.floor(-np.log(np.maximum(u, 1e-10)) * config.ml).astype(int).tolist()


def build_graph(vectors: np.ndarray, metric: str | Metric, config: HnswConfig, shard: int = 0) -> Graph:
    graph = Graph(config, np.asarray(vectors, np.float64), parse(metric))
    for node, level in enumerate(draw_levels(len(vectors), config, shard)):
        graph.insert(node, level)
    return graph


def shard(vectors: DataFrame, shards: int | None = None, most_rows: int = 5_000) -> DataFrame:
    """``vectors`` with a shard_id by the id's hash; without ``shards`` as many as bring them near ``most_rows`` each."""
    count = shards or max(1, -(-vectors.count() // most_rows))
    return vectors.withColumn("shard_id", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))


@dataclass(frozen=True)
class HnswIndex:
    config: HnswConfig
    metric: Metric
    vectors: DataFrame  # shard_id, id, embedding
    edges: DataFrame
    meta: DataFrame

    def search(self, queries: DataFrame, k: int, ef: int | None = None, by_shard: bool = False) -> DataFrame:
        """(query_id, rank, id, score), with ``by_shard`` also shard_id and ranks inside the shards; ties by id.

        Every shard answers every query from its own graph; ef below k counts as k.
        """
        if k < 0:
            raise InvalidArgument("k must not be negative")
        spark = self.vectors.sparkSession
        share_path(spark)
        dim = dimension(self.vectors)
        check_dimension(dim, queries)
        parts = [self._scan(ids, block, k, ef or self.config.ef_search) for ids, block in query_blocks(queries, dim)]
        found = parts[0] if parts else spark.createDataFrame([], "query_id long, shard_id int, id long, score double")
        for p in parts[1:]:
            found = found.unionByName(p)
        if by_shard:
            return top_k(found, k, self.metric, by=("query_id", "shard_id")).select("query_id", "shard_id", "rank", "id", "score")
        return top_k(found, k, self.metric, ties=("id", "shard_id")).select("query_id", "rank", "id", "score")

    def _scan(self, queries: np.ndarray, block: np.ndarray, k: int, width: int) -> DataFrame:
        """Each shard's k best for every query of a block."""
        config, metric = self.config, self.metric
        sent = self.vectors.sparkSession.sparkContext.broadcast((queries, block))

        def run(key, nodes, edges):
            graph, ids = restored(nodes, edges, metric, config)
            rows = []
            for query, x in zip(sent.value[0].tolist(), sent.value[1], strict=True) if k else ():
                for d, n in graph.search(x, k, width):
                    score = -d if metric is Metric.DOT else 1 - d if metric is Metric.COSINE else d
                    rows.append((query, int(key[0]), int(ids[n]), float(score)))
            return pd.DataFrame(rows, columns=["query_id", "shard_id", "id", "score"])

        nodes = self.vectors.select("shard_id", "id", "embedding")
        links = self.edges.join(self.meta.select("shard_id", "entry_point"), "shard_id")
        return nodes.groupBy("shard_id").cogroup(links.groupBy("shard_id")).applyInPandas(run, "query_id long, shard_id int, id long, score double")

    def save(self, path: str) -> None:
        for name, df in (("vectors", self.vectors), ("edges", self.edges), ("meta", self.meta)):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        self.vectors.sparkSession.createDataFrame([(self.metric.label, float(self.config.ml), self.config.seed)], "metric string, ml double, seed long").write.mode("overwrite").parquet(f"{path}/index")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HnswIndex:
        vectors, edges, meta = (spark.read.parquet(f"{path}/{name}") for name in ("vectors", "edges", "meta"))
        head, one = spark.read.parquet(f"{path}/index").first(), meta.first()
        config = HnswConfig(one["m"], one["m0"], one["ef_construction"], one["ef_search"], head["ml"], one["use_heuristic"], head["seed"])
        return cls(config, parse(head["metric"]), vectors, edges, meta)


def restored(nodes: pd.DataFrame, edges: pd.DataFrame, metric: Metric, config: HnswConfig) -> tuple[Graph, np.ndarray]:
    """A shard's graph from its tables, and the ids of the graph's row numbers."""
    nodes = nodes.sort_values("id", kind="stable")
    ids = nodes["id"].to_numpy()
    place = {int(i): n for n, i in enumerate(ids)}
    graph = Graph(config, np.array(nodes["embedding"].tolist(), np.float64), metric, [0] * len(ids))
    for layer, src, neighbours in zip(edges["layer"], edges["src"], edges["neighbors"], strict=True):
        while len(graph.links) <= layer:
            graph.links.append({})
        node = place[int(src)]
        graph.links[layer][node] = [place[int(n)] for n in neighbours]
        graph.levels[node] = max(graph.levels[node], int(layer))
    if len(edges):
        graph.entry = place[int(edges["entry_point"].iloc[0])]
    return graph, ids


def build(vectors: DataFrame, metric: str | Metric = "l2", config: HnswConfig = HnswConfig()) -> HnswIndex:
    """One graph for each shard_id of ``vectors`` (shard_id, id, embedding), ids distinct within a shard.

    EmptyIndex without rows; a shard of more than MOST_ROWS rows raises. Nodes enter in the order of ids.
    """
    m = parse(metric)
    dimension(vectors)
    share_path(vectors.sparkSession)
    largest = vectors.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")).agg(F.max("n").alias("n"), F.max(F.col("n") - F.col("ids")).alias("twice")).first()
    if largest["n"] > MOST_ROWS:
        raise VectorIndexError(f"a shard holds {largest['n']} rows; deal the table into shards of {MOST_ROWS} at most")
    if largest["twice"]:
        raise VectorIndexError("ids repeat within a shard")

    def run(key, nodes):
        nodes = nodes.sort_values("id", kind="stable")
        ids = nodes["id"].to_numpy()
        graph = build_graph(np.array(nodes["embedding"].tolist()), m, config, int(key[0]))
        rows = [(int(key[0]), layer, int(ids[src]), [int(ids[n]) for n in near], max(graph.levels), int(ids[graph.entry]), len(ids)) for layer, links in enumerate(graph.links) for src, near in links.items()]
        return pd.DataFrame(rows, columns=["shard_id", "layer", "src", "neighbors", "max_level", "entry_point", "num_nodes"])

    built = cut(vectors.select("shard_id", "id", "embedding").groupBy("shard_id").applyInPandas(run, EDGES + ", max_level int, entry_point long, num_nodes long"))
    heads = built.groupBy("shard_id").agg(F.max("max_level").alias("max_level"), F.max("entry_point").alias("entry_point"), F.max("num_nodes").alias("num_nodes"))
    fixed = [F.lit(x).cast(t).alias(n) for n, x, t in (("m", config.m, "int"), ("m0", config.m0, "int"), ("ef_construction", config.ef_construction, "int"), ("ef_search", config.ef_search, "int"), ("use_heuristic", config.heuristic, "boolean"))]
    meta = heads.select("shard_id", *fixed, "max_level", "entry_point", "num_nodes")
    return HnswIndex(config, m, vectors.select("shard_id", "id", "embedding"), built.select("shard_id", "layer", "src", "neighbors"), meta)
