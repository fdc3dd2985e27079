import numpy as np
import pytest
from helpers import ids, queries, vectors, wave
from pyspark.sql import functions as F

from simvane.config import HnswConfig, IvfPqConfig
from simvane.errors import EmptyIndex, InvalidArgument, InvalidConfig, Unavailable, VectorIndexError
from simvane.operators import cluster, hnsw, ivf, knn, recall


@pytest.mark.parametrize(("metric", "n", "dim", "args", "ef", "least"), [("l2", 200, 128, (7, 13, 3, 10007, 0.001), 60, 0.9), ("cosine", 100, 96, (11, 19, 7, 101, 0.01), 80, 0.8), ("dot", 150, 64, (17, 5, 3, 10007, 0.001), 60, 0.9)])
def test_recall(metric, n, dim, args, ef, least):
    x = wave(n, dim, *args)
    q = wave(1, dim, 1, 17, 5, 10007, 0.001)[0]
    graph = hnsw.build_graph(x, metric, HnswConfig(16, ef_construction=100))
    true = np.argsort(graph._far(q, x), kind="stable")[:10]
    assert len({i for _, i in graph.search(q, 10, ef)} & set(true.tolist())) / 10 >= least


def test_graph_rules():
    c = HnswConfig(4, ef_construction=20)
    graph = hnsw.build_graph(wave(120, 4, 7, 13, 3, 97, 0.01), "l2", c)
    for layer, links in enumerate(graph.links):
        for node, near in links.items():
            assert node not in near and len(near) == len(set(near)) <= c.max_edges(layer)
    levels = hnsw.draw_levels(10_000, HnswConfig(), 0)
    assert sum(v == 0 for v in levels) > 8000 and hnsw.draw_levels(50, c, 1) == hnsw.draw_levels(50, c, 1)
    assert hnsw.build_graph(np.zeros((0, 3)), "l2", c).search(np.zeros(3), 2, 5) == []
    for bad in ({"m": 1}, {"m0": 8}, {"ef_construction": 0}, {"ml": 0.0}):
        with pytest.raises(InvalidConfig):
            HnswConfig(**bad)


def test_insertions_ask_for_few_distances(monkeypatch):
    x = np.random.default_rng(1).normal(size=(1200, 8))
    monkeypatch.setattr(hnsw, "WHOLE_ROWS", 0)
    asked = {}
    for n in (300, 1200):
        graph = hnsw.build_graph(x[:n], "l2", HnswConfig(6, ef_construction=20))
        last, before = n - 100, graph.evaluated
        again = hnsw.build_graph(x[:last], "l2", HnswConfig(6, ef_construction=20))
        asked[n] = (before - again.evaluated) / 100
    assert asked[1200] < 1.5 * asked[300], "an insertion's distances don't grow with the shard"
    monkeypatch.setattr(hnsw, "WHOLE_ROWS", 4096)
    assert hnsw.build_graph(x[:300], "l2", HnswConfig(6, ef_construction=20)).links == hnsw_links(x[:300], monkeypatch)


def hnsw_links(x, monkeypatch):
    monkeypatch.setattr(hnsw, "WHOLE_ROWS", 0)
    return hnsw.build_graph(x, "l2", HnswConfig(6, ef_construction=20)).links


def test_sharded_table(spark, tmp_path):
    x = wave(90, 8, 7, 13, 3, 97, 0.01)
    v, q = vectors(spark, x, 3), queries(spark, x[::30])
    index = hnsw.build(hnsw.shard(v, 3), "l2", HnswConfig(8))
    exact = knn.knn(v, q, 5)
    assert recall.recall(index.search(q, 5, 90), exact, q).agg({"recall": "min"}).first()[0] == 1.0
    index.save(str(tmp_path / "g"))
    assert ids(hnsw.HnswIndex.load(spark, str(tmp_path / "g")).search(q, 5, 90)) == ids(exact)
    assert index.search(q, 2, by_shard=True).count() == 3 * 3 * 2
    with pytest.raises(EmptyIndex):
        hnsw.build(hnsw.shard(vectors(spark, []), 1))
    with pytest.raises(VectorIndexError):
        hnsw.build(vectors(spark, [(1, 1)]).unionByName(vectors(spark, [(2, 2)])).withColumn("shard_id", F.lit(0)))


def three_shards(spark):
    rows = [(s, i, list(map(float, e))) for s, i, e in ((0, 0, (1, 0, 0, 0)), (0, 1, (0, 1, 0, 0)), (1, 0, (0, 0, 1, 0)), (1, 1, (0, 0, 0, 1)), (2, 0, (1, 1, 0, 0)), (2, 1, (0, 0, 1, 1)))]
    return spark.createDataFrame(rows, "shard_id int, id long, embedding array<float>")


def test_a_shard_that_fails_while_it_runs(spark):
    index = cluster.ShardedIndex.build(three_shards(spark), "flat")
    own = index.shards[2].run

    def breaks(queries, k, parameter):
        return own(queries, k, parameter).withColumn("score", F.raise_error(F.lit("lost executor")).cast("double"))

    index.shards[2].run, index.shards[1].ready = breaks, lambda: 1 / 0
    found = index.search(queries(spark, [(1, 0.1, 0, 0)]), 6)
    assert (found.total_shards, found.successful_shards) == (3, 2) and "lost executor" in found.status[2][2]
    assert found.rows.count() == 4 and found.latency_ms > 0 and index.ping() == {0: True, 1: False, 2: True}
    assert index.stats()[0] == (0, 2, 4, "Flat")
    with pytest.raises(Unavailable):
        found.complete()


def test_inverted_files_by_shard(spark):
    x = wave(120, 8, 7, 13, 3, 97, 0.01)
    v = vectors(spark, x).withColumn("shard_id", F.col("id").cast("int") % 3)
    index = cluster.ShardedIndex.build(v, "ivf_pq", config=IvfPqConfig(4, 4, 4, 16, 4))
    found = index.search(queries(spark, x[:2]), 5, 4).complete()
    assert found.count() == 10 and {r[3] for r in index.stats()} == {"IVF-PQ"}


def test_shards_of_indexes_that_exist(spark, tmp_path):
    x = wave(90, 8, 7, 13, 3, 97, 0.01)
    v, q = vectors(spark, x, 2), queries(spark, x[::45])
    graphs = hnsw.build(hnsw.shard(v, 3), "l2", HnswConfig(8))
    graphs.save(str(tmp_path / "g"))
    index = cluster.ShardedIndex.of_graphs(hnsw.HnswIndex.load(spark, str(tmp_path / "g")))
    assert len(index) == 3 and sum(s[1] for s in index.stats()) == 90 and all(index.ping().values())
    assert [r["id"] for r in index.search(q, 5, 90).complete().orderBy("query_id", "rank").collect()] == ids(knn.knn(v, q, 5))
    halves = {s: ivf.build(v.where(F.col("id") % 2 == s), IvfPqConfig(4, 4, 4, 16, 4)) for s in (1, 0)}
    index = cluster.ShardedIndex.of_inverted_files(halves)
    assert [s[0] for s in index.stats()] == [0, 1] and index.search(q, 5, 4).complete().count() == 10
    other = cluster.ShardedIndex.build(three_shards(spark), "flat", "cosine").get(2)
    with pytest.raises(InvalidArgument):
        index.add(other)
    index.remove(0)
    index.remove(1)
    assert index.is_empty() and index.get(1) is None
    index.add(other)
    assert len(index) == 1


@pytest.mark.parametrize("kind", ["flat", "hnsw"])
def test_scatter_and_gather(spark, kind):
    index = cluster.ShardedIndex.build(three_shards(spark), kind)
    found = index.search(queries(spark, [(1, 0.1, 0, 0)]), 3)
    rows = [(r["shard_id"], r["id"]) for r in found.rows.orderBy("rank").collect()]
    assert rows[0] == (0, 0) and rows[1] == (2, 0) and (found.total_shards, found.successful_shards) == (3, 3)
    assert index.search(queries(spark, [(1, 0.1, 0, 0)]), 50).rows.count() == 6 and index.ping() == {0: True, 1: True, 2: True}


def test_requests_and_partial_failure(spark):
    index = cluster.ShardedIndex.build(three_shards(spark), "flat", "cosine")
    q = queries(spark, [(1, 0.1, 0, 0)])
    for bad in (lambda: index.search(q, 0), lambda: index.search(queries(spark, []), 3)):
        with pytest.raises(InvalidArgument):
            bad()
    with pytest.raises(Unavailable):
        index.search(q, 1, metric="l2")
    assert index.search(q, 1, metric="cosine").rows.first()["id"] == 0

    def fails(*_):
        raise OSError("gone")

    index.shards[1].run = fails
    part = index.search(q, 10)
    assert (part.total_shards, part.successful_shards) == (3, 2) and part.rows.count() == 4 and part.status[1][2] == "gone"
    assert cluster.ShardedIndex().search(q, 3).rows.count() == 0
    stats = {r["shard_id"]: r["num_vectors"] for r in cluster.shard_stats(three_shards(spark)).collect()}
    assert stats == {0: 2, 1: 2, 2: 2}
    with pytest.raises(InvalidArgument):
        cluster.ShardedIndex.build(three_shards(spark), "tree")
