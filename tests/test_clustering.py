import numpy as np
import pytest
from helpers import ids, queries, vectors, wave

from simvane.config import IvfPqConfig
from simvane.errors import DimensionMismatch, EmptyIndex, InvalidConfig
from simvane.operators import ivf, kmeans, knn, pq, recall

TWO = [(0, 0), (0.1, 0), (0, 0.1), (10, 10), (10.1, 10), (10, 10.1)]


@pytest.mark.parametrize("init", ["random", "k-means++"])
def test_two_clusters(spark, init):
    found = kmeans.fit(vectors(spark, TWO, 3), 2, init=init)
    assert sorted(found.centroids.round(1).tolist()) == [[0, 0], [10, 10]] and found.iterations >= 1
    assert found.inertia == pytest.approx(4 * (2 / 30) ** 2 * 2.5 - 0, abs=0.2)
    assert found.meta(spark).first()["k"] == 2 and found.frame(spark).count() == 2


def test_limits(spark):
    v = vectors(spark, TWO[:3])
    assert kmeans.fit(v, 10).k == 3
    assert kmeans.fit(v, 0).k == 0 and kmeans.fit(vectors(spark, []), 3).k == 0
    none = kmeans.fit(v, 2, max_iters=0)
    assert none.iterations == 0 and none.inertia == float("inf")


def test_empty_cluster_takes_a_row(spark):
    found = kmeans.fit(vectors(spark, TWO), 2, max_iters=1, init=np.array([[0.0, 0.0], [1e6, 1e6]]))
    assert found.centroids[1].tolist() in [pytest.approx(list(t)) for t in TWO]


def test_partitions_do_not_matter(spark):
    x = wave(90, 4, 7, 13, 3, 97, 0.01)
    one, many = (kmeans.fit(vectors(spark, x, p), 5, 6) for p in (1, 7))
    assert np.allclose(one.centroids, many.centroids) and one.iterations == many.iterations


def test_probes(spark):
    c = np.array([[1.0, 0], [0, 1], [-1, 0]])
    q = queries(spark, [(1, 0.1)])
    for nprobe, want in ((0, []), (2, [0, 1]), (100, [0, 1, 2])):
        assert [r["cluster_id"] for r in kmeans.top_centroids(q, c, nprobe, "cosine").orderBy("rank").collect()] == want
    assert kmeans.nearest(np.array([[5.0, 5]]), np.array([[5.0, 5], [5, 5]]), "l2")[0].tolist() == [0]


def test_codes_and_tables():
    q = pq.ProductQuantizer(np.array([[[0.0, 0], [1, 1]], [[0, 0], [2, 2]]]))
    table = q.lookup_table(np.array([1.0, 1, 2, 2]), "l2")
    assert table.ravel().tolist() == [2, 0, 8, 0]
    assert q.table_scores(table, np.array([[1, 1], [0, 0]])).tolist() == [0, 10]
    codes = q.encode(np.array([[0.9, 1, 2, 1.5], [0, 0.1, 0.2, 0]]))
    assert codes.tolist() == [[1, 1], [0, 0]] and q.decode(codes).tolist() == [[1, 1, 2, 2], [0, 0, 0, 0]]
    assert q.sub_centroid(1, 1).tolist() == [2, 2] and (q.m, q.ksub, q.dimension) == (2, 2, 4)


def test_training_pads_with_zeros(spark):
    q = pq.train(vectors(spark, wave(6, 4, 7, 13, 3, 97, 0.01)), 2, 8)
    assert q.codebook.shape == (2, 8, 2) and (q.codebook[:, 6:] == 0).all()
    with pytest.raises(InvalidConfig):
        pq.train(vectors(spark, [(1, 2, 3)]), 2)


def test_build_search_save(spark, tmp_path):
    x = wave(100, 16, 7, 1, 0, 30, 1.0) + np.arange(100)[:, None] * 0.01
    v, q = vectors(spark, x, 3), queries(spark, x[::25])
    index = ivf.build(v, IvfPqConfig(8, 4, 4, 16, 10))
    assert index.total_vectors() == 100 and sum(r["size"] for r in index.list_sizes().collect()) == 100
    found = index.search(q, 5)
    share = recall.prefix_recall(found, knn.knn(v, q, 5), q).agg({"recall": "avg"}).first()[0]
    assert share >= 0.5
    exact = recall.recall(index.search(q, 5, nprobe=99, rerank=v, candidates=100), knn.knn(v, q, 5), q)
    assert [r["recall"] for r in exact.collect()] == [1.0] * 4
    index.save(str(tmp_path / "ivf"))
    again = ivf.IvfPqIndex.load(spark, str(tmp_path / "ivf"), 16)
    assert ids(again.search(q, 5)) == ids(found)
    assert ids(index.search(q, 0)) == []
    with pytest.raises(DimensionMismatch):
        ivf.IvfPqIndex.load(spark, str(tmp_path / "ivf"), 8)
    with pytest.raises(EmptyIndex):
        ivf.build(vectors(spark, []))


def test_configuration():
    for bad in ({"nlist": 0}, {"nprobe": 0}, {"nprobe": 65}, {"m": 0}, {"ksub": 0}, {"ksub": 257}, {"max_iters": 0}, {"tolerance": -1.0}):
        with pytest.raises(InvalidConfig):
            IvfPqConfig(**bad)
    with pytest.raises(InvalidConfig):
        IvfPqConfig().check_dimension(12)


def test_recall_rules(spark):
    truth = knn.knn(vectors(spark, [(float(i),) for i in range(8)]), queries(spark, [(0,)]), 4)
    q = queries(spark, [(0,)])
    half = truth.where("id < 2").unionByName(truth.where("id >= 2").withColumn("id", truth["id"] + 10))
    assert recall.recall(half, truth, q).first()["recall"] == 0.5 == recall.prefix_recall(half, truth, q).first()["recall"]
    none = truth.where("false")
    assert recall.recall(truth, none, q).first()["recall"] == 1.0 and recall.recall(none, truth, q).first()["recall"] == 0.0
    assert recall.prefix_recall(truth, none, q).first()["recall"] == 0.0
    assert recall.prefix_recall(truth.where("rank <= 2"), truth, q).first()["recall"] == 1.0
    assert recall.latency_percentiles([3.0, 1.0, 2.0])["p50"] == 2.0 and recall.latency_percentiles([]) == {}
