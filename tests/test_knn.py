import numpy as np
import pytest
from helpers import frame, ids, queries, vectors, wave
from pyspark.sql import functions as F

from simvane.errors import DimensionMismatch, EmptyIndex, InvalidArgument, VectorIndexError
from simvane.functions.metrics import Metric, Order, Precision, badness, score_matrix
from simvane.operators import knn, topk

FIVE = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 1, 1)]


def brute(x, q, k, metric):
    scores = score_matrix(metric, np.float32(q), np.float32(x))
    return [i for row in badness(metric, scores) for i in np.lexsort((np.arange(len(row)), row))[:k]]


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("strategy", ["sharded", "replicated"])
def test_all_metrics_match_brute_force(spark, metric, strategy):
    x, q = wave(60, 9, 7, 13, 3, 97, 0.01), wave(4, 9, 5, 11, 5, 89, 0.01)
    for parts in (1, 7):
        assert ids(knn.knn(vectors(spark, x, parts), queries(spark, q), 5, metric, strategy)) == brute(x, q, 5, metric)


def test_limits_and_ties(spark):
    v, q = vectors(spark, FIVE), queries(spark, [(1, 0, 0)])
    assert ids(knn.knn(v, q, 50)) == [0, 3, 1, 2, 4]
    assert ids(knn.knn(v, q, 0)) == []
    assert ids(knn.knn(v, queries(spark, []), 3)) == []
    same = vectors(spark, [(1, 1)] * 9, 3)
    assert ids(knn.knn(same, queries(spark, [(0, 0)]), 4)) == [0, 1, 2, 3]
    assert [r["id"] for r in knn.search(v, [1, 0, 0], 2).orderBy("rank").collect()] == [0, 3]


def test_errors(spark):
    v, q = vectors(spark, FIVE), queries(spark, [(1, 0, 0)])
    with pytest.raises(EmptyIndex):
        knn.knn(vectors(spark, []), q, 3)
    with pytest.raises(DimensionMismatch):
        knn.knn(v, queries(spark, [(1, 0)]), 3)
    with pytest.raises(DimensionMismatch):
        knn.search(v, [1.0], 3)
    with pytest.raises(DimensionMismatch):
        knn.knn(vectors(spark, [(1, 0), (1,)]), queries(spark, [(1, 0)]), 1)
    with pytest.raises(VectorIndexError):
        knn.knn(frame(spark, [(1, None), (2, [1.0])]), queries(spark, [(1,)]), 1)
    with pytest.raises(InvalidArgument):
        knn.knn(v, q, -1)
    with pytest.raises(InvalidArgument):
        knn.knn(v, q, 1, strategy="other")


def test_query_blocks_give_one_result(spark, monkeypatch):
    x, q = wave(40, 4, 7, 13, 3, 97, 0.01), wave(9, 4, 5, 11, 5, 89, 0.01)
    monkeypatch.setattr(knn.query_blocks, "__defaults__", (4 * 8 * 4,))
    assert ids(knn.knn(vectors(spark, x), queries(spark, q), 3)) == brute(x, q, 3, "l2")


@pytest.mark.parametrize("parts", [1, 3])
def test_packed_blocks_meet_in_one_scan(spark, monkeypatch, tmp_path, parts):
    x, q = wave(70, 4, 7, 13, 3, 97, 0.01), wave(23, 4, 5, 11, 5, 89, 0.01)
    monkeypatch.setattr(knn, "SENT_BYTES", 10 * 8 * 4)  # blocks of 10 queries and of 2 rows
    vectors(spark, x, parts).write.parquet(str(tmp_path / "v"))
    found = knn.knn(spark.read.parquet(str(tmp_path / "v")), queries(spark, q), 3)
    assert ids(found) == brute(x, q, 3, "l2")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    sharded = vectors(spark, x).withColumn("shard_id", F.col("id").cast("int") % 2)
    own = knn.within(sharded, queries(spark, q).withColumn("shard_id", F.col("query_id").cast("int") % 2), 3)
    want = [i for n in range(len(q)) for i in [2 * j + n % 2 for j in brute(x[n % 2 :: 2], q[n : n + 1], 3, "l2")]]
    assert ids(own) == want
    local = knn.local_top_k(sharded, queries(spark, q), 2).collect()
    assert len(local) == 23 * 2 * 2 and all(r["id"] % 2 == r["shard_id"] for r in local)


def test_tiles_keep_ties_by_id():
    scores = np.random.default_rng(2).integers(0, 3, (5, 40)).astype(float)
    order = np.random.default_rng(3).permutation(40)
    for tile in (1, 17, 1 << 20):
        held = topk.BlockTopK(5, 7, "l2")
        for lo in range(0, 40, 9):
            held.add(lambda a, b, lo=lo: scores[a][:, lo : lo + 9][:, b], order[lo : lo + 9], tile)
        for i, row in enumerate(scores):
            assert sorted(zip(held.scores[i], held.ids[i])) == sorted(zip(row, order))[:7]


def test_metrics_with_parameters(spark):
    x, q = wave(40, 6, 7, 13, 3, 97, 0.01), wave(4, 6, 5, 11, 5, 89, 0.01)
    a = np.eye(6) * 2 + 0.25
    for metric in (Order(0.5), Order(4), Precision(tuple(a.ravel())), Precision(tuple(range(1, 7)))):
        assert ids(knn.knn(vectors(spark, x, 3), queries(spark, q), 5, metric)) == brute(x, q, 5, metric)
    d = x[0] - q[0]
    assert score_matrix(Precision(tuple(a.ravel())), q[:1], x[:1])[0, 0] == pytest.approx(np.sqrt(d @ a @ d))
    with pytest.raises(VectorIndexError):
        Order(0)
    with pytest.raises(VectorIndexError):
        score_matrix(Precision((1.0, 2.0)), q, x)


def test_not_a_number_sorts_last(spark):
    rows = frame(spark, [(0, 0, float("nan")), (0, 1, 2.0), (0, 2, 1.0)], "query_id long, id long, score double")
    for metric, want in (("l2", [2, 1, 0]), ("dot", [1, 2, 0])):
        assert ids(topk.top_k(rows, 3, metric)) == want


def test_merge_of_shard_lists(spark):
    lists = [frame(spark, [(0, i, s) for i, s in rows], "query_id long, id long, score double") for rows in ([(1, 0.5), (2, -1.0)], [(3, 0.5), (4, 2.0)], [])]
    assert ids(topk.merge_local_results(lists, 3, "l2")) == [2, 1, 3]
    assert ids(topk.merge_local_results(lists, 10, "cosine")) == [4, 1, 3, 2]
    assert ids(topk.merge_local_results(lists, 0, "l2")) == []
