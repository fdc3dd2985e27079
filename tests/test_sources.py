import json

import numpy as np
import pytest
from helpers import ids, queries, vectors, wave

from simvane import cli
from simvane.config import HnswConfig, IvfPqConfig
from simvane.errors import DimensionMismatch, FileSizeMismatch, InvalidHeader
from simvane.functions.metrics import Metric
from simvane.operators import hnsw, ivf, knn
from simvane.sources import datagen, index_files, vector_file
from simvane.streaming.query_stream import search_stream


def rows(df):
    return {(r["shard_id"], r["id"]): r["embedding"] for r in df.collect()}


def test_vector_files(spark, tmp_path):
    x = wave(23, 5, 7, 13, 3, 97, 0.5)
    folder = str(tmp_path / "v")
    vector_file.write_vectors(vectors(spark, x, 4), folder, 3)
    names = vector_file.discover(folder)
    assert len(names) == 3 and sum(len(vector_file.decode(open(n, "rb").read())) for n in names) == 23
    by_files, by_ranges = vector_file.read_vectors(spark, folder), spark.read.format("vector_file").option("rowsPerPartition", 4).load(folder)
    assert rows(by_files) == rows(by_ranges) and len(rows(by_files)) == 23
    vector_file.write_vectors(vectors(spark, x), folder)
    assert len(vector_file.discover(folder)) == 1 and [v for _, v in sorted(rows(spark.read.format("vector_file").load(folder)).items())] == x.tolist()


def test_bad_vector_files(tmp_path):
    good = vector_file.encode(np.ones((2, 3), np.float32))
    assert vector_file.decode(good + b"more").shape == (2, 3)
    for raw, error in ((bytes(24), InvalidHeader), (good[:-1], FileSizeMismatch), (good[:10], FileSizeMismatch)):
        with pytest.raises(error):
            vector_file.decode(raw)
    for i, dim in enumerate((3, 4)):
        (tmp_path / f"shard_{i}.bin").write_bytes(vector_file.encode(np.ones((1, dim), np.float32)))
    with pytest.raises(DimensionMismatch):
        vector_file.discover(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        index_files.load(str(tmp_path / "none"))


def test_graph_file(spark):
    index = hnsw.build(hnsw.shard(vectors(spark, wave(30, 4, 7, 13, 3, 97, 0.01)), 1), "l2", HnswConfig(4))
    graph, order = index_files.graph_file(index, 0)
    raw = index_files.encode_graph(graph)
    again = index_files.decode_graph(raw)
    assert again.layers == graph.layers and (again.entry, again.max_level, len(order)) == (graph.entry, graph.max_level, 30)
    empty = index_files.decode_graph(index_files.encode_graph(index_files.GraphFile(HnswConfig(), [[]], 0, None)))
    assert empty.entry is None and empty.layers == [[[]]]
    for bad in (bytes(len(raw)), raw[:8] + (999).to_bytes(4, "little") + raw[12:], raw[:40]):
        with pytest.raises(InvalidHeader):
            index_files.decode_graph(bad)


def test_ivf_and_centroid_files(spark):
    index = ivf.build(vectors(spark, wave(40, 4, 7, 13, 3, 97, 0.01)), IvfPqConfig(4, 2, 2, 8, 3))
    f = index_files.ivf_file(index)
    again = index_files.decode_ivf(index_files.encode_ivf(f))
    assert np.allclose(again.codebook, f.codebook, atol=1e-6) and [a[0].tolist() for a in again.lists] == [a[0].tolist() for a in f.lists]
    for m in Metric:
        c = index_files.decode_centroids(index_files.encode_centroids(index_files.CentroidFile(m, np.ones((2, 3)), 7, 1.5)))
        assert (c.metric, c.iterations, c.inertia, c.centroids.shape) == (m, 7, 1.5, (2, 3))
    raw = bytearray(index_files.encode_centroids(c))
    raw[12] = 99
    with pytest.raises(InvalidHeader):
        index_files.decode_centroids(bytes(raw))


@pytest.mark.parametrize("kind", datagen.KINDS)
def test_generator(spark, kind):
    one, many = (sorted((r["id"], r["embedding"]) for r in datagen.generate(spark, 30, 6, kind).repartition(p).collect()) for p in (1, 5))
    x = np.array([e for _, e in one])
    assert one == many and x.shape == (30, 6)
    if kind == "sphere":
        assert np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-6)
    if kind == "uniform":
        assert np.abs(x).max() <= 1
    assert datagen.sharded(datagen.generate(spark, 10, 2), 3, 10).select("shard_id").distinct().count() == 3


def test_ground_truth(spark):
    v = vectors(spark, [(float(i),) for i in range(6)])
    row = datagen.ground_truth(v, queries(spark, [(2.2,)]), 3).first()
    assert [t["id"] for t in row["top_k"]] == [2, 3, 1]


def test_query_stream(spark, tmp_path):
    v, q = vectors(spark, [(float(i),) for i in range(6)]), queries(spark, [(2.2,), (4.9,)])
    q.write.parquet(str(tmp_path / "q"))
    found = {}
    stream = search_stream(spark.readStream.schema(q.schema).parquet(str(tmp_path / "q")), v, 2, lambda df, n: found.update({n: ids(df)}))
    run = stream.option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert found[0] == ids(knn.knn(v, q, 2)) == [2, 3, 5, 4]


def test_commands(spark, tmp_path):
    data, asked = str(tmp_path / "data"), str(tmp_path / "asked")
    cli.main(["generate", "--rows", "40", "--dimension", "4", "--shards", "2", "--out", data])
    cli.main(["generate", "--rows", "3", "--dimension", "4", "--seed", "1", "--out", asked])
    cli.main(["train-centroids", "--data", data, "--k", "3", "--iters", "4", "--out", str(tmp_path / "c.bin")])
    assert index_files.decode_centroids(index_files.load(str(tmp_path / "c.bin"))).centroids.shape == (3, 4)
    cli.main(["search", "--data", data, "--queries", asked, "--k", "5", "--out", str(tmp_path / "found")])
    assert sorted((r["query_id"], len(r["top_k"])) for r in spark.read.json(str(tmp_path / "found")).collect()) == [(0, 5), (1, 5), (2, 5)]


def test_command_line_of_indexes(spark, tmp_path):
    for name, n, files in (("data", 40, 2), ("asked", 3, 1)):
        vector_file.write_vectors(vectors(spark, wave(n, 8, 7, 13, 3, 97, 0.01), 2), f"file:{tmp_path}/{name}", files)
    data, asked = str(tmp_path / "data"), str(tmp_path / "asked")
    for kind, parameter in (("hnsw", 60), ("ivf_pq", 64)):
        cli.main(["build-index", "--data", data, "--kind", kind, "--out", str(tmp_path / kind)])
        cli.main(["search-index", "--index", str(tmp_path / kind), "--kind", kind, "--queries", asked, "--k", "4", "--parameter", str(parameter), "--out", str(tmp_path / f"{kind}_found")])
        found = spark.read.json(str(tmp_path / f"{kind}_found"))
        assert {"query_id", "rank", "id", "score"} == set(found.columns) and found.count() > 0
    cli.main(["bench", "--data", data, "--queries", asked, "--k", "3", "--repeat", "3", "--out", str(tmp_path / "bench.json")])
    told = json.loads(index_files.load(f"file:{tmp_path}/bench.json"))
    assert told["ready"] == told["shards"] == told["answered"] == 2 and told["queries"] == 3 and told["seconds"]["p50"] > 0
