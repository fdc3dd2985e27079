import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from simvane.errors import Unavailable
from simvane.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_oracles_name_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(catalogue.queries()) >= 50


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {r["rank"] for r in rows} == set(range(1, 11))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["knn_l2", "knn_cosine", "kmeans_fit", "ivfpq_search", "pq_adc_search", "score_jaccard", "cluster_search", "shard_stats"])
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    same = lambda rows: sorted(tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in rows)
    assert same(got) == same(want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_index_search_has_its_recall(spark):
    data = "/root/testdata/sf0.1"
    v = catalogue.vectors(spark, data)
    q = catalogue.asked(v)
    found = catalogue.recall.recall(catalogue.queries()["ivfpq_build_search"](spark, data), catalogue.knn.knn(v, q, catalogue.K), q).collect()
    measured = sum(r["recall"] for r in found) / len(found)
    print("recall", measured)
    assert len(found) == 20 and measured >= 0.9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_registered_cluster_search_needs_every_shard(spark, monkeypatch):
    search = catalogue.cluster.Shard.search

    def failing(self, *args, **kwargs):
        if self.shard_id == 2:
            raise RuntimeError("lost executor")
        return search(self, *args, **kwargs)

    monkeypatch.setattr(catalogue.cluster.Shard, "search", failing)
    with pytest.raises(Unavailable, match="lost executor"):
        catalogue.queries()["cluster_search"](spark, DATA)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_whole_vectors_under_a_full_precision_matrix(spark):
    test_query_matches_its_sql(spark, "mahalanobis_whole")


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    root = Path(__spark_entry__.__file__).resolve().parent
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.parquet")
    shutil.copytree(root, tmp_path / "rest", ignore=skip)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; names = set(e.queries()); assert 'knn_l2' in names and not any(n.startswith('op') or n == 'pipeline' for n in names); assert set(e.oracle_sql()) <= names; import simvane.cli"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "rest", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    for path in (tmp_path / "rest" / "simvane").rglob("*.py"):
        assert "simvane.llm" not in path.read_text(), path
