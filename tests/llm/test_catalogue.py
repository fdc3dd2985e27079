"""Every registered query of the corpus operators, through the driver's entry, over small tables."""

import numpy as np
import pytest
from corpus import ODD, documents, prose

import __spark_entry__

COLUMNS = {
    "op1_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op3_mixing": {"doc_id": "bigint"},
    "op4_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_line_dedup": {"doc_id": "bigint", "text": "string"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "pipeline": {"doc_id": "bigint"},
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = [(i, prose(i, 70)) for i in range(100, 130)] + [(i, t) for i, t in ODD if i is not None] + [(200, prose(100, 70))]
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(100, 130)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    x = np.random.default_rng(0).normal(size=(30, 8))
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate([*x, x[0] * 2])], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(1, "u", "<article><p>Some text</p></article>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder), len(rows)


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_through_the_entry(spark, tables, name):
    folder, n = tables
    out = __spark_entry__.queries()[name](spark, folder)
    assert COLUMNS[name].items() <= dict(out.dtypes).items()
    rows = out.collect()
    want = {"op5_embedding_dedup": 31, "op9_html_text": 2}.get(name, n)
    assert rows and (len(rows) == want or name in ("pipeline", "op3_mixing"))


def test_every_operator_is_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(names) < set(COLUMNS)
