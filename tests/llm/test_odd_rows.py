"""Every operator on rows that break things, beside columns of clashing names, and on empty tables."""

import pytest
from corpus import CLASHES, ODD, documents

from simvane.llm import bpe, embedding_dedup, html_text, language_id, line_dedup, mixing, nbsvm, quality_rules, simhash, toxicity
from simvane.llm.vocabularies import path

PIECES, WORD_BPE = path("piece_bpe_32k.model"), path("word_bpe_49k.json")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD, clashes=True).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [], clashes=True)


def test_rules(spark, odd, none):
    rules = quality_rules.Rules(PIECES, path("byte_bpe_multi_50k.tiktoken"))
    rows = quality_rules.quality_rules(odd, rules).collect()
    assert len(rows) == len(ODD) and all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 50)
    kept = quality_rules.quality_rules(odd, rules, keep=odd.columns)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {6}
    assert quality_rules.quality_rules(none, rules).count() == 0


@pytest.mark.parametrize("operator", [nbsvm.quality_classifier, toxicity.toxicity])
def test_classifiers(spark, odd, none, operator):
    known = labels(spark, [(6, 1, 0), (6, 1, 0), (11, 0, 1), (10, 0, 1), (None, 1, 1), (4, None, None), (8, 1, 0), (9, 1, 0), (12, 0, 1)])
    for given in (known, labels(spark, []), labels(spark, [(6, 1, 1)])):
        rows = operator(odd, given).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert operator(none, known).count() == 0


def test_languages(spark, odd, none):
    rows = language_id.language_id(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 5)} == {"und"} and {r["lang_pred"] for r in rows if r["doc_id"] in (7, 8, 9)} == {"en"}
    assert language_id.language_id(none).count() == 0


def test_tokens(spark, odd, none):
    rows = bpe.encode_and_decode(odd, WORD_BPE)
    assert set(CLASHES) <= set(rows.columns) and rows.count() == len(ODD)
    assert all(r["n_tokens"] == 0 and r["decoded"] == "" for r in rows.collect() if not (r["text"] or "").strip())
    assert bpe.decode_documents(bpe.encode_documents(none, WORD_BPE), WORD_BPE).count() == 0


def test_lines(spark, odd, none):
    out = line_dedup.line_dedup(odd)
    rows = out.collect()
    assert len(rows) == len(ODD) and [r["text"] for r in rows if r["doc_id"] == 13] == ["same line"]
    assert [r["text"] for r in rows if r["doc_id"] == 6].count(next(t for i, t in ODD if i == 6)) == 2, "repeated rows are one document"
    assert all(r["covered"] == "mine" for r in rows) and line_dedup.line_dedup(none).count() == 0


def test_fingerprints(spark, odd, none):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {1}
    one = simhash.one_of_each_group(odd)
    assert one.columns == odd.columns and [r["doc_id"] for r in one.collect()].count(6) == 2
    assert simhash.simhash_groups(none).count() == 0 and simhash.one_of_each_group(none).count() == 0


def test_mixture(spark, odd, none):
    out = mixing.mix(odd, mixing.Parameters(bucket=2))
    assert set(odd.columns) <= set(out.columns) and out.where("epoch = 0").count() == len(ODD)
    assert mixing.schedule(odd).where("epoch = 0").count() == len(ODD) and mixing.mix(none).count() == 0


def test_pages(spark):
    rows = [(None, None, None), (1, "u", ""), (2, "u", "<p>" * 2000 + "deep"), (3, None, "plain & simple"), (3, None, "plain & simple"), (4, "u", "<article><p>a&nbsp;b\n c<p>d</article"), (5, "u", "<nav>menu</nav><div class='cookie-notice'>ok?</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' AS text", "'mine' AS n_chars")
    found = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()]
    assert found[0] == (None, "", 0) and found[1] == (1, "", 0) and found[2][1] == "deep" and found[3] == found[4] == (3, "plain & simple", 14)
    assert found[5][1] == "a b c\nd" and found[6][1] == ""
    assert html_text.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors(spark, kind):
    inf, nan = float("inf"), float("nan")
    rows = [(None, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0]), (11, [0.9, 0.1]), (12, [-1.0, -0.0]), (12, [-1.0, 0.0])]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "'mine' AS node", "'mine' AS v", "1 AS label")
    found = [tuple(r) for r in embedding_dedup.embedding_groups(table).collect()]
    by_id = {i: (n, c, k) for i, n, c, k in found}
    assert len(found) == len(rows) and by_id[None] == (0, None, False)
    assert all(by_id[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10))
    assert by_id[7] == (3, 7, True) and by_id[8] == (3, 7, False) and by_id[11] == (3, 7, False) and by_id[12] == (1, 12, True)
    assert embedding_dedup.embedding_groups(table.where("false")).count() == 0
