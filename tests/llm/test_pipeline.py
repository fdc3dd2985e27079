import numpy as np
import sentencepiece
from brute import components, fingerprint, keeps, mixed, without_repeats
from corpus import CLASHES, ODD, documents, prose
from tokenizers import Tokenizer

import corpus_pipeline
from simvane.llm import mixing, quality_rules
from simvane.llm.vocabularies import path


def corpus():
    rows = [(i, prose(i, 90), "s0" if i < 30 else f"s{1 + i % 4}") for i in range(50)]
    rows += [(60, "too short", "s0"), (61, "#### " * 90, "s1"), (62, "again and again " * 40, "s2"), (63, "", "s1")]
    rows += [(70 + i, rows[i][1], "s3") for i in range(5)] + [(80 + i, prose(800 + i, 60) + "\n" + prose(5, 90), "s0") for i in range(4)]
    return rows + [(90, prose(3, 90).replace("the", "thee", 1), "s4")]


def plain():
    pieces, pairs, rules = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model")), quality_rules.byte_pairs(path("byte_bpe_multi_50k.tiktoken")), quality_rules.Rules()
    source = {i: s for i, _, s in corpus()}
    docs = without_repeats({i: t for i, t, _ in corpus() if keeps(t, pieces, pairs, rules)})
    prints = {i: fingerprint(t) for i, t in docs.items()}
    root = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    docs = {i: t for i, t in docs.items() if root[i] == i}
    rows = mixed([(i, source[i], len(t.split())) for i, t in docs.items()], mixing.Parameters(), mixing.shares)
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    return sorted((i, ids[i]) for i, _, _ in rows)


def test_stages_match_plain_version(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in corpus()], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = plain()
    assert got == want and len({i for i, _ in got}) < len(got)


def test_stages_return_document_columns(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in corpus()[:8]], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("false"), str(tmp_path)).count() == 0


def test_stages_on_rows_that_break_things(spark, tmp_path):
    long = (90, (prose(5, 3000) + " ") * 60)
    assert len(long[1]) > 1 << 20
    rows = [*ODD, long, (91, prose(91, 90)), (91, prose(91, 90)), (92, prose(91, 90)), (None, prose(93, 90))]
    docs = documents(spark, rows, clashes=True)
    kept = corpus_pipeline.rules_stage(spark, docs, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, i) for i in (6, 6, 6, 91, 91, 92)] + [(True, 0)]
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and all(r[c] == "mine" for r in out.collect() for c in CLASHES), name
    assert corpus_pipeline.lines_stage(spark, docs, "").count() == len(rows)
    one = corpus_pipeline.near_duplicates_stage(spark, docs, "").collect()
    assert [r["doc_id"] for r in one].count(91) == 1 and [r["doc_id"] for r in one].count(92) == 0 and [r["doc_id"] for r in one].count(90) == 1
    dealt = corpus_pipeline.mixing_stage(spark, docs, "").collect()
    assert {(r["doc_id"], r["text"]) for r in dealt} == {tuple(r) for r in rows}
    coded = corpus_pipeline.tokens_stage(spark, docs, "")
    assert coded.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"] and coded.count() == len(rows)
    assert all(r["n_tokens"] == 0 and r["decoded"] == "" for r in coded.collect() if r["doc_id"] in (1, 2, 3))
