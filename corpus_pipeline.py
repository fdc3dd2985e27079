"""The corpus pipeline: rules, line and near-duplicate removal, source mixing and tokenizing of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simvane.llm import bpe, line_dedup, mixing, quality_rules, simhash
from simvane.llm.vocabularies import path
from simvane.session import table, written


def set_apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], *added: str) -> DataFrame:
    """What a stage returns, in the columns of ``docs``; those named like columns that the operator adds pass it under other names."""
    own = [c for c in docs.columns if c in added]
    out = stage(docs.withColumnsRenamed({c: f"__sv_kept_{c}" for c in own})).drop(*own)
    return out.withColumnsRenamed({f"__sv_kept_{c}": c for c in own}).select(*docs.columns)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the quality rules."""
    return quality_rules.quality_rules(docs, quality_rules.Rules(path("piece_bpe_32k.model"), path("byte_bpe_multi_50k.tiktoken")), keep=docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated three-line passages out of the texts; n_chars follows the text."""
    cleaned = set_apart(docs, line_dedup.line_dedup, "n_lines", "n_removed")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group."""
    return simhash.one_of_each_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources until the sources have their weights; none is left out."""
    return set_apart(docs, mixing.mix, "epoch", "block")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes its ids."""
    return bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), path("word_bpe_49k.json")).drop("text")


STAGES = [
    ("quality_rules", rules_stage),
    ("line_dedup", lines_stage),
    ("simhash_near_dedup", near_duplicates_stage),
    ("source_mixing", mixing_stage),
    ("bpe_tokens", tokens_stage),
]

#: Fertility and fingerprints have no SQL; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each one's result written to the shared folder and read again.

    Documents with a null, empty or short text go with the rules; a null id stays null, and of several such rows
    each is a document of its own unless their texts are alike. Repeated rows count as copies: one stays. Of
    documents that tie in a group the smallest id stays. Columns beside those of documents pass through up to the
    mixing; no row gives no row.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
