"""The registered queries opN_<name>: each operator with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simvane.llm import bpe, embedding_dedup, html_text, language_id, line_dedup, mixing, nbsvm, quality_rules, simhash, toxicity
from simvane.llm.vocabularies import path
from simvane.session import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learnt from labels outside the held-out fold; odd rows as ``nbsvm.quality_classifier`` states."""
    return nbsvm.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of every document's ids and decoded text; a null text is empty, repeated rows each return."""
    found = bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), path("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document in the mixture, with its block and place; a null text has no tokens and goes along."""
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and wordless texts have the fingerprint zero and link like any other."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and keeper of every vector; null, zero and non-finite vectors link with nothing."""
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated three-line passages; a null text stays null."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from labels outside the held-out fold; odd rows as ``toxicity.toxicity`` states."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, measures and verdict of every document; a null or empty text has no word and fails."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), quality_rules.Rules(path("piece_bpe_32k.model"), path("byte_bpe_multi_50k.tiktoken")))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; a null, empty or textless page has an empty one."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those outside the held-out fold; ``und`` for a null text or one without a letter."""
    return language_id.language_id(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_bpe, op3_mixing, op4_simhash, op5_embedding_dedup, op6_line_dedup, op7_toxicity, op8_quality_rules, op9_html_text, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.oracle_sql(), "op6_line_dedup": line_dedup.ORACLE_SQL}
