"""The opN_ queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import bpe, embeddings, jaccard, language, license, lines, mixing, oracles, repeats, tiff, toxicity
from quarry.llm.common import table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.document_media(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.CATEGORIES)
    return found.select("*", toxicity.toxic_columns().alias("rejected"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.ordered(mixing.plan(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("position", 9).alias("position"))


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near(table(spark, sf_dir, "embeddings"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer())


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.strip_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_repeats, op2_jaccard, op3_tiff, op4_toxicity, op5_language, op6_mixing, op7_license, op8_embeddings, op9_bpe, op10_lines)}
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
