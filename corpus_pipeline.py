"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing, BPE. Each stage takes the rows that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarry.llm import bpe, jaccard, lines, mixing, toxicity
from quarry.llm.common import checkpoint_dir, remove, table
from quarry.llm.registry import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text that boilerplate lines would leave less than this share of stays whole: it is a copy on many sites rather than a page with boilerplate, and the next stage deals with it.
SPARE = 0.5


def documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go. Null and empty texts stay."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), toxicity.CATEGORIES, keep=COLUMNS)
    return scored.where(~toxicity.toxic_columns()).select(*COLUMNS)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go; every document stays, with what is left of its text, or whole if that is less than SPARE of it."""
    return documents(lines.strip_lines(docs, spare=SPARE))


def nth(key: str) -> Column:
    """The number, from 1, of a row among those of its key, in the order of what they may differ in."""
    return F.row_number().over(Window.partitionBy(key).orderBy("lang", "source", "n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similarity of their five-word shingles, 0.8 or more, one stays: that with the smallest doc_id, of rows of one id one by a hash and then by the other columns; a row without an id only where none has one. Texts without words link with nothing and all stay."""
    key = lambda mark: F.xxhash64(F.col("doc_id").isNull(), "doc_id", mark)
    found = jaccard.join(docs, words=5, threshold=(80, 100), detail=True)
    one = found.where("n_shingles > 0").groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one")).select("one.doc_id", "one.text_hash", F.lit(True).alias("once"))
    every = found.where("n_shingles = 0").select("doc_id", "text_hash", F.lit(False).alias("once")).distinct()
    kept = one.union(every).select(key("text_hash").alias("key_kept"), "once")
    rows = docs.select(*COLUMNS, key(F.xxhash64(F.coalesce("text", F.lit("")))).alias("key"))
    return rows.join(kept.hint("shuffle_hash"), rows["key"] == kept["key_kept"]).withColumn("nth", nth("key")).where("nth = 1 or not once").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a document that is taken n times is there n times, one that is not taken is gone. Rows are range-sorted by training position. Rows that repeat id, text and source each have a plan of their own."""
    key = F.xxhash64("order", F.col("source").isNull(), "source").alias("key")
    plan = mixing.plan(docs)
    used = ["copies", "start", "target", "source_size", "rate_from", "rate_to", "all_from", "all_to"]
    plans = plan.select(key, F.struct(*used).alias("one")).groupBy(F.col("key").alias("key_plans")).agg(F.array_sort(F.collect_list("one")).alias("plans"))
    rows = docs.select(*COLUMNS, mixing.row_hash(F.col("doc_id"), F.col("text")).alias("order")).select(*COLUMNS, key)
    joined = rows.join(plans.hint("shuffle_hash"), rows["key"] == plans["key_plans"]).withColumn("nth", nth("key")).withColumn("one", F.get("plans", F.col("nth") - 1))
    return mixing.schedule(joined.select(*COLUMNS, *(f"one.{c}" for c in used))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the tokens and the decoded text."""
    return bpe.encode_documents(docs, tokenizer())


STAGES = [("toxicity", toxic), ("line_dedup", boilerplate), ("ngram_jaccard", near_duplicates), ("mixing", mixed), ("bpe", encoded)]

#: The classifier, the tokenizer and the hash that orders a source's documents have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet to the checkpoint folder and read again as the next one's, and removed when that is written too. The last stage's input stays, as its rows are made when the result is read."""
    docs, home, before = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{home}/{k}-{name}")
        docs = spark.read.parquet(f"{home}/{k}-{name}")
        if before:
            remove(spark, before)
        before = f"{home}/{k}-{name}"
    return docs
