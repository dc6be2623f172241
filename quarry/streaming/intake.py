"""Continuous intake of files and the request policy as a stateless stream filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions import scalars as S


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """New files of a folder as a stream: file_id, name, length, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)
    return rows.select(F.sha2("path", 256).alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def sniffed(rows: DataFrame) -> DataFrame:
    kind, fmt = S.sniff("content")
    return rows.withColumn("kind", kind).withColumn("format", fmt).withColumn("category", S.category(F.col("name")))


def refused(requests: DataFrame, origin: str) -> DataFrame:
    """The requests (url, method) that the policy refuses, with the reason."""
    return requests.withColumn("why", S.egress(F.col("url"), F.col("method"), F.lit(origin))).where("why is not null")
