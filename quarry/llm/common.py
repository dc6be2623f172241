"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, shared by driver and executors. Where none is named, a local session, as in tests, gets a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint"))
    return context._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table in the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(column):
    """Lower-cases A-Z alone, as the contracts ask."""
    return F.translate(column, UPPER, UPPER.lower())


def by_row(columns: dict[str, pa.DataType], row: Callable[..., tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from a function of one row's values to one tuple; batches are re-cut so that memory follows the longest texts only."""
    schema = pa.schema(list(columns.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(*(batch.column(i)[k].as_py() for i in range(batch.num_columns))) for k in range(batch.num_rows)]
            arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), columns.values(), strict=True)] if rows else [pa.array([], kind) for kind in columns.values()]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def unpacked(packed: bytes) -> str:
    return zlib.decompress(packed).decode("utf-8", "surrogatepass")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long) by alternating large-star and small-star steps; returns (node, component) with the smallest node of each component, for nodes that have an edge to another.

    Every step is an aggregation by node and a join on it, so a component is never gathered in a task; a hub's rows meet in a min() with partial aggregation and in a join that adaptive execution splits. Each round is checkpointed. Nulls and self-loops are ignored.
    """
    pairs = edges.select("a", "b").where("a <> b")
    pairs = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        # large-star: each neighbour above a node links to the node's smallest neighbour, itself included
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: each neighbour below a node, and the node, link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        after = cut(small)
        same = after.select("u").distinct().count() == after.count() and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        pairs = after
        if same:  # every node has one edge, to a node without one below it: stars
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
