"""Edge lists: reading, cleaning, renumbering; partitions given as seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import numbered


def read_edges(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """(a, b, weight) of lines "a b" or "a b weight", with every edge's reverse unless it is a loop."""
    rows = spark.read.csv(path, sep=" ", schema="a bigint, b bigint" + (", weight double" if weighted else ""))
    rows = rows if weighted else rows.withColumn("weight", F.lit(1.0))
    return with_reverse(rows.where("a is not null and b is not null"))


def with_reverse(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse, unless it is a loop; the edges are read once."""
    there, back = F.struct("a", "b", "weight"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "weight")
    return edges.select(F.inline(F.when(F.col("a") != F.col("b"), F.array(there, back)).otherwise(F.array(there))))


def clean_edges(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """One row for parallel edges: the summed weight, or 1 if unweighted."""
    return edges.groupBy("a", "b").agg((F.sum("weight") if weighted else F.lit(1.0)).alias("weight"))


def renumber(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges over dense ids from 0, names (node, id)), ids in the nodes' order."""
    names = numbered(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "node", "id")
    out = edges.join(names.withColumnsRenamed({"node": "a", "id": "ia"}), "a").join(names.withColumnsRenamed({"node": "b", "id": "ib"}), "b")
    return out.select(F.col("ia").alias("a"), F.col("ib").alias("b"), "weight"), names


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """(node, community) of lines "node community"."""
    return spark.read.csv(path, sep=" ", schema="node bigint, community bigint")
