"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge that isn't null; the component is its smallest node.

    Each round is two groupings by node, and cuts its lineage with a written table. The
    number of rounds grows with the logarithm of the components' diameter; no node's
    neighbours are gathered in one row.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = written(pairs.where("u = v").select("u").distinct(), "cc-loops")
    now, state = written(pairs.where("u <> v").distinct(), "cc-edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        star = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, written(star, "cc-edges")
        discard(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first()
        if new == state:
            break
        state = new
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return found.unionByName(roots).unionByName(alone.join(found.unionByName(roots).select("node"), "node", "left_anti"))
