"""The topic graph: symmetric edges, overlap weights, first and second order contexts, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import category_weight
from ..storage import written


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) and (b, a) of every edge, once each."""
    return edges.select("a", "b").union(edges.select("b", "a")).distinct()


def common_neighbours(near: DataFrame, degree: DataFrame) -> DataFrame:
    """(a, b, common), a < b, of the joined pairs that have common neighbours; ``near`` both ways, ``degree`` (a, d).

    These are the triangles over each edge. Edges point from the smaller degree to the
    larger, so a node has at most the root of twice the edges to pair up, hubs included,
    and each triangle is found once, at its smallest corner: a node's list goes to each of
    its ends, to be cut with that one's list, and no row is made for a pair that isn't joined.
    """
    sized = near.where("a < b").join(degree.withColumnsRenamed({"d": "da"}), "a").join(degree.withColumnsRenamed({"a": "b", "d": "db"}), "b")
    up = F.col("da") <= F.col("db")  # of equal degrees the smaller id, which is a
    pick = lambda x, y, name: F.when(up, F.col(x)).otherwise(F.col(y)).alias(name)
    out = written(sized.select(pick("a", "b", "u"), pick("b", "a", "v"), pick("db", "da", "d")), "directed")
    ends = out.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("e")).select("u", F.transform("e", lambda x: x["v"]).alias("vs"))
    ends = written(ends, "directed-lists")
    sent = ends.select("u", "vs", F.posexplode("vs").alias("at", "v")).where(F.col("at") + 1 < F.size("vs")).select("u", "v", F.expr("slice(vs, at + 2, size(vs))").alias("rest"))
    closed = sent.join(ends.select(F.col("u").alias("v"), F.col("vs").alias("ws")).hint("shuffle_hash"), "v").select("u", "v", F.explode(F.array_intersect("rest", "ws")).alias("w"))
    sides = F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("u").alias("x"), F.col("w").alias("y")), F.struct(F.col("v").alias("x"), F.col("w").alias("y"))))
    return closed.select(sides.alias("s")).groupBy(F.least("s.x", "s.y").alias("a"), F.greatest("s.x", "s.y").alias("b")).agg(F.count("*").alias("common"))


def link_weights(edges: DataFrame) -> DataFrame:
    """(a, b, w1, w2) of every distinct edge: common neighbours plus one over each end's neighbours plus one.

    Neighbourhoods are taken in both directions; a loop is its node's own neighbour.
    """
    one = written(edges.select("a", "b").distinct(), "edges")  # several branches start from these
    near = written(both_ways(one), "neighbours")
    degree = near.groupBy("a").agg(F.count("*").alias("d"))
    sized = one.join(degree.withColumnsRenamed({"d": "da"}), "a").join(degree.withColumnsRenamed({"a": "b", "d": "db"}), "b")
    loops = near.where("a = b").select(F.col("a").alias("n"))
    common = common_neighbours(near, degree).select(F.col("a").alias("x"), F.col("b").alias("y"), "common")
    found = sized.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(common, ["x", "y"], "left")
    for end in ("a", "b"):  # a node with a loop is common to itself and each of its neighbours
        found = found.join(loops.select(F.col("n").alias(end), F.lit(1).alias(f"__{end}")), end, "left")
    own = F.when(F.col("a") == F.col("b"), F.col("da")).otherwise(F.coalesce(F.col("common"), F.lit(0)) + F.coalesce(F.col("__a"), F.lit(0)) + F.coalesce(F.col("__b"), F.lit(0)))
    return found.select("a", "b", ((own + 1) / (F.col("da") + 1)).alias("w1"), ((own + 1) / (F.col("db") + 1)).alias("w2"))


def merged_weights(weights: DataFrame) -> DataFrame:
    """(topic, context, weight): the lesser of the two weights, its root where the context is a category."""
    return weights.select(F.col("a").alias("topic"), F.col("b").alias("context"), category_weight("b", F.least("w1", "w2")).alias("weight"))


def ranked(df: DataFrame, by: str, order: list, top: int, name: str = "rank") -> DataFrame:
    """The first ``top`` rows of each group; Spark prunes each partition to them before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col(name) <= top)


def all_contexts(merged: DataFrame, few: int = 10, top: int = 30, decay: float = 0.1) -> DataFrame:
    """(topic, context, weight, hops): first-order contexts; for topics with fewer than ``few``, second-order ones too; the best ``top``.

    A second-order weight is decay * w(topic, via) * w(via, context), over the smallest
    ``via``; contexts that are direct already, or the topic itself, are left out.
    """
    first = written(merged.where("topic <> context").select("topic", "context", F.round("weight", 12).alias("weight")), "first-contexts")
    sparse = first.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") < few).select("topic")
    one = first.join(sparse, "topic", "left_semi").select("topic", F.col("context").alias("via"), F.col("weight").alias("w"))
    two = one.join(first.select(F.col("topic").alias("via"), "context", F.col("weight").alias("w2")), "via").where("context <> topic")
    two = two.join(first.select("topic", "context"), ["topic", "context"], "left_anti")
    two = two.groupBy("topic", "context").agg(F.min_by(F.col("w") * F.col("w2") * decay, "via").alias("weight")).select("topic", "context", F.round("weight", 12).alias("weight"), F.lit(2).alias("hops"))
    every = first.withColumn("hops", F.lit(1)).unionByName(two)
    return ranked(every, "topic", [F.desc("weight"), "context"], top).drop("rank")


def context_profile(topics: DataFrame, merged: DataFrame) -> DataFrame:
    """(context, weight): contexts of the given topics with their summed weights."""
    return merged.join(topics.select("topic").distinct(), "topic", "left_semi").where("topic <> context").groupBy("context").agg(F.sum("weight").alias("weight"))


def phrase_query(form: str, targets: DataFrame, merged: DataFrame, weights: DataFrame, top: int = 50) -> DataFrame:
    """What a form may mean: (topic, n, form_weight, context, weight), the best topics each with its best contexts."""
    mine = targets.where(F.col("form") == form).orderBy(F.desc("n"), "topic").limit(top)
    near = ranked(merged.join(F.broadcast(mine.select("topic")), "topic", "left_semi"), "topic", [F.desc("weight"), "context"], top).drop("rank")
    return mine.join(weights.where(F.col("form") == form).select("form", F.col("weight").alias("form_weight")), "form", "left").join(near, "topic", "left").select("topic", "n", "form_weight", "context", "weight")


def topic_dot_products(merged: DataFrame) -> DataFrame:
    """(a, b, dot), a < b: summed products of weights over shared contexts."""
    other = merged.select(F.col("topic").alias("b"), "context", F.col("weight").alias("w2"))
    return merged.select(F.col("topic").alias("a"), "context", "weight").join(other, "context").where("a < b").groupBy("a", "b").agg(F.sum(F.col("weight") * F.col("w2")).alias("dot"))
