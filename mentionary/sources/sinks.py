"""What a linked document is written as: nested JSON or XML, annotated HTML, DOT graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import font_size, page_url


def resolution_documents(resolved: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, sites array<struct<id, topic, weight, start, end, peers array<struct<topic, via, weight>>>>): one nested row a document."""
    peers = links.groupBy("doc", F.col("site1").alias("site"), F.col("start1").alias("start"), F.col("topic1").alias("topic")).agg(F.array_sort(F.collect_list(F.struct(F.col("topic2").alias("topic"), "via", "weight"))).alias("peers"))
    each = resolved.join(peers, ["doc", "site", "start", "topic"], "left").select("doc", F.struct(F.col("start"), F.col("end"), F.col("site").alias("id"), "topic", "weight", "peers").alias("s"))
    return each.groupBy("doc").agg(F.array_sort(F.collect_list("s")).alias("sites"))


def write_xml(df: DataFrame, path: str, row: str = "document", root: str = "documents") -> None:
    df.write.mode("overwrite").format("xml").option("rowTag", row).option("rootTag", root).save(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def annotated_html(words: DataFrame, resolved: DataFrame) -> DataFrame:
    """(doc, html): words in order, mentions as links to their topic in a size that follows the weight."""
    tag = F.format_string('<a href="%s" style="font-size:%.0fpx">', page_url("topic"), font_size("weight"))
    opens = resolved.select("doc", F.col("start").alias("pos"), tag.alias("open"))
    closes = resolved.select("doc", F.col("end").alias("pos"), F.lit("</a>").alias("close"))
    safe = F.replace(F.replace(F.replace(F.col("word"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    each = words.join(opens, ["doc", "pos"], "left").join(closes, ["doc", "pos"], "left").select("doc", F.struct("pos", F.concat(F.coalesce("open", F.lit("")), safe, F.coalesce("close", F.lit(""))).alias("h")).alias("w"))
    return each.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["h"]), " ").alias("html"))


def dot_lines(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(line) of each edge (a, b, weight) in the DOT language, for ``write.text`` between its first and last line."""
    arrow = "->" if directed else "--"
    quoted = lambda c: F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"'))
    return edges.select(F.format_string(f'  "%s" {arrow} "%s" [label="%.6f"];', quoted("a"), quoted("b"), F.col("weight")).alias("line"))


def dot_document(edges: DataFrame, directed: bool = False) -> str:
    """A whole DOT document of a graph small enough to draw."""
    kind = "digraph" if directed else "graph"
    return "\n".join([f"{kind} g {{", *sorted(r.line for r in dot_lines(edges, directed).collect()), "}"])
