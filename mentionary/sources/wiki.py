"""Pages from MediaWiki XML dumps, JSON documents, and the tables that hold a knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "title string, ns int, id bigint, redirect struct<_title: string>, revision struct<id: bigint, timestamp: string, text: struct<_VALUE: string>>"
KB = {
    "topics": "topic_id bigint, name string", "redirects": "from_id bigint, to_id bigint", "phrase_topics": "phrase_id bigint, topic_id bigint, n bigint", "contexts": "topic_id bigint, context_id bigint",
    "phrase_counts": "phrase_id bigint, n bigint", "link_weights": "topic_id bigint, context_id bigint, w1 double, w2 double", "word_dict": "word string, word_id bigint, n bigint", "phrase_trie": "phrase string, level int, parent string, word string, phrase_id bigint",
}


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(title, id, revision, text) of a dump, plain or compressed (.bz2 is split among tasks only if it holds many streams)."""
    raw = spark.read.format("xml").option("rowTag", "page").schema("title string, id bigint, revision struct<id: bigint, text: string>").load(path)
    return raw.select("title", "id", F.col("revision.id").alias("revision"), F.coalesce("revision.text", F.lit("")).alias("text"))


def write_pages(pages: DataFrame, path: str, rows_a_file: int = 0) -> None:
    """Pages as Parquet, optionally with at most ``rows_a_file`` rows in each file."""
    writer = pages.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", rows_a_file) if rows_a_file else writer).parquet(path)


def save_kb(tables: dict[str, DataFrame], path: str) -> None:
    """A knowledge base's tables under one folder, each sorted by its first column so that row groups can be skipped."""
    for name, df in tables.items():
        key = df.columns[0]
        df.repartitionByRange(key).sortWithinPartitions(*df.columns[:2]).write.mode("overwrite").parquet(f"{path}/{name}")


def load_kb(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def put(store: DataFrame | None, rows: DataFrame) -> DataFrame:
    """A key-value table (key, value) after ``rows`` were put: they win over what was there; of equal keys the greatest value."""
    new = rows.groupBy("key").agg(F.max("value").alias("value"))
    return new if store is None else store.join(new, "key", "left_anti").select("key", "value").unionByName(new)


def get(store: DataFrame, key: str) -> DataFrame:
    return store.where(F.col("key") == key).select("value")


def parse_json(c: Column | str, schema: str) -> Column:
    """JSON text by a schema (numbers as double, whatever they look like); null where it isn't JSON."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def variant(c: Column | str) -> Column:
    """JSON text of any shape; null where it isn't JSON."""
    return F.try_parse_json(c)
