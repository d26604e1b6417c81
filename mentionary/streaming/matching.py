"""Incremental joins, work queues and stateful top-k over streams of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_pairs(searches: DataFrame, positions: DataFrame, seen_search: int, seen_position: int) -> DataFrame:
    """(search, position): searches by positions of other users in which one side is above its high-water mark.

    Old searches meet new positions and new searches meet all, as two joins whose sides
    are cut before they meet; the pairs themselves are the result.
    """
    s, p = searches.select("search", F.col("user").alias("s_user")), positions.select("position", F.col("user").alias("p_user"))
    old = s.where(F.col("search") <= seen_search).crossJoin(p.where(F.col("position") > seen_position))
    new = s.where(F.col("search") > seen_search).crossJoin(p)
    return old.unionByName(new).where("s_user <> p_user").select("search", "position")


def unprocessed(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``work`` that have no row in ``done``."""
    return work.join(done.select(key), key, "left_anti")


def high_water(df: DataFrame, key: str) -> int:
    """The next id to ask for: one more than the greatest, 0 for none."""
    top = df.agg(F.max(key)).first()[0]
    return 0 if top is None else int(top) + 1


def read_stream(spark: SparkSession, folder: str, schema, files_a_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream; offsets live in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Start a query that gives every micro-batch to ``handle``; without ``every`` it takes what is there and stops. A failed batch is tried again from the checkpoint."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def match_stream(positions: DataFrame, searches: DataFrame, sink: str, checkpoint: str):
    """Append to ``sink`` the pairs of each micro-batch of new positions with the searches of other users; batches carry their number, so a batch that is tried again replaces itself."""

    def handle(batch: DataFrame, number: int) -> None:
        pairs = searches.select("search", F.col("user").alias("s_user")).crossJoin(batch.select("position", F.col("user").alias("p_user"))).where("s_user <> p_user").select("search", "position")
        pairs.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return each_batch(positions, handle, checkpoint)


def count_stream(positions: DataFrame, searches: DataFrame, sink: str, checkpoint: str):
    """Append to ``sink`` each micro-batch's positions with how many searches of other users there are (links), without a row for each of these. Users' searches are counted before they meet."""
    total = searches.where("user is not null").agg(F.count("*").alias("__all"))
    own = searches.where("user is not null").groupBy("user").agg(F.count("*").alias("__own"))

    def handle(batch: DataFrame, number: int) -> None:
        links = F.when(F.col("user").isNull(), F.lit(0)).otherwise(F.col("__all") - F.coalesce("__own", F.lit(0))).cast("bigint")
        batch.join(own, "user", "left").crossJoin(F.broadcast(total)).select("position", "user", links.alias("links")).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return each_batch(positions, handle, checkpoint)


def top_k_state(stream: DataFrame, k: int = 5) -> DataFrame:
    """(source, target, value): updates of each source's ``k`` best targets, kept as state.

    The state is the k values and targets; a row enters if there is room or it beats the
    worst, which then leaves (ties: the smaller target stays). Each batch that changes a
    source emits its whole list.
    """

    def update(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        targets, values = (list(x) for x in state.get) if state.exists else ([], [])
        best = {t: v for t, v in zip(targets, values)}
        for f in frames:
            for t, v in zip(f["target"], f["value"]):
                best[t] = max(v, best.get(t, v))
            best = dict(sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k])
        state.update((list(best), list(best.values())))
        yield pd.DataFrame({"source": key[0], "target": list(best), "value": list(best.values())})

    return stream.select(F.col("source").cast("long"), F.col("target").cast("long"), F.col("value").cast("double")).groupBy("source").applyInPandasWithState(update, "source long, target long, value double", "targets array<long>, vals array<double>", "update", "NoTimeout")


def event_log(stream: DataFrame, sink: str, checkpoint: str):
    """Append every event to a table."""
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, value): tumbling windows with a watermark. An addition: the system this follows had no event time."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "value")
