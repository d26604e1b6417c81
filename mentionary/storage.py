"""Tables written to the folder that all executors share.

A query that cuts its lineage writes a Parquet table below the folder named in
``spark.checkpoint.dir``; a lost executor then costs a re-read, not a re-run.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set (as in tests), a new folder that is then set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="mentionary-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back without its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(table: DataFrame) -> None:
    """Delete a table of ``written`` from which everything has been made that will be; other tables are left alone."""
    path = getattr(table, "_written_to", None)
    if path:
        _delete(table.sparkSession, path)


#: Bytes of a table for each core under which it is small: moving it costs little beside work on its texts.
SMALL = 16 << 20


def scanned(df: DataFrame) -> bool:
    """Whether the rows come straight from files: columns and conditions on one scan, nothing that shuffles."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter") and node.children().length() == 1:
        node = node.children().head()
    return not df.isStreaming and node.nodeName().startswith(("LogicalRelation", "Relation")) and node.children().isEmpty()


def spread(df: DataFrame) -> DataFrame:
    """``df``, over all cores where a small table's files are fewer than these.

    Work on texts costs far more than moving them; a table in one small file would leave
    all but one core idle. A table of more than ``SMALL`` bytes a core is never shuffled
    for this, and what doesn't come straight from files is left as it is.
    """
    if not scanned(df):
        return df  # its partitions aren't those of files, and to count them would be to run it
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df if size > SMALL * cores or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def clear(spark: SparkSession) -> None:
    """Delete what this application wrote; call it when no result is needed any more."""
    _delete(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
