"""Lines through an external program, partition by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame


def pipe(lines: DataFrame, command: str, check: bool = True) -> DataFrame:
    """(line): what ``command`` writes for the lines of each partition of the one string column; with ``check`` a failing program fails the job.

    The program must be on every executor. No built-in operator runs one, so this is the
    one place that goes through an RDD.
    """
    out = lines.rdd.map(lambda r: "" if r[0] is None else r[0]).pipe(command, checkCode=check)
    return lines.sparkSession.createDataFrame(out.map(lambda x: (x,)), "line string")
