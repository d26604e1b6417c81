"""The shared folder's tables, and passes over texts in batches that fit a worker's memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import clear, discard, scanned, shared_folder, spread, written

__all__ = ["clear", "discard", "first_by_hash", "scanned", "shared_folder", "text_pass", "written"]

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _release() -> None:
    """Give freed memory back to the system; a worker that waits for its next task would keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc alone has it
        trim(0)


def text_pass(df: DataFrame, run: Callable, schema, rows: int = 1000, whole: bool = False) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of ``rows`` rows, by workers that keep no memory after a task, on all cores.

    Spark's default of 10,000 rows is meant for numbers; that many documents, with the
    copies that a pass makes, would take hundreds of megabytes of each Python worker.
    Where the session has the default it is lowered; another setting is left as it is.
    ``whole`` keeps the partitions, and with them the order of the rows, as they are.
    """
    if df.sparkSession.conf.get(_ROWS) == "10000":
        df.sparkSession.conf.set(_ROWS, str(rows))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return (df if whole else spread(df)).mapInArrow(task, schema)


def first_by_hash(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most ``n`` rows, the first by a hash of the id: the same ones however the table is laid out.

    Rows whose hash is well beyond the n-th are filtered out before the sort, so that the
    tasks together send the driver about ``n`` rows and not ``n`` each.
    """
    h = F.pmod(F.xxhash64(id_col), F.lit(1 << 31))
    total = df.count()
    if total > 2 * n:
        df = df.where(h < int((1 << 31) * min(1.0, 1.1 * n / total + 1e-6)))
    return df.orderBy(h, id_col).limit(n)
