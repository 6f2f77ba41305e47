"""What Python workers hold on to: Spark uses them again, for other operators too, so tasks give memory back."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of a batch between the JVM and a worker; whole texts make the session's default of 10,000 needlessly large.
ARROW_ROWS = 1000


def give_back() -> None:
    """Return free memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, which gives memory back when its task ends."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def tidy_group(run: Callable) -> Callable:
    """``run`` for ``applyInArrow`` (one group), which gives memory back after a large group."""

    @functools.wraps(run)
    def own(group: pa.Table) -> pa.Table:
        large = group.nbytes > 4 << 20
        try:
            return run(group)
        finally:
            del group
            if large:
                give_back()

    return own


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to :data:`ARROW_ROWS`, unless it is lower already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))
