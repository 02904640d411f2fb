"""Memory of Python workers: small exchanges, and what a task has freed goes back to the system."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_ROWS = 1000
BATCH_BYTES = 1 << 22


def hand_back() -> None:
    """Return freed memory of Arrow and of the C library; idle workers wait for a minute and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """``run``, a generator over batches, that hands memory back when its task ends."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return wrapped


def exchange_few_rows(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """From now on the session gives Python workers at most ``rows`` rows at a time, and about ``size`` bytes: whole texts make large batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
