"""Arrow batches of bounded bytes for Python stages."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a batch, about: rows hold whole texts, so a bound on rows alone doesn't bound memory.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def _release() -> None:
    """Give memory that a task no longer needs back to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it


def _number(size: str) -> int:
    digits = size.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(digits[-1:], 0)
    return int(digits.rstrip("kmg")) << unit


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most about ``BATCH_BYTES``, whatever the length of rows.

    The session's bound on the bytes of Arrow batches is lowered to that, and stays lowered, as
    the plan runs later; a lower bound is left alone.
    """
    conf = df.sparkSession.conf
    if not 0 < _number(conf.get(_LIMIT)) <= BATCH_BYTES:
        conf.set(_LIMIT, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _release()

    return df.mapInArrow(run, schema)
