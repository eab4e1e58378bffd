"""Memory of Python workers and of the batches that they are sent."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

_LIBC = ctypes.CDLL(None) if sys.platform.startswith("linux") else None
_BATCH, _BATCH_DEFAULT, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20

_KEPT: dict[str, Any] = {}


def small_batches(spark: SparkSession) -> None:
    """Has Spark send texts to Python some megabytes at a time, unless the session says otherwise:
    each batch is held several times over on the way, by the executor and by the worker."""
    if spark.conf.get(_BATCH).rstrip("b") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH, str(_BATCH_BYTES))


def kept(key: str, make: Callable[[], Any]) -> Any:
    """An object that a worker keeps for its next tasks. It keeps one at a time, the last asked for,
    so that a table of one operator does not stay while others run in the same worker."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drops the kept object."""
    if _KEPT:
        _KEPT.clear()
        release()


def release() -> None:
    """Returns what the allocators hold unused to the system, where they can; a worker lives on
    after its task."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)
