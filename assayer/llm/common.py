"""Shared pieces of the training-data operators: bounded batches and chunks, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialize, scratch_dir

__all__ = ["bound_batches", "chunks", "discard", "fresh", "materialize", "per_process", "scratch_dir", "semi_by_id", "table"]
#: A word is a maximal run of characters outside ASCII white space.
WORD_SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 19


def bound_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker is sent at once by bytes, for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes not to be a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def semi_by_id(df: DataFrame, ids: DataFrame, on: str, limit: int = 400_000) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in the distinct ``ids``.

    ``ids`` is counted: up to ``limit`` numbers (a few MB) are broadcast, which
    spares ``df`` a shuffle; more of them are joined by a shuffle.
    """
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids, on, "left_semi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_process(key: tuple, make: Callable[[], Any]) -> Any:
    """``make()``, kept for later tasks of the same Python worker, one value at a time."""
    kept = sys.modules.setdefault("_assayer_worker", types.ModuleType("_assayer_worker"))
    if getattr(kept, "key", None) != key:
        forget()
        kept.key, kept.value = key, make()
    return kept.value


def forget() -> None:
    """Frees what ``per_process`` keeps: workers outlive an operator and would hold on to it."""
    kept = sys.modules.get("_assayer_worker")
    if kept is not None and hasattr(kept, "value"):
        del kept.key, kept.value
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library can
            ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


def chunks(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within bytes) of whole texts; null is empty."""
    forget()
    text = pc.fill_null(column, "")
    text = (pc.utf8_lower(text) if lower else text).cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
