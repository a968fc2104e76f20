"""The bag union of finding streams, in a stated order and without dedupe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("severity", "type", "description", "file_path", "line_number", "recommendation")


def union_findings(*streams: DataFrame, keys: tuple[str, ...] = ("analysis_id", "seq")) -> DataFrame:
    """``keys``, ``source_rank`` (the stream's place) and the issue's fields; every row stays."""
    parts = [s.select(*keys, F.lit(k).alias("source_rank"), *FIELDS) for k, s in enumerate(streams)]
    return reduce(DataFrame.unionByName, parts)
