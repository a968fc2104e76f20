"""The life of an analysis: opened as processing, then completed or failed.

The store is append-only, so each state is a version of the document and the
last one counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ANALYSES
from ..sources.store import append, latest

# Fixed value: what an analysis of an archive without code says.
NO_FILES = "No valid code files found in ZIP archive."

OPENED, ENDED = 0, 1


def open_analyses(requests: DataFrame) -> DataFrame:
    """Documents as they are first stored: status ``processing``, empty lists, nothing else known."""
    given = {"analysis_id", "seq", "user_id", "name", "source_type", "source_url", "created_at"}
    empty = {c: F.array() for c in ("security_issues", "bug_risks", "recommendations", "ai_fixes", "ai_refactors")}
    fixed = empty | {"status": F.lit("processing"), "n_issues": F.lit(0), "n_risks": F.lit(0)}
    value = lambda f: F.col(f.name) if f.name in given else fixed.get(f.name, F.lit(None))
    return requests.select(*[value(f).cast(f.dataType).alias(f.name) for f in ANALYSES])


def fail(documents: DataFrame, message: Column | str) -> DataFrame:
    """The documents as failed; the summary says why, and nothing else changes."""
    text = F.lit(message) if isinstance(message, str) else message
    return documents.withColumns({"status": F.lit("failed"), "ai_summary": text})


def record(documents: DataFrame, version: int) -> DataFrame:
    return documents.withColumn("version", F.lit(version))


def current(versions: DataFrame) -> DataFrame:
    """The last state of each analysis."""
    return latest(versions, "analysis_id", "version").drop("version")


def run_stored(spark: SparkSession, path: str, requests: DataFrame, work: Callable[[DataFrame], DataFrame]) -> str:
    """Opens the requests in the table at ``path``, runs ``work`` on them and stores how they end.

    ``work`` maps requests to finished documents. Any error of it is stored as a
    failure of these requests, with the error's text; the final status is returned.
    """
    opened = open_analyses(requests)
    append(record(opened, OPENED), path)
    try:
        append(record(work(requests), ENDED), path)
        return "completed"
    except Exception as e:  # noqa: BLE001 - whatever goes wrong ends the analysis, not the caller
        append(record(fail(opened, str(e).splitlines()[0] if str(e) else type(e).__name__), ENDED), path)
        return "failed"


def stored(spark: SparkSession, path: str) -> DataFrame:
    return current(spark.read.parquet(path))
