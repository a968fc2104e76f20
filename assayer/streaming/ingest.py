"""Streaming scans: an extension, the batch plans cover everything else.

Code files that land in a directory of Parquet files are scanned as they come.
The rule scan is a stateless projection, so the stream keeps no state but its
source's offsets, and findings are appended once per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.rules import RULES, Rule, scan_rules
from ..schemas import CODE_FILES


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(CODE_FILES).parquet(path)


def stream_findings(files: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return scan_rules(files, rules)


def windowed_counts(findings: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings by severity and time window; events later than the watermark are left out."""
    return findings.withWatermark(time, late).groupBy(F.window(time, window), "severity").agg(F.count("*").alias("n"))


def start(findings: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now to Parquet and ends."""
    return (
        findings.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
