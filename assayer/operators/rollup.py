"""Findings and risks rolled up to metrics and a score per analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def language_map(files: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Lines by language as a map per analysis: grouped twice, so the second group is a few rows."""
    sums = files.groupBy(key, "language").agg(F.sum("lines").alias("lines"))
    entries = F.sort_array(F.collect_list(F.struct("language", "lines")))
    return sums.groupBy(key).agg(F.map_from_entries(entries).alias("languages"))


def merge_language_maps(analyses: DataFrame, column: str = "languages") -> DataFrame:
    """``language, lines`` summed over the maps of all rows."""
    return analyses.select(F.explode(column).alias("language", "lines")).groupBy("language").agg(F.sum("lines").alias("lines"))


def roll_up(files: DataFrame, issues: DataFrame, risks: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Per analysis: ``metrics`` and ``overall_score``.

    Ten points go for each critical or high issue and half the mean risk of the
    files at risk; files without risk do not count in that mean. Analyses without
    files have no row. Rounding is half to even.
    """
    totals = files.groupBy(key).agg(F.count("*").alias("total_files"), F.sum("lines").alias("total_lines"))
    penalty = issues.groupBy(key).agg((10 * F.count_if(F.col("severity").isin("critical", "high"))).alias("penalty"))
    risk = risks.where("risk_score > 0").groupBy(key).agg(F.avg("risk_score").alias("risk"))
    out = totals.join(language_map(files, key), key, "left").join(penalty, key, "left").join(risk, key, "left")
    out = out.fillna(0, ["penalty"]).fillna(0.0, ["risk"])
    return out.select(
        key,
        F.struct(
            "total_files",
            "total_lines",
            "languages",
            F.bround("risk", 2).alias("avg_complexity"),
            F.bround(100 - F.col("risk"), 2).alias("maintainability_index"),
        ).alias("metrics"),
        F.bround(F.greatest(F.lit(0.0), 100 - F.col("penalty") - F.col("risk") / 2), 2).alias("overall_score"),
    )
