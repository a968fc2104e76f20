"""Per-file bug risk: additive signals, a level, and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ast_counts import python_counts
from ..functions.text import lines_of

# Thresholds, points and messages of the signals, and the pattern of blocks that swallow an error.
LARGE, MODERATE = (500, 20, "File is too large (>500 lines)"), (200, 10, "File is moderately large (>200 lines)")
COMPLEX, MEDIUM = ("high", 30, "High cyclomatic complexity"), ("medium", 15)
CROWDED = (15, 10, "Too many functions in one file")
WIDE_LINES = (10, 10, " lines exceed 120 characters")
WIDTH = 120
NOTES = (5, 15, " TODO/FIXME comments found")
NOTE_WORDS = ("TODO", "FIXME")
HANDLERS = (0, 20, " empty exception handlers")
HIGH_RISK, MEDIUM_RISK, MOST = 50, 25, 100
EMPTY_HANDLER = r"(?U)except\s*:\s*pass|catch\s*\([^)]*\)\s*\{\s*\}"


def _signal(cases: list[tuple[Column, int, Column | None]]) -> tuple[Column, Column]:
    """(points, message) of the first case that holds."""
    points, message = F.lit(0), F.lit(None).cast("string")
    for condition, n, text in reversed(cases):
        points = F.when(condition, n).otherwise(points)
        message = F.when(condition, F.lit(None).cast("string") if text is None else text).otherwise(message)
    return points, message


def bug_risk(files: DataFrame, content: str = "content", language: str = "language", parse_python: bool = True) -> DataFrame:
    """Adds ``risk_score`` (0 to 100), ``complexity`` and ``issues``.

    The level comes from the score before it is capped. With ``parse_python`` false,
    or for other languages, the syntax-tree signals are silent and the plan stays
    on the JVM.
    """
    long_lines = F.size(F.filter("_lines", lambda x: F.length(x) > WIDTH))
    todos = F.size(F.filter("_lines", lambda x: F.contains(x, F.lit(NOTE_WORDS[0])) | F.contains(x, F.lit(NOTE_WORDS[1]))))
    out = files.withColumn("_lines", lines_of(F.col(content)))
    out = out.select(
        "*",
        F.size("_lines").alias("_n"),
        long_lines.alias("_long"),
        todos.alias("_todo"),
        F.regexp_count(F.col(content), F.lit(EMPTY_HANDLER)).alias("_empty"),
    ).drop("_lines")
    if parse_python:
        out = out.withColumn("_tree", python_counts(F.when(F.col(language) == "python", F.col(content))))
        level, functions = F.col("_tree.complexity"), F.col("_tree.functions")
    else:
        level, functions = F.lit("unknown"), F.lit(0)
    n, wide, todo, empty = (F.col(c) for c in ("_n", "_long", "_todo", "_empty"))
    counted = lambda c, rule: (c > rule[0], rule[1], F.concat(c.cast("string"), F.lit(rule[2])))
    signals = [
        _signal([(n > limit, points, F.lit(text)) for limit, points, text in (LARGE, MODERATE)]),
        _signal([(level == COMPLEX[0], COMPLEX[1], F.lit(COMPLEX[2])), (level == MEDIUM[0], MEDIUM[1], None)]),
        _signal([(functions > CROWDED[0], CROWDED[1], F.lit(CROWDED[2]))]),
        _signal([counted(wide, WIDE_LINES)]),
        _signal([counted(todo, NOTES)]),
        _signal([counted(empty, HANDLERS)]),
    ]
    score = sum((p for p, _ in signals), F.lit(0))
    out = out.withColumn("_score", score).withColumn("issues", F.array_compact(F.array(*[m for _, m in signals])))
    return out.select(
        *[F.col(f"`{c}`") for c in files.columns],
        F.least(F.col("_score"), F.lit(MOST)).cast("double").alias("risk_score"),
        F.when(F.col("_score") > HIGH_RISK, "high").when(F.col("_score") > MEDIUM_RISK, "medium").otherwise("low").alias("complexity"),
        "issues",
    )
