"""Reads over stored analyses: list, get, search, dashboard and detail views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    contains_ignoring_case, fixed, grouped, local_date, local_datetime, lookup, or_default, progress, score_band,
)
from ..operators.rollup import merge_language_maps
from ..operators.rules import SEVERITIES

LIST_ROWS, DASHBOARD_ROWS, RECENT_ROWS = 100, 100, 5
# Chart colours.
LANGUAGE_COLOURS = {"python": "#3776AB", "javascript": "#F7DF1E", "typescript": "#3178C6", "java": "#007396", "go": "#00ADD8", "rust": "#DEA584"}
OTHER_COLOUR = "#71717A"


def public(rows: DataFrame) -> DataFrame:
    """Without the identifier that a store may add to each document."""
    return rows.drop("_id")


def list_analyses(analyses: DataFrame, user_id: str, limit: int = LIST_ROWS) -> DataFrame:
    """A user's analyses, newest first; equal times by descending ``seq``."""
    return public(analyses).where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), F.desc("seq")).limit(limit)


def get_analysis(analyses: DataFrame, analysis_id: str, user_id: str) -> DataFrame:
    """One analysis of its owner; no row if there is none."""
    return public(analyses).where((F.col("analysis_id") == analysis_id) & (F.col("user_id") == user_id)).limit(1)


def search(analyses: DataFrame, query: str) -> DataFrame:
    """Rows whose name or source address contains the query, in any case."""
    return analyses.where(contains_ignoring_case(F.col("name"), query) | contains_ignoring_case(F.col("source_url"), query))


def completed(analyses: DataFrame, user_id: str, limit: int = DASHBOARD_ROWS) -> DataFrame:
    """The rows a dashboard covers: the first completed ones in stored order (``seq``)."""
    mine = public(analyses).where((F.col("user_id") == user_id) & (F.col("status") == "completed"))
    return mine.orderBy("seq").limit(limit)


def dashboard(analyses: DataFrame, user_id: str) -> DataFrame:
    """One row: totals over the covered rows; zeros and an empty map where there are none."""
    rows = completed(analyses, user_id)
    totals = rows.agg(
        F.count("*").alias("total_analyses"),
        F.coalesce(F.bround(F.avg(F.coalesce("overall_score", F.lit(0.0))), 2), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.sum("n_issues"), F.lit(0)).cast("long").alias("total_issues"),
    )
    maps = merge_language_maps(rows.select("metrics.languages")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "lines")))).alias("languages")
    )
    return totals.join(F.broadcast(maps))  # one row by one row


def recent(analyses: DataFrame, user_id: str) -> DataFrame:
    return completed(analyses, user_id, RECENT_ROWS)


def recent_severities(analyses: DataFrame, user_id: str) -> DataFrame:
    """``severity, n`` over the issues that the recent documents hold."""
    return severity_histogram(recent(analyses, user_id).select(F.explode("security_issues.severity").alias("severity")))


def recent_risks(analyses: DataFrame, user_id: str) -> DataFrame:
    """One number: the risks of the recent documents."""
    return recent(analyses, user_id).agg(F.coalesce(F.sum("n_risks"), F.lit(0)).alias("n_risks"))


def cards(analyses: DataFrame) -> DataFrame:
    """What the cards of one analysis show: counts, and the metrics as text."""
    m = lambda name: F.col(f"metrics.{name}")
    text = lambda value: F.coalesce(value, F.lit("0"))
    return analyses.select(
        "analysis_id",
        F.coalesce("n_issues", F.lit(0)).cast("long").alias("n_issues"),
        F.coalesce("n_risks", F.lit(0)).cast("long").alias("n_risks"),
        fixed(F.col("overall_score"), 0).alias("score"),
        score_band(F.col("overall_score")).alias("band"),
        text(grouped(m("total_lines"))).alias("lines"),
        text(fixed(m("avg_complexity"), 1)).alias("complexity"),
        progress(m("avg_complexity")).alias("complexity_bar"),
        F.concat(text(fixed(m("maintainability_index"), 0)), F.lit("%")).alias("maintainability"),
        local_date(F.col("created_at")).alias("date"),
        local_datetime(F.col("created_at")).alias("time"),
    )


def detail_issues(analyses: DataFrame) -> DataFrame:
    """``analysis_id, pos``, each issue of a document and the first fix that names its file and type.

    Fixes are an array of the same row, so nothing is joined or exchanged.
    """
    rows = analyses.select("analysis_id", "ai_fixes", F.posexplode("security_issues").alias("pos", "issue"))
    names = lambda x: (x["issue_type"] == F.col("issue.type")) | (x["type"] == F.col("issue.type"))
    fits = F.filter("ai_fixes", lambda x: (x["file_path"] == F.col("issue.file_path")) & names(x))
    fix = F.get(fits, F.lit(0))
    return rows.select("analysis_id", "pos", "issue.*", fix["explanation"].alias("fix"), fix["fix_code"].alias("fix_code"))


def detail_risks(analyses: DataFrame) -> DataFrame:
    """``analysis_id, place``, each risk of a document, highest first, and the first refactor of its path.

    Equal risks stay in their order. A refactor belongs to a path that contains its
    own, or is contained in it.
    """
    keyed = F.transform("bug_risks", lambda r, i: F.struct((-r["risk_score"]).alias("order"), i.alias("at"), r.alias("risk")))
    rows = analyses.select("analysis_id", "ai_refactors", F.posexplode(F.array_sort(keyed)).alias("place", "r"))
    path = F.col("r.risk.file_path")
    fits = F.filter("ai_refactors", lambda x: F.contains(path, x["file_path"]) | F.contains(x["file_path"], path))
    refactor = F.get(fits, F.lit(0))
    score = F.concat(fixed(F.col("r.risk.risk_score"), 0), F.lit("%"))
    return rows.select(
        "analysis_id", "place", "r.risk.*", score.alias("score"), refactor["explanation"].alias("note"), refactor["refined_code"].alias("refined_code")
    )


def severity_histogram(severities: DataFrame, column: str = "severity", domain: tuple[str, ...] = SEVERITIES) -> DataFrame:
    """Counts by severity; the domain's are there with 0, others come as they are."""
    spark = severities.sparkSession
    seed = spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in domain])).alias("severity"))
    found = severities.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("severity")).agg(F.count("*").alias("n"))
    return found.join(seed, "severity", "full_outer").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def severity_counts(column: Column) -> list[Column]:
    """Four conditional counts, one per severity."""
    return [F.count_if(column == s).alias(s) for s in SEVERITIES]


def severity_rows(counts: DataFrame) -> DataFrame:
    """Four fixed rows from the four count columns."""
    pairs = ", ".join(f"'{s.capitalize()}', {s}" for s in SEVERITIES)
    return counts.selectExpr(f"stack(4, {pairs}) as (name, value)")


def language_rows(languages: DataFrame, upper: bool = True) -> DataFrame:
    """``name, value, colour`` of a language map."""
    rows = languages.select(F.explode("languages").alias("name", "value"))
    colour = lookup(F.col("name"), LANGUAGE_COLOURS, OTHER_COLOUR)
    return rows.select((F.upper("name") if upper else F.col("name")).alias("name"), "value", colour.alias("colour"))


def report_rows(issues: DataFrame) -> DataFrame:
    """The issue table of a report, with defaults for null and empty fields."""
    return issues.select(
        F.upper(or_default(F.col("severity"), "LOW")).alias("severity"),
        or_default(F.col("type"), "General Issue").alias("type"),
        or_default(F.col("file_path"), "Unknown").alias("file_path"),
        F.coalesce(F.nullif(F.col("line_number").cast("string"), F.lit("0")), F.lit("-")).alias("line_number"),
    )


def report_code(refactors: DataFrame, lines: int = 40) -> DataFrame:
    """The first lines of each refactor."""
    return refactors.withColumn("refined_code", F.array_join(F.slice(F.split("refined_code", "\n"), 1, lines), "\n"))


def user_view(users: DataFrame) -> DataFrame:
    return users.select("user_id", "email", "name", "picture")
