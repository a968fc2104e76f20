"""The analysis plan: files to findings, risks, metrics and one stored document per analysis.

Everything that reads a file's text runs in one projection, ``scan_files``, whose
result is a stored table without texts; findings, risks and totals are read from
that table. All findings and risks are rows of child tables; a document holds
their counts and, as it is one row, the first ``HEAD`` of each.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dependencies import as_findings, first_advisories, packages_of
from ..operators.findings import FIELDS, union_findings
from ..operators.risk import bug_risk
from ..operators.rollup import roll_up
from ..operators.rules import rule_findings
from ..operators.secrets import secret_findings
from ..schemas import ADVISORIES, ANALYSES
from ..sources.code import is_manifest
from ..sources.scratch import materialize
from .enrichment import DISABLED
from .lifecycle import NO_FILES, open_analyses

#: Findings, and risks, that a document itself holds; the child tables hold all.
HEAD = 1000


class Analysis(NamedTuple):
    documents: DataFrame
    issues: DataFrame
    risks: DataFrame


def scan_files(files: DataFrame, secrets: bool = False) -> DataFrame:
    """One row per file: ``analysis_id, seq, file_path, language, lines``, its risk, findings and packages.

    The only step that reads texts: one scan, one evaluation of syntax trees.
    """
    scored = bug_risk(files.select("analysis_id", "seq", F.col("path").alias("file_path"), "content", "language", "lines"))
    content, found = F.col("content"), [rule_findings(F.col("content")).alias("rules")]
    if secrets:
        found.append(secret_findings(content).alias("secrets"))
    packages = F.when(is_manifest(F.col("file_path")), packages_of(content))
    return scored.select(
        "analysis_id", "seq", "file_path", "language", "lines", "risk_score", "complexity", "issues", *found, packages.alias("packages")
    )


def _stream(scanned: DataFrame, column: str) -> DataFrame:
    return scanned.select("analysis_id", "seq", "file_path", F.inline(column)).select("analysis_id", "seq", *FIELDS)


def issues_of(scanned: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """All findings of scanned files: secrets, then dependencies, then rules; every one is kept."""
    spark, rules = scanned.sparkSession, _stream(scanned, "rules")
    secrets = _stream(scanned, "secrets") if "secrets" in scanned.columns else rules.where("false")
    known = first_advisories(spark.createDataFrame([], ADVISORIES) if advisories is None else advisories)
    packages = scanned.select("analysis_id", "seq", "file_path", F.inline("packages"))
    found = as_findings(packages.join(known, ["name", "version"]), ["analysis_id", "seq"], "file_path")
    return union_findings(secrets, found, rules)


def risks_of(scanned: DataFrame) -> DataFrame:
    """Risks of the files with any."""
    return scanned.where("risk_score > 0").select("analysis_id", "seq", "file_path", "risk_score", "complexity", "issues")


def find_issues(files: DataFrame, advisories: DataFrame | None = None, secrets: bool = False) -> DataFrame:
    return issues_of(scan_files(files, secrets), advisories)


def find_risks(files: DataFrame) -> DataFrame:
    return risks_of(scan_files(files))


def _head(rows: DataFrame, order: list[Column], fields: tuple[str, ...], out: str) -> DataFrame:
    """The first rows of each analysis as an array, and their number in all.

    The rank is limited before rows are exchanged, so no group is gathered whole.
    """
    place = F.row_number().over(Window.partitionBy("analysis_id").orderBy(*order))
    top = rows.select("analysis_id", place.alias("_k"), F.struct(*fields).alias("_row")).where(F.col("_k") <= HEAD)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_row"))), lambda x: x["_row"])
    counts = rows.groupBy("analysis_id").agg(F.count("*").alias(f"n_{out}"))
    return top.groupBy("analysis_id").agg(listed.alias(f"first_{out}")).join(counts, "analysis_id")


def analysis_tables(
    files: DataFrame, requests: DataFrame, advisories: DataFrame | None = None, secrets: bool = False,
    fail_empty: bool = False, provider: Callable[[DataFrame], DataFrame] | None = None,
) -> Analysis:
    """Finished analyses with their child tables; one document per request.

    ``requests`` has ``analysis_id, seq, user_id, name, source_type, source_url,
    created_at``. A request without files completes with a score of 100, or with
    ``fail_empty`` fails, as archives do. ``provider`` maps the documents to
    enriched ones (see ``enrichment.attach``); without one enrichment is disabled.
    """
    scanned = materialize(scan_files(files, secrets), "scanned")
    issues, risks = issues_of(scanned, advisories), risks_of(scanned)
    rolled = roll_up(scanned, issues, risks)
    in_order = [F.col("seq"), F.col("source_rank"), F.coalesce("line_number", F.lit(0)), F.col("type"), F.col("description")]
    listed = _head(issues, in_order, FIELDS, "issues")
    at_risk = _head(risks, [F.col("seq"), F.col("file_path")], ("file_path", "risk_score", "complexity", "issues"), "risks")
    out = open_analyses(requests).select("analysis_id", *(c for c in ANALYSES.names[1:] if c in ("seq", "user_id", "name", "source_type", "source_url", "created_at")))
    for part in (rolled, listed, at_risk):
        out = out.join(part, "analysis_id", "left")
    none = F.struct(
        F.lit(0).cast("long").alias("total_files"), F.lit(0).cast("long").alias("total_lines"),
        F.create_map().cast("map<string,bigint>").alias("languages"),
        F.lit(0.0).alias("avg_complexity"), F.lit(100.0).alias("maintainability_index"),
    )
    failed = F.col("metrics").isNull() & F.lit(fail_empty)
    filled = {
        "status": F.when(failed, "failed").otherwise("completed"),
        "completed_at": F.when(~failed, F.current_timestamp()),
        "metrics": F.when(~failed, F.coalesce("metrics", none)),
        "security_issues": F.coalesce("first_issues", F.array()),
        "bug_risks": F.coalesce("first_risks", F.array()),
        "n_issues": F.coalesce("n_issues", F.lit(0)),
        "n_risks": F.coalesce("n_risks", F.lit(0)),
        "overall_score": F.when(~failed, F.coalesce("overall_score", F.lit(100.0))),
        "ai_summary": F.when(failed, NO_FILES).otherwise(DISABLED),
        "recommendations": F.array(),
        "ai_fixes": F.array(),
        "ai_refactors": F.array(),
    }
    out = out.select(*[filled.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in ANALYSES])
    return Analysis(provider(out) if provider else out, issues, risks)


def analyze(files: DataFrame, requests: DataFrame, *args, **options) -> DataFrame:
    """The documents of ``analysis_tables``."""
    return analysis_tables(files, requests, *args, **options).documents
