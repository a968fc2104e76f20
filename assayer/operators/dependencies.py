"""Declared dependencies against an advisory snapshot.

A manifest that is not JSON, or whose sections are not maps, has no findings;
entries that cannot be used are skipped one by one and the others still count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_version, string_map


def packages_of(content: Column) -> Column:
    """``name, declared, version`` structs of ``dependencies`` and ``devDependencies``; the latter win.

    Entries whose version is not a string are skipped.
    """
    base, dev = string_map(content, "$.dependencies"), string_map(content, "$.devDependencies")
    # Keys of both sections are dropped from the first, so that no session setting decides.
    own = F.map_filter(base, lambda k, _: ~F.map_contains_key(dev, k))
    return F.transform(
        F.map_entries(F.map_concat(own, dev)),
        lambda e: F.struct(e["key"].alias("name"), e["value"].alias("declared"), clean_version(e["value"]).alias("version")),
    )


def declared(manifests: DataFrame, content: str = "content") -> DataFrame:
    """One row per package of each manifest; the content column goes."""
    rest = [F.col(f"`{c}`") for c in manifests.columns if c != content]
    return manifests.select(*rest, F.inline(packages_of(F.col(content))))


def first_advisories(advisories: DataFrame, ecosystem: str = "npm") -> DataFrame:
    """``name, version, vuln_id, n_vulns``: the first advisory of each version and the count of all."""
    first = F.min_by(F.coalesce(F.get("aliases", F.lit(0)), F.col("id")), F.struct("seq", "id"))
    known = advisories.where(F.col("ecosystem") == ecosystem)
    return known.groupBy("name", "version").agg(first.alias("vuln_id"), F.count("*").alias("n_vulns"))


def matched(manifests: DataFrame, advisories: DataFrame, content: str = "content", ecosystem: str = "npm") -> DataFrame:
    """``name, version, ..., vuln_id, n_vulns``: declared packages with their first advisory and the count of all."""
    return declared(manifests, content).join(first_advisories(advisories, ecosystem), ["name", "version"])


def as_findings(found: DataFrame, rest: list[str], path: str = "path") -> DataFrame:
    """Issue fields of matched packages, always of high severity, beside the columns ``rest``."""
    return found.select(
        *[F.col(f"`{c}`") for c in rest],
        F.lit("high").alias("severity"),
        F.format_string("Vulnerable Dependency (%s)", "vuln_id").alias("type"),
        F.format_string("Package '%s' (v%s) has %d known security issues.", "name", "version", "n_vulns").alias("description"),
        F.col(path).alias("file_path"),
        F.lit(None).cast("long").alias("line_number"),
        F.format_string("Update '%s' immediately to the latest stable version.", "name").alias("recommendation"),
    )


def vulnerable(manifests: DataFrame, advisories: DataFrame, content: str = "content", path: str = "path", ecosystem: str = "npm") -> DataFrame:
    """Findings: one per declared package and version with advisories."""
    return as_findings(matched(manifests, advisories, content, ecosystem), [c for c in manifests.columns if c != content], path)
