"""An optional secret scanner for code files: our own rules, an extension.

Its findings have no line number, one per (file, rule) with a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind, pattern, severity.
SECRET_RULES = (
    ("AWS access key", r"AKIA[0-9A-Z]{16}", "critical"),
    ("Payment provider key", r"sk_live_[0-9a-zA-Z]{24}", "critical"),
    ("Private key block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "critical"),
    ("Bearer token", r"(?i)bearer\s+[a-z0-9._~+/-]{20,}", "high"),
)


def secret_findings(content: Column) -> Column:
    """Issue structs of one text, one for each rule with a match."""
    one = lambda kind, pattern, severity: F.when(
        content.rlike(pattern),
        F.struct(
            F.lit(severity).alias("severity"),
            F.lit(kind).alias("type"),
            F.lit(f"Possible {kind}").alias("description"),
            F.lit(None).cast("long").alias("line_number"),
            F.lit("Revoke the credential and load it from the environment").alias("recommendation"),
        ),
    )
    return F.array_compact(F.array(*[one(*r) for r in SECRET_RULES]))


def scan_secrets(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    rest = [F.col(f"`{c}`") for c in files.columns if c != content]
    return files.select(*rest, F.col(path).alias("file_path"), F.inline(secret_findings(F.col(content)))).select(
        *rest, "severity", "type", "description", "file_path", "line_number", "recommendation"
    )
