"""The rule catalog and its evaluation over lines.

Rules are data; a scan compiles them into expressions: each rule is first tried on
the whole text, and only texts with a match are taken apart into lines, whose hits
explode to a row per (line, rule). There is no rules join and no Python.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines_of, strip

#: Case-insensitive for Unicode, with Unicode classes and only \n ending a line.
FLAGS = "(?iudU)"


class Rule(NamedTuple):
    rule_id: str
    pattern: str
    type: str
    severity: str
    recommendation: str


# The detector rules, in order.
RULES = (
    Rule("R1", r"eval\s*\(", "Dangerous eval() usage", "critical", "Avoid using eval() as it can execute arbitrary code"),
    Rule("R2", r"exec\s*\(", "Dangerous exec() usage", "critical", "Avoid using exec() as it can execute arbitrary code"),
    Rule("R3", r"""password\s*=\s*['"][^'"]+['"]""", "Hardcoded password", "critical", "Use environment variables for sensitive data"),
    Rule("R4", r"""api[_-]?key\s*=\s*['"][^'"]+['"]""", "Hardcoded API key", "critical", "Use environment variables for API keys"),
    Rule("R5", r"""secret\s*=\s*['"][^'"]+['"]""", "Hardcoded secret", "high", "Use environment variables for secrets"),
    Rule("R6", r"TODO|FIXME|HACK|XXX", "Code annotation found", "low", "Address TODO/FIXME comments"),
    Rule("R7", r"console\.log\(", "Console logging in production", "low", "Remove debug logging in production"),
    Rule("R8", r"debugger", "Debugger statement", "medium", "Remove debugger statements"),
    Rule("R9", r"pickle\.load", "Unsafe pickle usage", "high", "Pickle can execute arbitrary code, use JSON instead"),
    Rule("R10", r"subprocess\.call\(.*shell\s*=\s*True", "Shell injection risk", "critical", "Avoid shell=True in subprocess"),
    Rule("R11", r"os\.system\(", "OS command execution", "high", "Use subprocess with proper input validation"),
    Rule("R12", r"sql\s*=.*\+.*\+", "Potential SQL injection", "critical", "Use parameterized queries"),
    Rule("R13", r"innerHTML\s*=", "XSS vulnerability", "high", "Use textContent or sanitize HTML"),
)
SEVERITIES = ("critical", "high", "medium", "low")


def explode_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line: ``line_number`` from 1, ``line``; the content column goes."""
    rest = [F.col(f"`{c}`") for c in files.columns if c != content]
    return files.select(*rest, F.posexplode(lines_of(F.col(content))).alias("_at", "line")).select(
        *rest, (F.col("_at") + 1).cast("long").alias("line_number"), "line"
    )


def hits(line: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules that a line matches anywhere, in catalog order, as structs."""
    one = lambda r: F.when(
        line.rlike(FLAGS + r.pattern),
        F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"),
            F.lit(r.type).alias("type"), F.lit(r.recommendation).alias("recommendation"),
        ),
    )
    return F.array_compact(F.array(*[one(r) for r in rules]))


def may_fire(content: Column, rule: Rule) -> Column:
    """False only for texts without a matching line.

    The rule is searched in the whole text at once, where white space may cross
    lines: a match within a line is a match there too. Patterns that look around
    or anchor to the whole text are not searched in advance.
    """
    if any(x in rule.pattern for x in (r"\A", r"\Z", r"\z", r"\G", "(?")):
        return F.lit(True)
    return content.rlike("(?m)" + FLAGS + rule.pattern)


def rule_findings(content: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Issue structs of one text, by line and then in catalog order.

    Lines are looked at only in texts that some rule matches, and there by the
    rules that do.
    """

    def of_line(line: Column, at: Column) -> Column:
        one = lambda r: F.when(
            line.rlike(FLAGS + r.pattern),
            F.struct(
                F.lit(r.rule_id).alias("rule_id"),
                F.lit(r.severity).alias("severity"),
                F.lit(r.type).alias("type"),
                F.concat(F.lit("Found: "), F.substring(strip(line), 1, 100)).alias("description"),
                (at + 1).cast("long").alias("line_number"),
                F.lit(r.recommendation).alias("recommendation"),
            ),
        )
        return F.array_compact(F.array(*[one(r) for r in rules]))

    found = F.flatten(F.transform(lines_of(content), of_line))
    any_rule = reduce(Column.__or__, [may_fire(content, r) for r in rules])
    return F.when(any_rule, found)


def scan_rules(files: DataFrame, rules: tuple[Rule, ...] = RULES, content: str = "content", path: str = "path") -> DataFrame:
    """Findings of ``files``: its columns without the content, and the issue's fields.

    Every rule runs on every file, whatever the language. The plan is a scan,
    projections and one generator.
    """
    rest = [F.col(f"`{c}`") for c in files.columns if c != content]
    found = files.select(*rest, F.col(path).alias("file_path"), F.inline(rule_findings(F.col(content), rules)))
    return found.select(*rest, "rule_id", "severity", "type", "description", "file_path", "line_number", "recommendation")
