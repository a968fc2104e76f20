"""Counts from Python syntax trees: the one scalar that needs Python."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "functions long, classes long, max_nesting long, complexity string"


def counts(source: str | None) -> tuple[int, int, int, str]:
    """(functions, classes, nesting, level); zeros and ``unknown`` for what does not parse.

    Functions are plain ``def`` nodes at any depth; async ones do not count. The
    nesting is 0 by definition of the reported metric.
    """
    if source is None:
        return 0, 0, 0, "unknown"
    try:
        kinds = [type(node) for node in ast.walk(ast.parse(source))]
    except Exception:  # noqa: BLE001 - any failure to parse has the same meaning
        return 0, 0, 0, "unknown"
    n = kinds.count(ast.FunctionDef)
    level = "low" if n <= 10 else "medium" if n <= 20 else "high"
    return n, kinds.count(ast.ClassDef), 0, level


def python_counts(content: Column) -> Column:
    """``counts`` as an Arrow-batched function; pass null for rows that are not Python."""

    @F.pandas_udf(SCHEMA)
    def run(source: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(s) for s in source], columns=["functions", "classes", "max_nesting", "complexity"])

    return run(content)
