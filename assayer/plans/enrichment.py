"""Enrichment by a language model: what it is given, and how its replies are attached.

No provider is part of this package. ``prompts`` makes one JSON text per analysis,
a provider answers them however it likes, and ``attach`` reads the answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import context_files, risks_in_context
from ..schemas import REPLY

# Summaries where there is no reply.
DISABLED, REFUSED, UNREADABLE = "AI key not configured", "AI generation failed.", "AI analysis error."
BY = ("analysis_id",)


def context_text(files: DataFrame, issues: DataFrame, risks: DataFrame) -> DataFrame:
    """``analysis_id, context``: the files of ``context_files``, three at most, in file order."""
    picked = context_files(files, issues, risks, by=BY)
    block = F.concat(F.lit("File: "), "path", F.lit("\nContent:\n"), "content")
    ordered = F.array_sort(F.collect_list(F.struct("seq", block.alias("block"))))
    return picked.groupBy(*BY).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n").alias("context"))


def prompts(documents: DataFrame, files: DataFrame, issues: DataFrame, risks: DataFrame) -> DataFrame:
    """``analysis_id, prompt``: JSON with the code context, the document's issues and the top risks.

    ``issues`` and ``risks`` are child tables, ``risks`` with the path as ``path``.
    """
    top = risks_in_context(risks, by=BY)
    risk = F.struct("seq", F.struct(F.col("path").alias("file_path"), "risk_score", "complexity", "issues").alias("risk"))
    top = top.groupBy(*BY).agg(F.transform(F.array_sort(F.collect_list(risk)), lambda x: x["risk"]).alias("complexity_risks"))
    out = documents.select(*BY, "security_issues").join(context_text(files, issues, risks), [*BY], "left").join(top, [*BY], "left")
    body = F.struct(
        F.coalesce("context", F.lit("")).alias("code_context"), "security_issues",
        F.coalesce("complexity_risks", F.array().cast(top.schema["complexity_risks"].dataType)).alias("complexity_risks"),
    )
    return out.select(*BY, F.to_json(body, {"ignoreNullFields": "false"}).alias("prompt"))


def attach(documents: DataFrame, replies: DataFrame) -> DataFrame:
    """Documents with the replies ``analysis_id, status, body``.

    A status other than 200 and a body that is no JSON object have summaries of
    their own and empty lists; documents without a reply stay as they are.
    """
    reply = F.from_json("body", REPLY)
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT"), F.lit(False))
    read = F.when((F.col("status") == 200) & is_object, reply)
    said = replies.select("analysis_id", F.col("status").alias("_status"), read.alias("_reply"))
    out = documents.join(said, "analysis_id", "left")
    none = F.when(F.col("_status") == 200, UNREADABLE).otherwise(REFUSED)
    fields = {"ai_summary": "summary", "recommendations": "recommendations", "ai_fixes": "fixes", "ai_refactors": "refactors"}
    answered = F.col("_status").isNotNull()
    for column, field in fields.items():
        empty = F.lit("") if field == "summary" else F.array().cast(REPLY[field].dataType)
        value = F.coalesce(F.col(f"_reply.{field}"), empty)
        value = F.when(F.col("_reply").isNull(), none).otherwise(value) if field == "summary" else value
        out = out.withColumn(column, F.when(answered, value).otherwise(F.col(column)))
    return out.select(*documents.columns)
