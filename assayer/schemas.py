"""Schemas of the analysis data model."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


USERS = _struct(user_id=S, email=S, name=S, picture=S, created_at=TS)
USER_SESSIONS = _struct(user_id=S, session_token=S, expires_at=TS, created_at=TS)
CODE_FILES = _struct(analysis_id=S, seq=L, path=S, content=S, language=S, lines=L)
ISSUE = _struct(severity=S, type=S, description=S, file_path=S, line_number=L, recommendation=S)
RISK = _struct(file_path=S, risk_score=D, complexity=S, issues=T.ArrayType(S))
SECURITY_ISSUES = T.StructType([*_struct(analysis_id=S, seq=L, source_rank=T.IntegerType()), *ISSUE])
BUG_RISKS = T.StructType([*_struct(analysis_id=S, seq=L), *RISK])
METRICS = _struct(total_files=L, total_lines=L, languages=T.MapType(S, L), avg_complexity=D, maintainability_index=D)
ADVISORIES = _struct(name=S, ecosystem=S, version=S, seq=L, id=S, aliases=T.ArrayType(S))
AI_FIXES = _struct(analysis_id=S, pos=T.IntegerType(), file_path=S, issue_type=S, type=S, explanation=S, fix_code=S)
AI_REFACTORS = _struct(analysis_id=S, pos=T.IntegerType(), file_path=S, explanation=S, refined_code=S)
FIX = _struct(file_path=S, issue_type=S, type=S, explanation=S, fix_code=S)
REFACTOR = _struct(file_path=S, explanation=S, refined_code=S)
ANALYSES = _struct(
    analysis_id=S, seq=L, user_id=S, name=S, source_type=S, source_url=S, status=S, created_at=TS, completed_at=TS,
    metrics=METRICS, security_issues=T.ArrayType(ISSUE), bug_risks=T.ArrayType(RISK), n_issues=L, n_risks=L, overall_score=D, ai_summary=S,
    recommendations=T.ArrayType(S),
    ai_fixes=T.ArrayType(FIX), ai_refactors=T.ArrayType(REFACTOR),
)
#: What enrichment by a language model replies with.
REPLY = _struct(summary=S, recommendations=T.ArrayType(S), fixes=T.ArrayType(FIX), refactors=T.ArrayType(REFACTOR))
