"""Analyses and accounts in append-only Parquet tables.

There is no table format with row updates here, so an update is a new version of
a row and a read takes the latest version of each key; deletes and upserts are
joins whose result replaces the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import expires_at


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest(versions: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key: a grouped maximum, combined before the shuffle."""
    rest = [c for c in versions.columns if c != key]
    out = versions.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), version).alias("_row"))
    return out.select(*[F.col(f"`{c}`") if c == key else F.col(f"_row.`{c}`") for c in versions.columns])


def upsert_users(users: DataFrame, updates: DataFrame, new_id: Column) -> DataFrame:
    """Updates name and picture by email; unknown emails become users with ``new_id``.

    Of several updates of one email the last by ``created_at`` counts, of equal
    times the largest name and picture; updates without an email are left out. A
    new user's ``created_at`` is that of its first update.
    """
    last = F.max_by(F.struct("name", "picture"), F.struct("created_at", F.coalesce("name", F.lit("")), F.coalesce("picture", F.lit(""))))
    once = updates.where("email is not null").groupBy("email").agg(last.alias("last"), F.min("created_at").alias("created_at"))
    u, n = users.alias("u"), once.alias("n")
    joined = u.join(n, F.col("u.email") == F.col("n.email"), "full_outer")
    matched = F.col("n.email").isNotNull()
    return joined.select(
        F.when(F.col("u.user_id").isNull() & F.col("u.email").isNull(), new_id).otherwise(F.col("u.user_id")).alias("user_id"),
        F.coalesce("u.email", "n.email").alias("email"),
        F.when(matched, F.col("n.last.name")).otherwise(F.col("u.name")).alias("name"),
        F.when(matched, F.col("n.last.picture")).otherwise(F.col("u.picture")).alias("picture"),
        F.coalesce("u.created_at", "n.created_at").alias("created_at"),
    )


def open_session(users: DataFrame, token: Column, now: Column | None = None) -> DataFrame:
    """One session per user, seven days long, as it is stored."""
    now = F.current_timestamp() if now is None else now
    return users.select("user_id", token.alias("session_token"), expires_at(now).alias("expires_at"), now.alias("created_at"))


def delete(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without those whose ``on`` is in ``keys``."""
    return rows.join(keys, on, "left_anti")


def delete_owned(analyses: DataFrame, analysis_id: str, user_id: str) -> DataFrame:
    """Without one analysis of one owner; ``LookupError`` if there is none."""
    gone = (F.col("analysis_id") == analysis_id) & (F.col("user_id") == user_id)
    if analyses.where(gone).limit(1).count() == 0:
        raise LookupError("Analysis not found")
    return analyses.where(~F.coalesce(gone, F.lit(False)))


def as_json(analysis: DataFrame) -> DataFrame:
    """One indented JSON text per row, for ``write.text``; null fields are kept."""
    return analysis.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
