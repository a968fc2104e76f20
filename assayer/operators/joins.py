"""The joins that attach sessions, context, fixes and refactors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def authenticate(sessions: DataFrame, users: DataFrame, now: Column | None = None) -> DataFrame:
    """Users of sessions that have not expired; sessions without a user go."""
    now = F.current_timestamp() if now is None else now
    return sessions.where(F.col("expires_at") >= now).select("session_token", "user_id").join(users, "user_id")


def top_risks(risks: DataFrame, n: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """The n files of the highest risk, of all or of each group of ``by``; equal risks in file order."""
    order = [F.desc("risk_score"), F.col("seq")]
    if not by:
        return risks.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return risks.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def risks_in_context(risks: DataFrame, n: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """All risks whose path is that of a top one."""
    paths = top_risks(risks, n, by).select(*by, "path").distinct()
    return risks.join(paths, [*by, "path"], "left_semi").select(*risks.columns)


def context_files(
    files: DataFrame, issues: DataFrame, risks: DataFrame, n_files: int = 3, n_risks: int = 2, by_risk: bool = False, by: tuple[str, ...] = ()
) -> DataFrame:
    """The first files, in file order, that have an issue or one of the top risks.

    File order can cut a top risk; ``by_risk`` puts the top risks first instead.
    With ``by`` the cut is made in each of its groups.
    """
    top = top_risks(risks, n_risks, by).select(*by, "path", F.lit(0).alias("_rank"))
    paths = issues.select(*by, F.col("file_path").alias("path"), F.lit(1).alias("_rank")).unionByName(top)
    paths = paths.groupBy(*by, "path").agg(F.min("_rank").alias("_rank"))
    order = [F.col("_rank"), F.col("seq")] if by_risk else [F.col("seq")]
    found = files.join(paths, [*by, "path"])
    if not by:
        return found.orderBy(*order).limit(n_files).select(*files.columns)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return found.withColumn("_place", place).where(F.col("_place") <= n_files).select(*files.columns)


def first_fix(issues: DataFrame, fixes: DataFrame, key: str = "issue_id") -> DataFrame:
    """Each issue with the first fix, by ``pos``, of its file that names its type in either field.

    An equi-join on the path with the rest as a residual; issues without a fix stay.
    """
    same = (issues["file_path"] == fixes["file_path"]) & ((fixes["issue_type"] == issues["type"]) | (fixes["type"] == issues["type"]))
    matched = issues.join(fixes, same).groupBy(issues[key]).agg(
        F.min_by(F.struct(fixes["explanation"], fixes["fix_code"], fixes["pos"]), fixes["pos"]).alias("fix")
    )
    return issues.join(matched, key, "left")


def first_containing(
    needles: DataFrame, texts: DataFrame, needle_id: str, needle: str, text_id: str, text: str, words: int = 3
) -> DataFrame:
    """``text_id, needle_id`` of the smallest needle that each text contains.

    A contained needle's words, but for its first and last, are whole words of the
    text; so texts and needles meet on a hash of ``words`` such words in a row, or
    of one where a needle has fewer. Needles without inner words meet texts on
    their first three characters. Only ids and keys are exchanged for that; the
    texts are joined to the distinct candidate pairs, and containment decides.
    """
    parts = F.filter(F.split(F.col(needle), r"\s+"), lambda w: w != "")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    n = needles.select(F.col(needle_id).alias("_nid"), F.col(needle).alias("_needle"), inner.alias("_inner"))
    key = lambda ws, i, k: F.xxhash64(*[F.get(ws, i + j) for j in range(k)])
    zero, size = F.lit(0), F.size("_inner")
    by_words = F.when(size >= words, key(F.col("_inner"), zero, words)).otherwise(key(F.col("_inner"), zero, 1))
    keyed = n.select("_nid", (size >= words).alias("_long"), (size > 0).alias("_any"), by_words.alias("_key"), F.substring("_needle", 1, 3).alias("_start"))
    t = texts.select(F.col(text_id).alias("_tid"), F.col(text).alias("_text"))
    tokens = t.select("_tid", "_text", F.filter(F.split("_text", r"\s+"), lambda w: w != "").alias("_w"))
    grams = F.transform(F.sequence(zero, F.size("_w") - words), lambda i: key(F.col("_w"), i, words))
    many = tokens.where(F.size("_w") >= words).select("_tid", F.explode(F.array_distinct(grams)).alias("_key"))
    single = tokens.select("_tid", F.explode(F.array_distinct(F.transform("_w", lambda w: F.xxhash64(w)))).alias("_key"))
    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("_text")), lambda i: F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda k: F.substring("_text", i, k))))
    starts = F.when(F.length("_text") > 0, F.array_distinct(F.concat(F.array(F.lit("")), starts))).otherwise(F.array(F.lit("")))
    letters = t.where("_text is not null").select("_tid", F.explode(starts).alias("_start"))
    pairs = many.join(keyed.where("_any and _long"), "_key").select("_tid", "_nid")
    pairs = pairs.unionByName(single.join(keyed.where("_any and not _long"), "_key").select("_tid", "_nid"))
    pairs = pairs.unionByName(letters.join(keyed.where("not _any"), "_start").select("_tid", "_nid")).distinct()
    found = pairs.join(t, "_tid").join(n.select("_nid", "_needle"), "_nid").where(F.contains("_text", "_needle"))
    return found.groupBy(F.col("_tid").alias(text_id)).agg(F.min("_nid").alias(needle_id))


def first_refactor(risks: DataFrame, refactors: DataFrame, key: str = "seq") -> DataFrame:
    """Each risk with the first refactor whose path contains, or is contained in, its own.

    A path that contains another shares its last part or holds it as a substring, so
    there is no equality to join on; refactors are few for one analysis, and the
    analysis id keeps the comparison within it.
    """
    a, b = risks["file_path"], refactors["file_path"]
    same = (risks["analysis_id"] == refactors["analysis_id"]) & (F.contains(a, b) | F.contains(b, a))
    matched = risks.join(refactors, same).groupBy(risks["analysis_id"], risks[key]).agg(
        F.min_by(F.struct(refactors["explanation"], refactors["refined_code"], refactors["pos"]), refactors["pos"]).alias("refactor")
    )
    return risks.join(matched, ["analysis_id", key], "left")
