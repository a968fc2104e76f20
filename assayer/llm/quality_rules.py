"""Quality rules: a threshold table compiled into one Spark projection.

Every statistic is a built-in expression over the whole text, so the plan is a
scan and projections without a shuffle and without Python. Counts are per row;
nothing is gathered across rows.

Defined cases: a null text counts as empty; an empty text has no words and so
fails the base rule; repeated rows are judged one by one; an empty table gives
an empty result; further input columns are kept, those named like a statistic or
an internal column (``_words`` and the like) are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE

# Frequent function words of the four corpus languages.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "au aux dans de des du elle en est et il la le les ne on par pas pour que qui se sur un une "
    "auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "al como con del el en es la las lo los no para por que se su un una y"
).split()

#: Words in the window whose repetition is counted.
REPEAT_WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``numerator`` / ``denominator`` must lie within [low, high]; 0/0 passes."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None
    high: float | None


#: The threshold table. Ratios are tested by multiplication, so no division by zero.
RULES = (
    Rule("n_words", "n_words", None, 20, None),
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.3),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.4),
    Rule("repeat_word_ratio", "n_repeat_words", "n_words", None, 0.3),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    Rule("shout_ratio", "n_shout_words", "n_words", None, 0.5),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 0.5),
)


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression that holds when every rule of the table holds."""
    verdict = F.lit(True)
    for r in rules:
        scale = F.lit(1.0) if r.denominator is None else F.col(r.denominator).cast("double")
        value = F.col(r.numerator).cast("double")
        if r.low is not None:
            verdict = verdict & (value >= scale * r.low)
        if r.high is not None:
            verdict = verdict & (value <= scale * r.high)
    return verdict


def _with_window_keys(df: DataFrame, words: str, window: int) -> DataFrame:
    """Adds ``_keys``: a 64-bit key for every run of ``window`` words.

    Keys double in width by pairing each with the one a width further on. Every
    step is a column of its own: its two uses then read one computed array.
    """
    df = df.withColumn("_keys", F.transform(words, lambda w: F.xxhash64(w)))
    width = 1
    while width < window:
        step = min(width, window - width)
        rest = F.greatest(F.size("_keys") - step, F.lit(0))
        df = df.withColumn(
            "_keys",
            F.zip_with(F.slice("_keys", 1, rest), F.slice("_keys", 1 + step, rest), lambda a, b: F.xxhash64(a, b)),
        )
        width += step
    return df


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the rules use; texts are read whole.

    Only texts that have a repeated window are sorted by key; equal neighbours in
    that order mark the repeated starts, and the covered words are the gaps
    between sorted starts, each at most the window.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, WORD_SPACE), "")
    out = df.withColumn("_words", words)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines)
    out = _with_window_keys(out, "_words", REPEAT_WINDOW)
    pairs = F.array_sort(F.transform(F.col("_keys"), lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    same = lambda a, b: F.coalesce(F.get(F.col("_pairs"), a)["k"] == F.get(F.col("_pairs"), b)["k"], F.lit(False))
    starts = F.array_sort(
        F.transform(
            F.filter(F.col("_pairs"), lambda x, i: same(i, i - 1) | same(i, i + 1)),
            lambda x: x["i"],
        )
    )
    repeated = F.size(F.array_distinct("_keys")) < F.size("_keys")
    out = out.withColumn("_pairs", F.when(repeated, pairs)).withColumn("_starts", F.when(repeated, starts))
    covered = F.aggregate(
        F.col("_starts"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            (s + REPEAT_WINDOW).alias("end"),
            (a["n"] + F.least(F.lit(REPEAT_WINDOW), s + REPEAT_WINDOW - a["end"])).alias("n"),
        ),
        lambda a: a["n"],
    )
    lower_words = F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.size("_words").cast("long").alias("n_words"),
        (F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lower_words).cast("long").alias("n_stop_words"),
        F.regexp_count(t, F.lit(r"\p{Lu}{2,}[^\x20\x09-\x0D]*")).cast("long").alias("n_shout_words"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09]*\z"))).cast("long").alias("n_ellipsis_lines"),
    )


def quality_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for every row.

    ``base_failed``: fewer than 20 words, or over 30 % of the words lie in
    repeated 8-word windows. ``kept``: not ``base_failed`` and every rule holds.
    Input columns named like a statistic are replaced.
    """
    names = {
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
        "n_shout_words", "n_bullet_lines", "n_ellipsis_lines", "base_failed", "kept",
        "_words", "_lines", "_keys", "_pairs", "_starts",
    }
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    stats = text_statistics(df, text)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
