"""Secret scans with Spark expressions only.

Three pattern kinds are found with regular expressions; a fourth, ``entropy``,
adds candidate strings in which a sliding window of one character class has a
high Shannon entropy. The window's character counts are kept incrementally: one
character enters, one leaves, and the entropy sum changes by their two terms.
An allow-list suppresses candidates that are known to be harmless. All of it is
a projection per row: no shuffle, no Python.

Positions are code points, end exclusive. Regular expressions give no offsets
in SQL, so a second pass extracts the gap before each match, and offsets are
running sums of gap and match lengths. The cost grows in proportion to the text
and its matches.

Defined cases: a null text counts as empty and has no spans; texts are scanned
whole; repeated rows are scanned one by one; an empty table gives no rows; an
input column named like an added one is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import blocks_of, let, piece, running

SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"
#: Kinds by rank: ties of the start are listed in this order.
KINDS = ("assign", "access", "hex", "entropy")

_VALUE = r"[A-Za-z0-9+/_.=-]"
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Pattern:
    """``guard`` holds for every text with a passing match; ``least`` bounds ``group``."""

    regex: str
    group: int
    least: int
    guard: str


PATTERNS = {
    "assign": Pattern(f"{_ASSIGN}({_VALUE}+)", 1, 12, f"{_ASSIGN}{_VALUE}{{12}}"),
    "access": Pattern("(AKIA[A-Z0-9]+)", 1, 18, "AKIA[A-Z0-9]{14}"),
    "hex": Pattern("([0-9a-f]+)", 1, 16, "[0-9a-f]{16}"),
}


@dataclass(frozen=True)
class CharClass:
    """A candidate belongs to the first class whose ``shape`` it has in full."""

    name: str
    shape: str
    alphabet: str
    window: int
    bits: float


CLASSES = (
    CharClass("hex", r"[0-9a-fA-F]+", "0123456789abcdefABCDEF", 20, 2.9),
    CharClass(
        "base64",
        r"[A-Za-z0-9+/_=-]+",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
        20,
        3.6,
    ),
)
#: Characters whose windows are looked at in one go.
STRETCH = 512
#: A candidate has a digit and a letter and at least the window's length.
_RANDOM = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
CANDIDATE = Pattern(f"({_RANDOM})", 1, 20, _RANDOM)
# Shapes of whole candidates that are harmless.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"^/",
    r"^[A-Za-z]+([_-][A-Za-z]+)*[_-]?[0-9]{1,4}$",
)
#: What makes a stretch harmless but says nothing of the rest of its candidate ...
ALLOWED_INSIDE = (
    r"(?i)example|placeholder|changeme|dummy|sample|redacted",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"(.)\1{5}",
    r"//|(/[A-Za-z_-]+){3}",
)
#: ... which is split here into parts that are judged one by one.
_PARTS = r"(.)\1{5,1000}|=|//|(/[A-Za-z_-]+){3,64}"


def _matches(text: Column, p: Pattern) -> Column:
    """Leftmost non-overlapping matches as (gap, match, value) structs.

    A gap starts where the match before it ended (\\G); without that anchor the text
    after the last match would be searched again from each of its characters.
    """
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(f"(?s)\\G(.*?)(?:{p.regex})"), F.lit(1)).alias("gap"),
        F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(p.regex), F.lit(p.group)).alias("value"),
    )


def _spans(text: Column, p: Pattern, rank: int, passes) -> Column:
    """Spans of the matches for which ``passes(value)`` holds; dropped matches stay consumed."""
    empty = F.array().cast(SPANS)

    def placed(matches: Column) -> Column:
        size = lambda m: (F.length(m["gap"]) + F.length(m["match"])).cast("bigint")
        ends = running(F.transform(matches, size), lambda x, y: x + y)
        spans = F.zip_with(
            matches,
            ends,
            lambda m, end: F.when(
                passes(m["value"]), F.struct((end - F.length(m["match"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
            ),
        )
        return F.array_compact(spans).cast(SPANS)

    return F.when(text.rlike(p.guard), let(_matches(text, p), placed)).otherwise(empty)


def window_entropy(value: Column, c: CharClass) -> Column:
    """The highest entropy, in bits, of any window of ``c.window`` characters; 0 for shorter values.

    Long values are cut into stretches that overlap by a window less one character.
    """
    ahead = lambda blocks, b, i: F.concat(b, F.substring(F.coalesce(F.get(blocks, i + 1), F.lit("")), 1, c.window - 1))
    best = lambda blocks: F.array_max(F.transform(blocks, lambda b, i: _stretch_entropy(ahead(blocks, b, i), c)))
    return F.when(F.length(value) <= STRETCH, _stretch_entropy(value, c)).otherwise(let(blocks_of(value, STRETCH), best))


def _stretch_entropy(value: Column, c: CharClass) -> Column:
    """The same for one stretch, whose counts are kept incrementally.

    Characters outside the alphabet count as one further symbol.
    """
    w = c.window
    term = F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(w + 2)])
    code = lambda i: F.instr(F.lit(c.alphabet), F.substring(value, i + 1, F.lit(1)))
    state = F.struct(
        F.array_repeat(F.lit(0), len(c.alphabet) + 1).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(float(w * math.log2(w))).alias("least"),
    )

    def slide(a: Column, x: Column) -> Column:
        i, enter, leave = x["i"], x["enter"], x["leave"]
        n_in, n_out = F.get(a["counts"], enter), F.get(a["counts"], leave)
        change = F.when(enter == leave, F.lit(0.0)).otherwise(
            F.get(term, n_in + 1)
            - F.get(term, n_in)
            + F.when(leave < 0, F.lit(0.0)).otherwise(F.get(term, n_out - 1) - F.get(term, n_out))
        )
        counts = F.transform(
            a["counts"], lambda n, k: n + F.when(k == enter, 1).otherwise(0) - F.when(k == leave, 1).otherwise(0)
        )
        total = a["sum"] + change
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            F.when(i >= w - 1, F.least(a["least"], total)).otherwise(a["least"]).alias("least"),
        )

    steps = F.transform(
        F.sequence(F.lit(0), F.length(value) - 1),
        lambda i: F.struct(i.alias("i"), code(i).alias("enter"), F.when(i >= w, code(i - w)).otherwise(-1).alias("leave")),
    )
    best = F.aggregate(steps, state, slide, lambda a: F.lit(math.log2(w)) - a["least"] / w)
    return F.when(F.length(value) >= w, best).otherwise(F.lit(0.0))


def _high(value: Column) -> Column:
    """True for a value that passes its class's bound."""
    verdict = F.lit(False)
    for c in reversed(CLASSES):
        verdict = F.when(value.rlike(f"^(?:{c.shape})$"), window_entropy(value, c) >= c.bits).otherwise(verdict)
    return verdict


def _any(value: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for a in patterns:
        found = found | value.rlike(a)
    return found


def is_random(value: Column) -> Column:
    """True for a candidate that passes its class's bound and no allow-list entry.

    A candidate with a harmless stretch inside passes if one of its other parts
    does, with a digit and a letter of its own.
    """
    part = lambda p: F.when(
        p.rlike(_RANDOM) & ~_any(p, (*ALLOWED, *ALLOWED_INSIDE)), _high(p)
    ).otherwise(F.lit(False))
    return (
        F.when(_any(value, ALLOWED), F.lit(False))
        .when(_any(value, ALLOWED_INSIDE), F.exists(F.split(value, _PARTS), part))
        .otherwise(_high(value))
    )


def secret_spans(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Adds ``out``: all spans, sorted by start, then kind; ``rank`` indexes ``KINDS``.

    Entropy spans that lie within a span of another kind are left out: that text is
    reported already. One that is covered in part stays whole and overlaps.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = [_spans(t, p, KINDS.index(k), lambda v, least=p.least: F.length(v) >= least) for k, p in PATTERNS.items()]
    found = F.array_sort(F.concat(*base, _spans(t, CANDIDATE, len(base), is_random)))

    def not_covered(spans: Column) -> Column:
        # Spans of other kinds that start no later come first: the furthest end of them decides.
        reach = running(F.transform(spans, lambda s: F.when(s["rank"] < len(base), s["end"]).otherwise(F.lit(-1))), F.greatest)
        kept = F.zip_with(spans, reach, lambda s, r: F.when((s["rank"] < len(base)) | (r < s["end"]), s))
        return F.array_compact(kept)

    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    return df.select(*kept, let(found, not_covered).alias(out))


def render(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text", spans: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """Replaces every stretch of text under one or more spans by ``mark``; all other columns stay."""
    t, all_spans = F.col(text), F.col(spans)

    def cut(blocks: Column) -> Column:
        ends = running(F.transform(all_spans, lambda s: s["end"]), F.greatest)
        before = lambda e, i: F.coalesce(F.get(e, i - 1), F.lit(0).cast("bigint"))
        parts = lambda e: F.transform(
            all_spans,
            lambda s, i: F.when(
                s["start"] >= before(e, i), F.concat(piece(blocks, before(e, i), s["start"]), F.lit(mark))
            ).otherwise(F.lit("")),
        )
        return let(ends, lambda e: F.concat(F.array_join(parts(e), ""), piece(blocks, F.element_at(e, -1), F.length(t).cast("bigint"))))

    return df.withColumn(text, F.when(F.size(all_spans) > 0, let(blocks_of(t), cut)).otherwise(t))
