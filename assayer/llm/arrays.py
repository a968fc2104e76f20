"""Expressions over arrays and long texts whose cost grows in proportion to their length.

Appending to an array in an aggregation copies it each time. Running values are
therefore built within blocks, whose length is fixed, and blocks are joined once;
in the same way a text is cut into blocks before many pieces are taken from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Array elements, and characters, of a block.
ITEMS, CHARS = 256, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The array of ``v1, op(v1, v2), op(op(v1, v2), v3) ...`` of an array without nulls; ``op`` is associative."""
    last = lambda a: F.get(a, F.size(a) - 1)
    append = lambda a, x: F.concat(a, F.array(F.coalesce(op(last(a), x), x)))

    def of(v: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / ITEMS).cast("int"), F.lit(0)))
        inner = F.transform(cuts, lambda c: F.aggregate(F.slice(v, c * ITEMS + 1, F.lit(ITEMS)), F.slice(v, 1, 0), append))
        joined = lambda blocks: let(
            F.aggregate(blocks, F.slice(v, 1, 0), lambda a, p: F.concat(a, F.array(F.coalesce(op(last(a), last(p)), last(p))))),
            lambda ends: F.flatten(F.transform(blocks, lambda p, c: F.when(c == 0, p).otherwise(F.transform(p, lambda x: op(F.get(ends, c - 1), x))))),
        )
        return let(inner, joined)

    return F.when(F.size(values) > 0, let(values, of)).otherwise(F.slice(values, 1, 0))


def blocks_of(text: Column, size: int | None = None) -> Column:
    """The text in blocks of ``size`` (``CHARS`` for ``piece``) code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size or CHARS}}}"), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end``, exclusive, of a text in blocks."""
    a, b = F.floor(start / CHARS).cast("int"), F.floor(end / CHARS).cast("int")
    part = lambda k, first, n: F.substring(F.coalesce(F.get(blocks, k), F.lit("")), (first + 1).cast("int"), n.cast("int"))
    first, rest = F.pmod(start, F.lit(CHARS)), F.pmod(end, F.lit(CHARS))
    inner = F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
    return F.when(a == b, part(a, first, end - start)).otherwise(F.concat(part(a, first, F.lit(CHARS)), inner, part(b, F.lit(0), rest)))
