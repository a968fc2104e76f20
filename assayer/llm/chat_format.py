"""Chat formatting with Spark expressions only.

Turns are collected per conversation as structs and sorted. Adjacent turns of one
role are merged by array aggregation into one block, which has one header and one
end mark, and an ``array_join`` writes the string. All of it grows in proportion
to the number of turns and the length of their texts.

Template, for a block of turns of one role::

    ### role:
    text</part>text</turn>

Control strings inside a text are replaced by two-character codes that start
with a backslash, and a backslash by a code of its own. A formatted text then
holds no control string, and plain replacement restores it.

Defined cases: null text and null role count as empty; null turns come first;
ties of ``turn`` are ordered by role, then text, and repeated rows are kept; a
null ``conv_id`` is a conversation of its own; an empty table gives no rows;
further input columns are ignored. A conversation is one output row, so its
turns meet in one task, as the format requires.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import blocks_of, let, piece, running

HEAD, HEAD_END, PART, TURN_END = "### ", ":\n", "</part>", "</turn>\n"
#: Control string -> code; the backslash comes first on the way in and last on the way out.
CODES = {"\\": "\\b", HEAD: "\\h", PART: "\\p", "</turn>": "\\t"}
#: A role also hides the line break that ends its header.
ROLE_CODES = CODES | {"\n": "\\n"}


def escape(text: Column, codes: dict[str, str] = CODES) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), codes.items(), text)


def unescape(text: Column, codes: dict[str, str] = CODES) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[1]), F.lit(kv[0])), reversed(codes.items()), text)


def format_chats(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``.

    ``loss_spans`` are the code-point ranges, end exclusive, of the escaped texts
    of ``loss_role``; template strings are never inside.
    """
    row = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    turns = df.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("_turns"))
    return turns.select("conv_id", let(_merged(F.col("_turns")), lambda blocks: _written(blocks, loss_role)).alias("_out")).select(
        "conv_id", "_out.formatted", "_out.loss_spans"
    )


def _merged(turns: Column) -> Column:
    """Blocks of adjacent turns of one role: ``role`` and the escaped ``parts`` of their texts."""
    role_at = lambda i: F.get(turns, i)["role"]
    opens = F.filter(F.transform(turns, lambda x, i: F.when((i > 0) & (role_at(i - 1) == x["role"]), F.lit(-1)).otherwise(i)), lambda i: i >= 0)

    def blocks(firsts: Column) -> Column:
        end = lambda k: F.coalesce(F.get(firsts, k + 1), F.size(turns))
        return F.transform(
            firsts,
            lambda i, k: F.struct(role_at(i).alias("role"), F.transform(F.slice(turns, i + 1, end(k) - i), lambda x: escape(x["text"])).alias("parts")),
        )

    return let(opens, blocks)


def _written(blocks: Column, loss_role: str) -> Column:
    """``formatted`` and ``loss_spans`` of merged blocks."""
    head = lambda b: F.concat(F.lit(HEAD), escape(b["role"], ROLE_CODES), F.lit(HEAD_END))
    text = lambda b: F.concat(head(b), F.array_join(b["parts"], PART), F.lit(TURN_END))
    # Each part with what stands before and after it up to the next part.
    sizes = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                b["parts"],
                lambda p, i: F.struct(
                    F.when(i == 0, F.length(head(b))).otherwise(F.lit(0)).cast("bigint").alias("before"),
                    F.length(p).cast("bigint").alias("size"),
                    F.when(i == F.size(b["parts"]) - 1, len(TURN_END)).otherwise(len(PART)).cast("bigint").alias("after"),
                    (b["role"] == loss_role).alias("loss"),
                ),
            ),
        )
    )

    def spans(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda p: p["before"] + p["size"] + p["after"]), lambda x, y: x + y)
        placed = F.zip_with(
            parts,
            ends,
            lambda p, end: F.when(p["loss"], F.struct((end - p["after"] - p["size"]).alias("start"), (end - p["after"]).alias("end"))),
        )
        return F.array_compact(placed)

    return F.struct(F.array_join(F.transform(blocks, text), "").alias("formatted"), let(sizes, spans).alias("loss_spans"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Reads ``formatted`` back: adds ``turns`` (role, text) and ``loss_text``."""
    blocks = F.slice(F.split("formatted", TURN_END), 1, F.size(F.split("formatted", TURN_END)) - 1)

    def block(b: Column) -> Column:
        role = unescape(F.regexp_extract(b, r"^### ([^\n]*):\n", 1), ROLE_CODES)
        body = F.substring(b, F.instr(b, "\n") + 1, F.length(b))
        return F.transform(F.split(body, PART), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    loss = let(blocks_of(F.col("formatted")), lambda text: F.transform("loss_spans", lambda s: unescape(piece(text, s["start"], s["end"]))))
    return formatted.withColumn("turns", F.flatten(F.transform(blocks, block))).withColumn("loss_text", F.array_join(loss, ""))
