"""Operator 10: chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one role are merged into one block and
blocks are concatenated::

    ### <role>: <text>[<+><text>...]</turn>\n

Control strings inside roles and texts are escaped: ``\\`` to ``\\s``, ``</turn>`` to ``\\t``, ``<+>`` to ``\\p``,
``###`` to ``\\h`` and, in roles, ``:`` to ``\\c``. Every backslash of an escaped text starts such a pair, so the
escape is undone by replacing the pairs, ``\\s`` last, and the turns can be read back from the formatted string.

Defined cases: a null text is an empty one, a null role an empty role; rows with equal turn numbers are ordered by
role and text; repeated rows are repeated turns; a null conv_id is a conversation of its own; null turns come
first; an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

END, JOINT, HEAD = "</turn>\n", "<+>", "### "
BLOCK, PIECE = 200, 256


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once for the row, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def starts(lengths: Column) -> Column:
    """The sum of the lengths before each of an array's elements."""
    none = F.expr("cast(array() as array<int>)")

    def running(own: Column, first: Column) -> Column:
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(own, F.struct(first.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def blocked(n: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int"))
        return bound(
            F.transform(numbers, lambda k: F.slice(n, k * BLOCK + 1, BLOCK)),
            lambda blocks: F.flatten(F.zip_with(blocks, running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), F.lit(0)), running)),
        )

    return bound(lengths, lambda n: F.when(F.size(n) == 0, none).otherwise(blocked(n)))


def cut(text: Column, spans: Column) -> Column:
    """The parts of a text at (start, length), each read from the pieces that hold it."""

    def part(pieces: Column, s: Column) -> Column:
        first, last = (s["start"] / PIECE).cast("int"), ((s["start"] + s["length"] - 1) / PIECE).cast("int")
        held = F.array_join(F.slice(pieces, first + 1, F.greatest(last - first + 1, F.lit(1))), "")
        return F.when(s["length"] > 0, F.substring(held, s["start"] - first * PIECE + 1, s["length"])).otherwise("")

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return bound(pieces, lambda p: F.transform(spans, lambda s: part(p, s)))


def escape(c: Column) -> Column:
    for raw, safe in (("\\", "\\s"), ("</turn>", "\\t"), ("<+>", "\\p"), ("###", "\\h")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in (("###", "\\h"), ("<+>", "\\p"), ("</turn>", "\\t"), (":", "\\c"), ("\\", "\\s")):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, formatted, loss): loss holds (start, length) in code points of
    ``formatted`` for each text of ``loss_role``, marks and joints left out."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    # a turn's mark is a joint after a turn of the same role, else the end of the block before and a new head
    parts = F.transform(
        "t",
        lambda x, i: F.struct(
            F.when((i > 0) & (F.element_at("t", F.greatest(i, F.lit(1)))["role"] == x["role"]), F.lit(JOINT))
            .otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(HEAD), F.replace(escape(x["role"]), F.lit(":"), F.lit("\\c")), F.lit(": ")))
            .alias("mark"),
            escape(x["text"]).alias("body"),
            (x["role"] == loss_role).alias("on"),
        ),
    )
    rows = rows.select("conv_id", parts.alias("p"))
    lengths = rows.select("conv_id", "p", F.transform("p", lambda x: F.struct(F.length(x["mark"]).alias("m"), F.length(x["body"]).alias("b"), x["on"].alias("on"))).alias("n"))
    at = starts(F.transform("n", lambda x: x["m"] + x["b"]))
    every = F.zip_with("n", at, lambda x, a: F.struct((a + x["m"]).alias("start"), x["b"].alias("length"), x["on"].alias("on")))
    spans = F.transform(F.filter(every, lambda x: x["on"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    text = F.concat(F.array_join(F.transform("p", lambda x: F.concat(x["mark"], x["body"])), ""), F.lit(END))
    return lengths.select("conv_id", text.alias("formatted"), spans.alias("loss"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) to (conv_id, turns, loss_text): the turns as (role, text) read back from the
    formatted string, and the unescaped text under the mask."""
    blocks = F.filter(F.split("formatted", "</turn>\n"), lambda b: b != "")

    def block(b: Column) -> Column:
        cut = F.instr(b, F.lit(": "))
        role = unescape(F.substring(b, F.lit(len(HEAD) + 1), cut - F.lit(len(HEAD) + 1)))
        texts = F.split(F.substring(b, cut + 2, F.length(b)), "<\\+>")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.array_join(F.transform(cut(F.col("formatted"), F.col("loss")), unescape), "")
    return formatted.select("conv_id", F.flatten(F.transform(blocks, block)).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_chats(format_chats(turns))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), esc AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\s'), '</turn>', '\t'), '<+>', '\p'), '###', '\h') AS e,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(e) + CASE WHEN before = role THEN 3 ELSE 14 + length(role) END)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""
