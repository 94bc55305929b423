"""Chat formatting with Spark expressions only (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The template's control strings.
TURN, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column, also: str = "") -> Column:
    """No ``<|`` stays in the text: a backslash goes before every backslash and every bar after ``<``.

    ``also`` is one more character to mark.
    """
    return F.regexp_replace(text, rf"\\|(?<=<)\|{'|' + also if also else ''}", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv, formatted, loss): one text per conversation and the spans of it that are learned.

    Turns are sorted by (turn, role, text), nulls first, so ties have one order; repeated
    rows are turns of their own. Null roles and texts count as empty, null conversations
    as one conversation. Neighbouring turns of one role share a block and are parted by
    ``NEXT``, so that all turns can be read back. ``loss`` holds (start, length) in code
    points for each text of the role ``learn``. A conversation is one row of the result
    and must fit a row; it is the only thing that is gathered.
    """
    rows = turns.select(
        F.col(f"`{conv}`").alias("c"),
        F.struct(F.col(f"`{turn}`").alias("n"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("r"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).alias("x"),
    )
    ordered = rows.groupBy("c").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def piece(x: Column, i: Column) -> Column:
        same = (i > 0) & (F.get("xs", i - 1)["r"] == x["r"])
        ends = (i == F.size("xs") - 1) | (F.get("xs", i + 1)["r"] != x["r"])
        return F.struct(
            F.when(same, F.lit(NEXT)).otherwise(F.concat(F.lit(TURN), escape(x["r"], "\n"), F.lit("\n"))).alias("before"),
            escape(x["t"]).alias("body"),
            F.when(ends, F.lit(END + "\n")).otherwise(F.lit("")).alias("after"),
            (x["r"] == learn).alias("learned"),
        )

    def place(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["before"])
        size = F.char_length(p["body"])
        return F.struct(
            (start + size + F.char_length(p["after"])).alias("at"),
            F.when(p["learned"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), size.alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        )

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return ordered.withColumn("ps", F.transform("xs", piece)).select(
        F.col("c").alias(conv),
        F.concat_ws("", F.transform("ps", lambda p: F.concat(p["before"], p["body"], p["after"]))).alias("formatted"),
        F.aggregate("ps", empty, place)["spans"].alias("loss"),
    )


def read_back(chats: DataFrame, text: str = "formatted") -> DataFrame:
    """The rows with ``turns``, array of (role, text), parsed from formatted conversations; null has none."""
    blocks = F.slice(F.split(F.col(f"`{text}`"), r"<\|im_start\|>"), 2, 1 << 30)

    def turns(block: Column) -> Column:
        head = F.regexp_extract(block, r"(?s)^((?:\\.|[^\\\n])*)\n", 1)
        body = F.substr(block, F.char_length(head) + 2)
        inside = F.regexp_replace(body, r"<\|im_end\|>\n\z", "")
        return F.transform(F.split(inside, r"<\|im_sep\|>"), lambda part: F.struct(unescape(head).alias("role"), unescape(part).alias("text")))

    return chats.withColumn("turns", F.coalesce(F.flatten(F.transform(blocks, turns)), F.array().cast("array<struct<role:string,text:string>>")))


def learned_text(text: Column, spans: Column) -> Column:
    """All text under the loss spans, unescaped, nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substr(text, s["start"] + 1, s["length"]))))
