"""Chat formatting: conversations as one training text each, with Spark expressions only.

The turns of a conversation are collected as structs, sorted, merged where neighbours share a role, and
concatenated. The template is

    <|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT ...]<|im_end|>\\n

with one block for each run of turns of one role. Inside texts and roles `<|` can't occur: every `<`, any number
of backslashes and `|` get one backslash more, which reading back takes away again. A role's own backslashes and
newlines are escaped too, since a newline ends it.

Defined results: a null text or role is empty; a null turn sorts first; rows that tie in turn sort by role, then
text; repeated rows are repeated turns; the rows without conversation id form one conversation; an empty table
gives no rows; columns other than the four named ones are ignored. A conversation's text is one value, so one
conversation is as long as a row may be; conversations are spread over tasks by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, n_messages (after merging), formatted, loss_mask.

    loss_mask covers the formatted text from its start: an array of (skip, keep) counts of code points, one for each
    turn; `keep` code points after `skip` others are trained on. What follows the last pair is not.
    """
    turns = df.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                 F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    ).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    t = F.col("turns")

    def marker(x: Column, i: Column) -> Column:
        same = (i > 0) & (F.get(t, i - 1)["role"] == x["role"])
        return F.when(same, F.lit(SEP)).otherwise(
            F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), escape_role(x["role"]), F.lit("\n")))

    pieces = F.transform(t, lambda x, i: F.struct(
        marker(x, i).alias("mark"), escape(x["text"]).alias("body"), (x["role"] == loss_role).alias("loss")))
    counts = F.aggregate("pieces", F.lit(0), lambda n, p: n + F.when(p["mark"] == SEP, 0).otherwise(1))
    loss_mask = F.transform("pieces", lambda p: F.struct(
        (F.length(p["mark"]) + F.when(p["loss"], 0).otherwise(F.length(p["body"]))).cast("long").alias("skip"),
        F.when(p["loss"], F.length(p["body"])).otherwise(0).cast("long").alias("keep")))
    return (turns.select("conv_id", "turns").withColumn("pieces", pieces)
            .select("conv_id", F.size("pieces").cast("long").alias("n_turns"), counts.cast("long").alias("n_messages"),
                    F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["body"])), ""),
                             F.lit(END)).alias("formatted"),
                    loss_mask.alias("loss_mask")))


def parse_formatted(formatted: Column) -> Column:
    """The turns read back from a formatted text: array of (role, text), unescaped."""
    blocks = F.split(formatted, r"<\|im_start\|>", -1)

    def block(b: Column) -> Column:
        body = F.substring(b, F.lit(1), F.length(b) - len(END))
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substring(body, F.length(role) + 2, F.length(body)), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda x: F.struct(unescape_role(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), block))


def trained_text(formatted: Column, loss_mask: Column) -> Column:
    """What the mask lets through of a formatted text, unescaped and joined.

    The text is cut once, before each mark that begins a turn, and each entry of the mask is applied to its turn's piece;
    the end of the block before, which the entry skips too, belongs to the piece before. So time is linear in the text."""
    pieces = F.split(formatted, r"(?=<\|im_start\|>|<\|im_sep\|>)", -1)

    def kept(piece: Column, i: Column) -> Column:
        m = F.get(loss_mask, i)
        before = F.when((i > 0) & piece.startswith(START), len(END)).otherwise(0)
        return F.when(m["keep"] > 0, unescape(F.substring(piece, (m["skip"] - before + 1).cast("int"), m["keep"].cast("int")))).otherwise("")

    return F.array_join(F.transform(pieces, kept), "")


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation the counts and digests of its turns and of the text under its mask, read back from the formatted text."""
    back = formatted.select("conv_id", "formatted", "n_messages", parse_formatted(F.col("formatted")).alias("turns"),
                            trained_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_messages")
