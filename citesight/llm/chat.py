"""Chat transcripts rebuilt from event logs and rendered, in DataFrame expressions only.

Events carry a conversation, a sequence number, a kind and the message they
touch: ``message`` opens a message with its role and first text, ``delta``
appends to it, ``edit`` replaces what it holds, ``regenerate`` empties it for
the deltas that follow. Folding takes the events of one message by sequence:
only those from the last ``edit`` or ``regenerate`` on count, and their texts
are joined. Messages are then ordered by the sequence that opened them and
rendered.

The template marks a turn as ``<|im_start|>role\\n text <|im_end|>\\n``
(without the blanks). Control strings inside texts (``<|``, ``<s>``,
``</s>``, ``[INST]``, ``[/INST]``) get a backslash after their first
character, and ones that already have backslashes there get one more; taking
one away restores the text exactly, and a rendered text never holds ``<|``.
Roles are escaped likewise, with line feeds written as ``\\n``. The loss mask
lists the code-point span of every assistant text.

The fold groups by message before it groups by conversation, so a task holds
the live deltas of one message or the final messages of one conversation,
which is the result row itself.

Cases: null texts are empty, null roles are empty roles; events of equal
sequence are ordered by kind, role and text; equal events count as often as
they occur; a message whose opening event is missing takes the role of its
first event; a null conversation is a conversation; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = r"\||/?s>|/?INST\]"
RESET = ("edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Undo ``escape_role``: pairs of backslashes first become a mark that roles cannot hold escaped."""
    pieces = F.transform(F.split(unescape(role), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(pieces, "\\")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, role, text) of events (conv_id, seq, kind, message, role, text)."""
    opened = F.min(F.struct(F.when(F.col("kind") == "message", 0).otherwise(1), "seq", "role"))
    order = Window.partitionBy("conv_id", "message").orderBy("seq", "kind", "role", "text")
    cut = F.sum(F.when(F.col("kind").isin(*RESET), 1).otherwise(0)).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = events.select("conv_id", "message", "seq", "kind", "role",
                             F.coalesce("text", F.lit("")).alias("text"), cut.alias("cut"),
                             F.row_number().over(order).alias("nr"))
    heads = opened.alias("head")
    # texts before the last cut are dropped by comparing with the largest cut of the message
    last = F.max("cut").over(Window.partitionBy("conv_id", "message")).alias("last")
    live = numbered.select("*", last)
    folded = live.groupBy("conv_id", "message").agg(
        heads, F.sort_array(F.collect_list(F.when(
            (F.col("cut") == F.col("last")) & (F.col("kind") != "regenerate"),
            F.struct("nr", "text")))).alias("parts"))
    return folded.select("conv_id", F.col("head.seq").alias("seq"), "message", F.col("head.role").alias("role"),
                         F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans) of messages (conv_id, seq, role, text).

    ``loss_spans``: start and length in code points of each text of a role in ``learn``.
    """
    role = F.coalesce("role", F.lit(""))
    turns = messages.select(
        "conv_id", "seq", role.alias("role"), F.coalesce("text", F.lit("")).alias("raw"),
        F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"))
    conv = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "role", "raw", "head", "body"))).alias("turns"))
    # where each text begins: running sum over the turns before it
    conv = conv.select("conv_id", "turns", F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(t["head"]) + F.char_length(t["body"]) + len(END)).alias("at"),
            F.concat(acc["spans"], F.when(t["role"].isin(*learn), F.array(F.struct(
                (acc["at"] + F.char_length(t["head"])).alias("start"), F.char_length(t["body"]).alias("len"))))
                .otherwise(F.array().cast("array<struct<start:int,len:int>>"))).alias("spans")),
        lambda acc: acc["spans"]).alias("loss_spans"))
    return conv.select("conv_id", F.concat_ws("", F.transform(
        "turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))).alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted): role and text of each turn and the text under the mask, unescaped."""
    pieces = F.split(F.col("formatted"), r"<\|im_end\|>\n")
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda t: F.struct(
        unescape_role(F.regexp_extract(t, r"^<\|im_start\|>([^\n]*)\n", 1)).alias("role"),
        unescape(F.regexp_replace(t, r"^<\|im_start\|>[^\n]*\n", "")).alias("text")))
    loss = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"] + 1, s["len"]))))
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted")


def chat(events: DataFrame) -> DataFrame:
    """Fold and render: (conv_id, formatted, loss_spans)."""
    return render(fold(events))
