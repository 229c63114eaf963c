"""Chat formatting with a checked grammar round trip, in built-in functions only.

Grammar: ``conversation := turn*``, ``turn := START role LF text END LF``, where role and text
hold no control string. Every rendered turn is parsed again; where the parser does not give back
the source, the content is escaped, and the whole conversation is parsed once more at the end.

Escaping is reversible for any content: in texts each ``<``, backslashes, ``|`` gets one more
backslash, so no ``<|`` is left; in roles ``%``, ``<`` and line ends become percent codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<role:string,text:string>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for plain, code in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for code, plain in (("%0A", "\n"), ("%3C", "<"), ("%25", "%")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, or NULL where it does not follow the grammar."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    tail = f"{END}\n"

    def role_of(piece: Column) -> Column:
        return F.substring_index(piece, "\n", 1)

    def text_of(piece: Column) -> Column:
        skipped = F.length(role_of(piece)) + 1
        return F.substring(piece, skipped + 1, F.length(piece) - skipped - F.lit(len(tail)))

    def valid(piece: Column) -> Column:
        return (
            F.endswith(piece, F.lit(tail))
            & (F.length(piece) >= F.length(role_of(piece)) + 1 + len(tail))
            & ~F.contains(role_of(piece), F.lit("<"))
            & ~F.contains(text_of(piece), F.lit("<|"))
        )

    turns = F.slice(pieces, 2, F.size(pieces))
    good = (F.element_at(pieces, 1) == "") & F.forall(turns, valid)
    return F.when(
        good,
        F.transform(
            turns,
            lambda p: F.struct(unescape_role(role_of(p)).alias("role"), unescape_text(text_of(p)).alias("text")),
        ),
    )


def format_conversations(
    rows: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    masked_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: id, ``n_turns``, ``formatted`` and the loss mask ``loss_spans``.

    ``loss_spans`` are ``[start, end)`` in code points of ``formatted``, one per turn of
    ``masked_role``, covering its escaped text. NULL role or text counts as empty. Turns are
    ordered by turn, then role, then text; equal rows stay. A row without a conversation id
    is a conversation of its own, so such rows never gather in one group.
    """
    source = rows.select(
        F.col(f"`{conversation}`").alias("id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        F.when(F.col(f"`{conversation}`").isNull(), F.monotonically_increasing_id()).alias("alone"),
    )
    plain = render_turn(F.col("role"), F.col("text"))
    same = parse(plain) == F.array(F.struct("role", "text"))
    tried = source.withColumn("same", F.coalesce(same, F.lit(False)))
    shown_role = F.when(F.col("same"), F.col("role")).otherwise(escape_role(F.col("role")))
    shown_text = F.when(F.col("same"), F.col("text")).otherwise(escape_text(F.col("text")))
    prepared = tried.select(
        "id",
        "alone",
        F.struct(
            "turn",
            "role",
            "text",
            render_turn(shown_role, shown_text).alias("shown"),
            (F.length(shown_role) + len(START) + 1).alias("lead"),
            F.length(shown_text).alias("size"),
        ).alias("t"),
    )
    grouped = prepared.groupBy("id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def place(state: Column, t: Column) -> Column:
        start = state["at"] + t["lead"]
        span = F.struct(start.alias("start"), (start + t["size"]).alias("end"))
        return F.struct(
            (state["at"] + F.length(t["shown"])).alias("at"),
            F.when(t["role"] == masked_role, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    shown = grouped.select(
        F.col("id").alias(conversation),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.aggregate("turns", begin, place, lambda s: s["spans"]).alias("loss_spans"),
    )
    checked = F.when(parse(F.col("formatted")) == F.col("source"), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation does not survive its round trip")).cast("string")
    )
    return shown.select(conversation, "n_turns", checked.alias("formatted"), "loss_spans")


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(spans, lambda s: unescape_text(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )
