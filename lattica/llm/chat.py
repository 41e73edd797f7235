"""Chat formatting with typed content parts, in DataFrame functions only.

A message's content is an array of parts ``struct<kind, text, ref, units>``. ``flatten_parts`` visits them in
order: text is escaped, an image, audio or document part becomes a placeholder, its reference goes to
``attachments`` and its placeholder stands for ``ceil(units * rate)`` model tokens.

Template, one turn after the other::

    <|im_start|>ROLE\\nBODY<|im_end|>\\n

Escaping makes the template reversible: every ``&`` in a text becomes ``&amp;`` and every ``<|`` becomes
``&lt;|``, so that no control string or placeholder can come from a text; in roles a line feed becomes ``&#10;``.

Defined cases: a null text, part list or role is empty; a null part kind counts as text; an unknown kind is an
error value of zero tokens with its own placeholder; null turns come first; rows of equal turn are ordered by
role, then body; a null conversation id is a conversation of its own; an empty table gives no rows. Columns
other than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Model tokens for one unit of a part: an image's tiles, an audio's seconds, a document's pages.
TOKENS_PER_UNIT = {"image": 256.0, "audio": 25.0, "document": 900.0}


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    """The part list of a message that holds one text."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            text.alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(0.0).alias("units"),
        )
    )


def _kind(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text"))


def part_tokens(part: Column) -> Column:
    """Model tokens that a part's placeholder expands to; 0 for text."""
    cost = F.lit(0.0)
    for kind, rate in TOKENS_PER_UNIT.items():
        cost = F.when(_kind(part) == kind, F.lit(rate)).otherwise(cost)
    return F.ceil(F.greatest(F.coalesce(part["units"], F.lit(0.0)), F.lit(0.0)) * cost).cast("long")


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """Body string and attachments ``array<struct<kind, ref, tokens>>``, both in the parts' order."""
    parts = F.coalesce(parts, F.array().cast("array<struct<kind:string,text:string,ref:string,units:double>>"))
    body = F.array_join(
        F.transform(
            parts,
            lambda p: F.when(_kind(p) == "text", escape(p["text"])).otherwise(
                F.concat(F.lit("<|"), escape(_kind(p)), F.lit("|>"))
            ),
        ),
        "",
    )
    attachments = F.transform(
        F.filter(parts, lambda p: _kind(p) != "text"),
        lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")),
    )
    return body, attachments


def format_chats(
    messages: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: ``conv, formatted, spans, attachments, expanded_tokens``.

    ``spans`` has, per turn and in code points of ``formatted``, where the turn starts and the half-open range of
    its body that the loss covers (empty unless the role is in ``loss_roles``). Turns are rendered row by row
    before the only exchange, which is on the conversation; a conversation's own text is all that meets in a task.
    """
    body, attachments = flatten_parts(F.col(parts))
    role_text = F.coalesce(F.col(role), F.lit(""))
    turns = messages.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        role_text.alias("role"),
        body.alias("body"),
        attachments.alias("attachments"),
    ).withColumn("head", F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n")))
    rendered = turns.select(
        "conv",
        F.struct(
            "turn",
            "role",
            F.concat("head", "body", F.lit(END)).alias("segment"),
            F.char_length("head").cast("long").alias("head_len"),
            F.char_length("body").cast("long").alias("body_len"),
            "attachments",
        ).alias("t"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("t.turn").asc_nulls_first(), "t.role", "t.segment")
    length = F.col("t.head_len") + F.col("t.body_len") + len(END)
    rank = F.row_number().over(order)
    start = F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - length
    placed = rendered.select("conv", "t", rank.alias("rank"), start.alias("start"))
    loss_start = F.col("start") + F.col("t.head_len")
    grouped = placed.groupBy("conv").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "rank",
                    F.col("t.segment").alias("segment"),
                    F.struct(
                        "start",
                        loss_start.alias("loss_start"),
                        F.when(F.col("t.role").isin(*loss_roles), loss_start + F.col("t.body_len"))
                        .otherwise(loss_start)
                        .alias("loss_end"),
                    ).alias("span"),
                    F.col("t.attachments").alias("attachments"),
                )
            ),
            lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0),
        ).alias("turns")
    )
    found = F.flatten(F.transform("turns", lambda t: t["attachments"]))
    return grouped.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"),
        F.transform("turns", lambda t: t["span"]).alias("spans"),
        found.alias("attachments"),
        F.aggregate(found, F.lit(0).cast("long"), lambda total, a: total + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns array<struct<role, text, loss>>``, parsed from ``formatted`` and ``spans`` alone.

    ``loss`` is the unescaped text that the turn's loss range covers.
    """
    pieces = F.split(F.col("formatted"), r"<\|im_end\|>\n", -1)
    raw = F.slice(pieces, 1, F.size(pieces) - 1)
    opened = F.transform(raw, lambda s: F.substring_index(F.substr(s, F.lit(len(START) + 1)), "\n", 1))

    def parsed(both: Column) -> Column:
        segment, role, span = both["segment"], both["role"], both["span"]
        text = F.substr(segment, F.lit(len(START) + 2) + F.char_length(role))
        first = (span["loss_start"] - span["start"] + 1).cast("int")
        size = (span["loss_end"] - span["loss_start"]).cast("int")
        return F.struct(
            unescape(F.replace(role, F.lit("&#10;"), F.lit("\n"))).alias("role"),
            unescape(text).alias("text"),
            unescape(F.substr(segment, first, size)).alias("loss"),
        )

    zipped = F.arrays_zip(raw.alias("segment"), opened.alias("role"), F.col("spans").alias("span"))
    return formatted.withColumn("zipped", zipped).withColumn("turns", F.transform("zipped", parsed)).drop("zipped")


def digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the contract asks of a formatted conversation, read back from it."""
    back = read_back(formatted).select(
        conv,
        F.col("turns"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.array_join(F.transform("turns", lambda t: t["loss"]), "").alias("loss_text"),
        "expanded_tokens",
        F.size("attachments").cast("long").alias("n_attachments"),
    )
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_attachments",
        "expanded_tokens",
    )
