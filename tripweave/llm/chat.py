"""Chat formatting from an event log: fold the events of a conversation, then render its turns.

Events are rows (conversation, sequence, kind, message, role, text). A `message` event opens a
message; a `delta` appends its text; an `edit` replaces the text; a `regenerate` clears it for the
deltas that follow. The last three name a message, or, where the name is null, mean the message
opened last. An event whose message was never opened has no effect. Null text counts as empty, null
role as an empty role. Events of equal sequence follow in order of kind, message, role and text
(`message` first), repeated rows each count. A null conversation is one conversation of its own.

A turn is rendered as `<s>[INST] role [/INST]`, a line break, the text, a line break and `</s>`.
Control strings inside roles and texts get a backslash in front, and reading takes one backslash
away before each, so any text is given back exactly; a marker never follows a backslash. The loss
mask holds the spans (first code point, length) of the assistants' escaped texts.

Each conversation becomes one row, so its events meet in one task; conversations are not combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = r"(</s>|<s>|\[INST\]|\[/INST\])"
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]\n", "\n</s>"
KINDS = ("message", "regenerate", "edit", "delta")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, number, role, text) of events with the columns named above.

    Input columns: conv_id, seq, kind, message_id, role, text.
    """
    rank = F.coalesce(
        *[F.when(F.col("kind") == kind, F.lit(i)) for i, kind in enumerate(KINDS)],
        F.lit(len(KINDS)),
    )
    order = Window.partitionBy("conv_id").orderBy("seq", "rank", "message_id", "role", "text")
    opens = F.col("kind") == "message"
    named = Window.partitionBy("conv_id", "message_id")
    sorted_events = (
        events.select(
            "conv_id", "seq", "kind", "message_id", "role", rank.alias("rank"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .withColumn("place", F.row_number().over(order))
        .withColumn("opened", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("first_named", F.min(F.when(opens, F.col("opened"))).over(named))
        .withColumn(
            "number",
            F.when(opens | F.col("message_id").isNull(), F.col("opened")).otherwise(F.col("first_named")),
        )
        .where("number > 0")
    )
    message = Window.partitionBy("conv_id", "number")
    restarts = F.col("kind").isin("message", "edit", "regenerate")
    live = sorted_events.withColumn("from", F.max(F.when(restarts, F.col("place"))).over(message))
    pieces = F.sort_array(
        F.collect_list(F.when(F.col("place") >= F.col("from"), F.struct("place", "text")))
    )
    return live.groupBy("conv_id", "number").agg(
        F.coalesce(F.max(F.when(opens, F.col("role"))), F.lit("")).alias("role"),
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of first code point and length) of final messages."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE))
    turns = messages.select(
        "conv_id",
        "number",
        (F.col("role") == loss_role).alias("learned"),
        head.alias("head"),
        escaped(F.col("text")).alias("body"),
    ).withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    before = (
        Window.partitionBy("conv_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    placed = turns.withColumn(
        "span", F.when(F.col("learned"), F.struct(start.alias("start"), F.length("body").alias("length")))
    )
    gathered = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("number", "piece", "span"))).alias("turns")
    )
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def parsed(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    pieces = F.split(formatted, r"\n</s>")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        middle = F.instr(piece, MIDDLE)
        return F.struct(
            unescaped(F.substring(piece, len(OPEN) + 1, middle - 1 - len(OPEN))).alias("role"),
            unescaped(F.substring(piece, middle + len(MIDDLE), 2_000_000_000)).alias("text"),
        )

    return F.transform(pieces, turn)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(
            spans, lambda s: unescaped(F.substring(formatted, s["start"].cast("int") + 1, s["length"]))
        ),
        "",
    )


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    return render(fold_events(events), loss_role)
