"""Chat formatting by event-sourced reconstruction. DataFrame code only.

An event log (conv_id, seq, kind, turn, role, text) is partitioned by conversation and
sorted by sequence, and folded into final messages:

- delta: appends its text to the turn's message
- edit: replaces the turn's message by its text and discards all later turns so far
- regenerate: empties the turn's message (deltas follow) and discards all later turns

So an event counts unless a later edit or regenerate has its turn or an earlier one: one
pass over the log from its end with a running minimum finds these. A turn's message is
the texts of its events that count, by seq; its role is that of the first of them.

Then conversations are rendered: <|im_start|>role\ntext<|im_end|>\n for each turn. Inside
roles and texts each "<|" becomes "<||", so no control string can arise there, and a line
end inside a role becomes "<|nl|>"; both are undone when reading. Loss spans (start,
length in code points of the formatted text, from 0) cover the assistant's texts.

Defined results: null roles and texts are empty, a null kind is a delta; other kinds are
ignored. Events of equal seq go by turn, kind, role, text. Null conv_ids are one
conversation. Texts are kept whole, however long. Extra columns are ignored. An empty log
gives an empty result. A conversation is one row in the end, as its format demands; conversations are as long as
people make them, and hot contents or very many short ones spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, LINE, ROLE_LINE = "<|im_start|>", "<|im_end|>", "\n", "<|nl|>"
OPEN, ESCAPED = "<|", "<||"
TAIL = len(END + LINE)


def escape(c: Column) -> Column:
    return F.replace(c, F.lit(OPEN), F.lit(ESCAPED))


def unescape(c: Column) -> Column:
    return F.replace(c, F.lit(ESCAPED), F.lit(OPEN))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(LINE), F.lit(ROLE_LINE))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(ROLE_LINE), F.lit(LINE)))


def events_of_turns(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """A log with one event for each row of a table of finished turns (conv_id, turn, role, text)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(order).alias("at"), text("role").alias("role"), text("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "role", "text")).cast("long")
    return rows.select("conv_id", place.alias("seq"), F.lit("delta").alias("kind"), place.alias("turn"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the final messages."""
    kind, text = F.coalesce("kind", F.lit("delta")), F.coalesce("text", F.lit(""))
    log = events.select("conv_id", "seq", kind.alias("kind"), "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    log = log.where(F.col("kind").isin("delta", "edit", "regenerate"))
    back = Window.partitionBy("conv_id").orderBy(F.desc("seq"), F.desc("turn"), F.desc("kind"), F.desc("role"), F.desc("text"))
    later = F.min(F.when(F.col("kind") != "delta", F.col("turn"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    log = log.withColumn("place", F.row_number().over(back)).withColumn("reset", later)
    log = log.where(F.col("reset").isNull() | (F.col("reset") > F.col("turn")))
    log = log.withColumn("text", F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("at"), "role", "text")))
    turns = log.groupBy("conv_id", "turn").agg(parts.alias("parts"))
    return turns.select("conv_id", "turn", F.element_at("parts", 1)["role"].alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans start, length) of each conversation."""
    marked = messages.select(
        "conv_id",
        "turn",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit(LINE)).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("learn"),
    )
    marked = marked.withColumn("head_chars", F.char_length("head")).withColumn("body_chars", F.char_length("body"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("head_chars") + F.col("body_chars") + TAIL).over(before), F.lit(0)) + F.col("head_chars")
    marked = marked.withColumn("start", start)
    span = F.when(F.col("learn"), F.struct(F.col("start").cast("long").alias("start"), F.col("body_chars").cast("long").alias("length")))
    turn = F.struct("turn", F.concat("head", "body", F.lit(END + LINE)).alias("text"), span.alias("span"))
    whole = marked.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    loss = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"), loss.alias("loss"))


def parse(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), learned (the texts under the loss spans, unescaped), formatted of each conversation."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.greatest(F.lit(0), F.size(F.split("formatted", r"<\|im_start\|>")) - 1))

    def turn(piece: Column) -> Column:
        line = F.instr(piece, LINE)
        body = F.substring(piece, line + 1, F.char_length(piece) - line - TAIL)
        return F.struct(unescape_role(F.substring(piece, F.lit(1), line - 1)).alias("role"), unescape(body).alias("text"))

    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", F.transform(pieces, turn).alias("turns"), learned.alias("learned"), "formatted")


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))
