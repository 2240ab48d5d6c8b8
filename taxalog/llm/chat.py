"""Chat formatting (operator 5), with DataFrame functions only.

A log of events is partitioned by conversation and message, sorted by sequence and
folded: deltas are appended, an edit replaces what is there, a regeneration starts
anew. The final messages are rendered with a template whose control strings are
escaped inside texts, and can be parsed back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is BEGIN role HEAD text END.
BEGIN, HEAD, END = "<s>[INST]", "[/INST]", "</s>"
#: First character of a control string; a backslash behind it breaks the string up.
_CONTROL = r"(\\|<(?=/?s>)|\[(?=/?INST\]))"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: a backslash goes, and one that follows it stays."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """``conv_id``, ``message``, ``role``, ``text`` from events (conv_id, message, seq, kind, role, text).

    Kinds: ``start`` (names the role, empties), ``delta`` (appends), ``edit``
    (replaces), ``regenerate`` (empties), ``delete`` (the message goes, unless a
    later event writes it anew). Of events with equal seq the order is by kind and
    text. Null texts are empty; unknown or null kinds do nothing. Messages without
    any role get null. A null conv_id or message is a conversation or message of
    its own. Groups are single messages, so a conversation with a third of all
    rows is spread out.
    """
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    log = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))
    resets = F.transform("log", lambda e, k: F.when(e["kind"].isin("start", "edit", "regenerate", "delete"), k))
    since = F.coalesce(F.array_max(resets), F.lit(0))
    tail = F.filter("log", lambda e, k: (k >= F.col("since")) & e["kind"].isin("delta", "edit"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    last = F.filter("log", lambda e: e["kind"].isin("start", "delta", "edit", "regenerate", "delete"))
    return (log.withColumn("since", since)
            .select("conv_id", "message", F.get(roles, F.lit(0)).alias("role"),
                    F.array_join(F.transform(tail, lambda e: e["text"]), "").alias("text"),
                    F.coalesce(F.try_element_at(F.transform(last, lambda e: e["kind"]), F.lit(-1)) == "delete", F.lit(False)).alias("gone"))
            .where("NOT gone").drop("gone"))


def render(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, ``loss``: one row per conversation, messages in order.

    ``loss`` marks what is trained on: (turn, start, length) in code points, counted
    from the turn's first character. Null roles and texts are empty. Messages with
    the same number are ordered by role and text. Escaping and lengths are worked
    out per message; a conversation meets in one row only as its own output.
    """
    role, text = (escape(F.coalesce(c, F.lit(""))) for c in ("role", "text"))
    head = F.concat(F.lit(BEGIN), role, F.lit(HEAD))
    turn = F.struct("message", "role", F.concat(head, text, F.lit(END)).alias("turn"),
                    F.when(F.col("role") == TRAINED, F.struct(F.char_length(head).alias("start"), F.char_length(text).alias("length"))).alias("mask"))
    rows = messages.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    masks = F.transform("turns", lambda t, k: F.when(t["mask"].isNotNull(), F.struct(
        k.alias("turn"), t["mask"]["start"].alias("start"), t["mask"]["length"].alias("length"))))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
                       F.filter(masks, lambda m: m.isNotNull()).alias("loss"))


def pieces(formatted: Column) -> Column:
    """The turns of a formatted conversation, each with its control strings."""
    return F.filter(F.split(formatted, r"(?=<s>\[INST\])"), lambda t: t != "")


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    def turn(piece):
        head = F.instr(piece, F.lit(HEAD))
        role = F.substring(piece, F.lit(len(BEGIN) + 1), head - len(BEGIN) - 1)
        text = F.substring(piece, head + len(HEAD), F.char_length(piece) - head - len(HEAD) - len(END) + 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))
    return F.transform(pieces(formatted), turn)


def trained_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    def masked(turns):
        return F.transform(loss, lambda m: unescape(F.substring(F.get(turns, m["turn"]), m["start"] + 1, m["length"])))
    return F.array_join(F.flatten(F.transform(F.array(pieces(formatted)), masked)), "")
