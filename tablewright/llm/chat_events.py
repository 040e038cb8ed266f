"""Chat formatting by event sourcing, in DataFrame functions only.

A log holds events of conversations: a message begins, deltas stream in, edits replace, a regeneration starts over. The
log is partitioned by conversation, ordered by sequence number and folded into final messages; these are rendered under a
template with a loss mask, and can be read back from the rendered text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Event kinds. All but ``delta`` start the text of their message anew.
MESSAGE, DELTA, EDIT, REGENERATE, DELETE = "message", "delta", "edit", "regenerate", "delete"


@dataclass(frozen=True)
class Template:
    """Marks around a turn: ``turn`` role ``text`` body ``end``. The backslash escapes marks inside roles and bodies."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = (self.turn, self.text, self.end)
        if len(set(marks)) < 3 or any(len(m) < 2 or "\\" in m for m in marks):
            raise ValueError("marks must be three different strings of two characters or more, without backslashes")

    def escape(self, text: Column) -> Column:
        """Double backslashes and break every mark after its first character."""
        doubled = F.regexp_replace(text, r"\\", r"\\\\")
        marks = "|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in (self.turn, self.text, self.end))
        return F.regexp_replace(doubled, f"(?:{marks})", r"$0\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, place, message, role, text) of a log (conv_id, seq, kind, message, role, text).

    ``message`` names a message within its conversation, and stands where its first event stands. Its text is that of
    its last event that is no delta, and of the deltas after it; a message whose last such event deletes it is gone. Its
    role is the last one given. Null text adds nothing, a null role gives an empty one, unknown kinds count as deltas.
    Events with equal numbers are ordered by kind, text and role, so repeated rows give a defined result: a repeated
    delta counts twice. A null ``conv_id`` is a conversation like any other.
    """
    restart = F.col("kind").isin(MESSAGE, EDIT, REGENERATE, DELETE)
    event = F.struct(
        "seq", (~F.coalesce(restart, F.lit(False))).cast("int").alias("later"), "kind",
        F.coalesce("text", F.lit("")).alias("text"), "role",
    )
    logs = (
        events.repartition("conv_id").groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))
        .withColumn("numbered", F.transform("log", lambda e, i: F.when(e["later"] == 0, i + 1).otherwise(0)))
        .withColumn("begin", F.greatest(F.array_max("numbered"), F.lit(1)))
        .withColumn("tail", F.slice("log", F.col("begin"), F.size("log")))
    )
    roles = F.filter("log", lambda e: e["role"].isNotNull())
    return logs.where(~F.coalesce(F.get("tail", F.lit(0))["kind"] == DELETE, F.lit(False))).select(
        "conv_id", F.get("log", F.lit(0))["seq"].alias("place"), "message",
        F.coalesce(F.try_element_at(roles, F.lit(-1))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform("tail", lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, loss) of messages: one text per conversation and the spans that the loss covers.

    A span (start, length, byte_start, byte_length) counts code points and UTF-8 bytes from 0. Lengths are added up
    in a window over the conversation, so the work grows with its length. A conversation is one text and hence one row.
    """
    head = F.concat(F.lit(template.turn), template.escape(F.col("role")), F.lit(template.text))
    parts = messages.select(
        "conv_id", "place", "message", head.alias("head"), template.escape(F.col("text")).alias("body"),
        F.col("role").isin(*template.loss_roles).alias("counts"),
    ).withColumn("segment", F.concat("head", "body", F.lit(template.end)))
    order = Window.partitionBy("conv_id").orderBy("place", "message")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)

    def before(size) -> Column:
        return F.sum(size("segment")).over(upto) - size("segment") + size("head")

    spans = parts.select(
        "conv_id", "place", "message", "segment",
        F.when(
            F.col("counts"),
            F.struct(
                before(F.length).alias("start"), F.length("body").cast("long").alias("length"),
                before(F.octet_length).alias("byte_start"), F.octet_length("body").cast("long").alias("byte_length"),
            ),
        ).alias("span"),
    )
    turns = F.array_sort(F.collect_list(F.struct("place", "message", "segment", "span"))).alias("turns")
    return spans.groupBy("conv_id").agg(turns).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """``formatted`` with ``turns`` (role, text) and ``loss_text``, both taken from the rendered text alone."""
    pieces = F.split("formatted", re.escape(template.turn))
    # Before the first mark there is nothing.
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))
    marks = len(template.end)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, template.text, 1)
        body = F.substring(piece, F.length(role) + F.lit(len(template.text) + 1), F.length(piece))
        return F.struct(
            template.unescape(role).alias("role"),
            template.unescape(F.substring(body, F.lit(1), F.length(body) - F.lit(marks))).alias("text"),
        )

    data = F.col("formatted").cast("binary")
    covered = F.transform(
        "loss",
        lambda s: template.unescape(
            F.substring(data, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")).cast("string")
        ),
    )
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(covered, ""))
