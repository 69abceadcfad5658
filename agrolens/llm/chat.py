"""Operator 13: conversations as marked-up text with a loss mask, by Spark expressions only.

Turns are collected per conversation as structs and sorted; neighbours of one
role are merged into one block by array functions; blocks are concatenated:

    <|im_start|>role\\ntext<|im_sep|>text of the next turn of the same role<|im_end|>\\n

The result is a list of segments (text, loss): the text under the loss mask is
exactly the turns of the loss roles, marks are outside.  The formatted text is
all segments' text, one after the other.

Control strings inside texts are escaped reversibly: a backslash goes behind
the first character, and if backslashes are there already, one more.  So a
text holds no control string, and ``read_turns`` gives back every turn.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a format, and further strings that must not occur inside texts."""
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    sep: str = "<|im_sep|>"
    others: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = field(default=("assistant",))

    def __post_init__(self):
        heads = {c[0] for c in self.controls}
        if "\\" in heads or any(x in c[1:] for c in self.controls for x in [*heads, "\\"]) or any(len(c) < 2 for c in self.controls):
            raise ValueError("no control string may hold a backslash or, but at its start, the first character of one")

    @property
    def controls(self) -> tuple[str, ...]:
        return self.start, self.end, self.sep, *self.others

    def patterns(self) -> list[str]:
        """For each first character a regular expression (head and backslashes, rest) of its control strings."""
        heads: dict[str, list[str]] = {}
        for c in self.controls:
            heads.setdefault(c[0], []).append(re.escape(c[1:]))
        return [f"({re.escape(h)}\\\\*)({'|'.join(rest)})" for h, rest in heads.items()]


CHAT = Template()


def escaped(text: Column, template: Template = CHAT) -> Column:
    """``text`` without control strings; ``unescaped`` gives it back."""
    for p in template.patterns():
        text = F.regexp_replace(text, p, r"$1\\$2")
    return text


def unescaped(text: Column, template: Template = CHAT) -> Column:
    for p in template.patterns():
        text = F.regexp_replace(text, p.replace(r"\\*)", r"\\*)\\", 1), "$1$2")
    return text


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(turns: Column) -> Column:
    """Neighbouring turns of one role merged: array of (role, texts)."""
    def merged(t: Column) -> Column:
        role = lambda i: F.get(t, i)["role"]
        at = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
        return _let(at, lambda s: F.transform(s, lambda begin, k: F.struct(
            role(begin).alias("role"),
            F.transform(F.slice(t, begin + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - begin), lambda x: x["text"]).alias("texts"))))
    return _let(turns, merged)


def _segments(runs: Column, template: Template) -> Column:
    """Segments (text, loss) of merged runs."""
    def piece(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def block(r: Column) -> Column:
        head = F.concat(F.lit(template.start), F.url_encode(r["role"]), F.lit("\n"))
        tail, sep = F.lit(template.end + "\n"), F.lit(template.sep)
        trained = F.concat(
            F.array(piece(head, False)),
            F.flatten(F.transform(r["texts"], lambda x, i: F.when(i == 0, F.array(piece(x, True))).otherwise(F.array(piece(sep, False), piece(x, True))))),
            F.array(piece(tail, False)))
        return F.when(r["role"].isin(list(template.loss_roles)), trained).otherwise(
            F.array(piece(F.concat(head, F.array_join(r["texts"], template.sep), tail), False)))
    return F.flatten(F.transform(runs, block))


def format_chat(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                template: Template = CHAT) -> DataFrame:
    """(conv_id, segments array<struct<text, loss>>), one row for each conversation.

    Turns are in order of ``turn`` (null last; ties by role, then text).  Null
    texts are empty; a null role is the empty role; null ids are one
    conversation.  Repeated rows are turns of their own.  Roles are written
    percent-encoded, so any role can be read back.  Other columns are not read.
    An empty table gives no row.  A conversation is one row of the result, so
    it must fit a task, as its formatted text must.
    """
    col = lambda c: F.col(f"`{c}`")
    turns = conversations.select(col(conv_id).alias("conv_id"), F.struct(
        col(turn).isNull().alias("late"), col(turn).alias("turn"), F.coalesce(col(role).cast("string"), F.lit("")).alias("role"),
        escaped(F.coalesce(col(text), F.lit("")), template).alias("text")).alias("t"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return sorted_turns.select("conv_id", _segments(_runs(F.col("turns")), template).alias("segments"))


def full_text(segments: Column) -> Column:
    """The formatted conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    def block(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        # the mark of the end is the last one: texts hold none
        body = F.substring_index(F.substring(b, F.char_length(role) + 2, F.char_length(b)), template.end, 1)
        return _let(F.url_decode(role), lambda r: F.transform(
            F.split(body, re.escape(template.sep)), lambda x: F.struct(r.alias("role"), unescaped(x, template).alias("text"))))
    blocks = F.filter(F.split(formatted, re.escape(template.start)), lambda b, i: i > 0)  # nothing stands before the first mark
    return F.flatten(F.transform(blocks, block))


def read_loss(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def chat_digests(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """What ``format_chat`` wrote, read back: turns and text under the loss mask, as counts and digests."""
    read = formatted.select("conv_id", full_text(F.col("segments")).alias("whole"), read_loss(F.col("segments"), template).alias("loss"))
    read = read.select("*", read_turns(F.col("whole"), template).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.char_length("whole").cast("long").alias("formatted_chars"))
