"""Conversations as training text under a declarative template, in DataFrame functions alone.

A finite-state machine over roles, whose state is the role before, checks the order of
turns. Every turn becomes its opening, its escaped text and its closing; texts carry a
loss flag. Control strings inside texts are escaped by a backslash after their first
character, so the output can be read back without loss.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turns by role, the roles that may begin, follow each other and end.

    A role outside ``turns`` is written out between ``role_open`` and ``role_close`` and
    its turn ends with ``role_end``; it is never under the loss and never in order.
    """

    turns: dict[str, Turn]
    begins: tuple[str, ...]
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    role_open: str = "[ROLE]"
    role_close: str = "[/ROLE]"
    role_end: str = "[/TURN]"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        marks = [s.strip() for t in self.turns.values() for s in (t.open, t.close)]
        marks += [self.role_open, self.role_close, self.role_end]
        object.__setattr__(self, "controls", tuple(dict.fromkeys(marks)))
        heads = {m[:1] for m in marks}
        if "" in heads or any(c in m[1:] for m in marks for c in heads | {"\\"}):
            raise ValueError("control strings must not be empty nor hold a first character or a backslash inside")
        if len({t.open for t in self.turns.values()}) < len(self.turns):
            raise ValueError("two roles open alike")

    def _rests(self, slashes: str, tail: str) -> str:
        by_head: dict[str, list[str]] = {}
        for c in self.controls:
            by_head.setdefault(c[0], []).append(re.escape(c[1:]))
        return "|".join(f"(?<={re.escape(h)}){slashes}(?={tail}(?:{'|'.join(r)}))" for h, r in by_head.items())

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._rests("", r"\\*"), r"\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._rests(r"\\", r"\\*"), "")


#: The default: system, user and assistant turns in brackets, the assistant's under the loss.
BRACKETS = Template(
    turns={
        "system": Turn("[SYS] ", " [/SYS]"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("[OUT] ", " </s>", loss=True),
    },
    begins=("system", "user"),
    follows={"system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)


def _by_role(role: Column, values: dict[str, Column], other: Column) -> Column:
    out = F
    for name, value in values.items():
        out = out.when(role == name, value)
    return out.otherwise(other) if values else other


def segments(
    conversations: DataFrame, template: Template = BRACKETS, *, id_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(id_col, n, role, open, body, close, loss, in_order, start): one row per turn, in order from 0.

    ``body`` is the escaped text; ``start`` counts the code points of the formatted
    conversation before the turn; ``in_order`` says whether the machine allows the role
    after the one before. Turns of equal number are ordered by role and text; a null role
    counts as an empty one, a null text as empty, a null turn comes first.
    """
    rows = conversations.select(
        conversations[id_col].alias("id"), conversations[turn_col].alias("t"),
        F.coalesce(conversations[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(conversations[text_col].cast("string"), F.lit("")).alias("text"),
    )
    role, turns = F.col("role"), template.turns
    named = F.concat(F.lit(template.role_open), template.escape(role), F.lit(template.role_close))
    rows = rows.select(
        "id", "t", "role", "text",
        _by_role(role, {r: F.lit(t.open) for r, t in turns.items()}, named).alias("open"),
        template.escape(F.col("text")).alias("body"),
        _by_role(role, {r: F.lit(t.close) for r, t in turns.items()}, F.lit(template.role_end)).alias("close"),
        _by_role(role, {r: F.lit(t.loss) for r, t in turns.items()}, F.lit(False)).alias("loss"),
    )
    order = Win.partitionBy("id").orderBy("t", "role", "text")
    before = F.lag("role").over(order)
    allowed = _by_role(before, {a: role.isin(*b) for a, b in template.follows.items()}, F.lit(False))
    length = F.length("open") + F.length("body") + F.length("close")
    return rows.select(
        F.col("id").alias(id_col),
        (F.row_number().over(order) - 1).alias("n"),
        "role", "open", "body", "close", "loss",
        F.when(before.isNull(), role.isin(*template.begins)).otherwise(allowed).alias("in_order"),
        (F.sum(length.cast("long")).over(order.rowsBetween(Win.unboundedPreceding, 0)) - length).alias("start"),
    )


def formatted(conversations: DataFrame, template: Template = BRACKETS, *, id_col: str = "conv_id", **columns: str) -> DataFrame:
    """(id_col, formatted, loss_spans, valid, first_bad): one row per conversation.

    ``loss_spans`` are the (start, length) of the texts under the loss, in code points of
    ``formatted``; ``valid`` says that the machine accepts all turns and ends rightly;
    ``first_bad`` is the first turn it does not accept, from 0, else null.
    A conversation is one training text and thus one row; a null id is a conversation of
    its own, and an empty table has none. Other columns are not looked at.
    """
    rows = segments(conversations, template, id_col=id_col, **columns)
    span = F.struct((F.col("start") + F.length("open")).alias("start"), F.length("body").alias("length"))
    parts = rows.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("n", F.concat("open", "body", "close").alias("text")))).alias("parts"),
        F.sort_array(F.collect_list(F.when(F.col("loss"), span))).alias("loss_spans"),
        (F.bool_and("in_order") & F.max_by("role", "n").isin(*template.ends)).alias("valid"),
        F.min(F.when(~F.col("in_order"), F.col("n"))).alias("first_bad"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return parts.select(id_col, text.alias("formatted"), "loss_spans", "valid", "first_bad")


def read_back(text: Column, template: Template = BRACKETS) -> Column:
    """The turns (role, text) of a formatted conversation."""
    closed = [rf"{re.escape(t.open)}.*?{re.escape(t.close)}" for t in template.turns.values()]
    closed.append(rf"{re.escape(template.role_open)}.*?{re.escape(template.role_end)}")
    found = F.regexp_extract_all(text, F.lit("(?s)" + "|".join(closed)), F.lit(0))

    def turn(m: Column) -> Column:
        at = F.instr(m, template.role_close)
        begin = F.length(F.lit(template.role_open)) + 1
        after = at + len(template.role_close)
        role = F.substr(m, begin, at - begin)
        body = F.substr(m, after, F.length(m) - len(template.role_end) - after + 1)
        own = {r: (m.startswith(t.open), t) for r, t in template.turns.items()}
        for r, (here, t) in own.items():
            role = F.when(here, r).otherwise(role)
            body = F.when(here, F.substr(m, F.lit(len(t.open) + 1), F.length(m) - len(t.open) - len(t.close))).otherwise(body)
        return F.struct(template.unescape(role).alias("role"), template.unescape(body).alias("text"))

    return F.transform(found, turn)


def under_loss(text: Column, spans: Column, template: Template = BRACKETS) -> Column:
    """The unescaped texts under the loss, one after the other."""
    return F.array_join(
        F.transform(spans, lambda s: template.unescape(F.substr(text, (s["start"] + 1).cast("int"), s["length"]))), ""
    )
