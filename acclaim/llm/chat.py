"""Chat formatting from a declarative template, with a state machine over roles and per-segment loss flags.

Everything is DataFrame functions.  A conversation becomes segments (text, loss); their
concatenation is the training text.  Control strings of the template cannot occur inside a turn's
text: backslashes are doubled, then a single backslash goes behind the first character of every
control string, and reading back undoes both.

Defined results: rows are ordered by (turn, role, text), nulls first; repeated rows are turns of
their own; null texts and roles count as empty; roles the template does not know are written with
their name and make the conversation invalid; a null conv_id is one conversation; extra columns are
ignored; an empty table gives no rows.  A conversation is one row, so it is gathered whole; nothing
larger is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """How turns are written, which of them count for the loss, and which role may follow which."""

    begin: str = "<s>"
    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("[SYS]", "[/SYS]"),
        "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("[OUT]", "</s>", loss=True),
    })
    #: around the name, and after the text, of any other role
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    #: (state, role) pairs that may follow each other; the state is the last role
    moves: tuple[tuple[str, str], ...] = (
        ("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"),
    )
    final: tuple[str, ...] = ("user", "assistant")

    @property
    def controls(self) -> list[str]:
        marks = [self.begin, *self.other] + [m for t in self.turns.values() for m in (t.open, t.close)]
        return list(dict.fromkeys(m for m in marks if m))


TEMPLATE = Template()


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.controls:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    out = text
    for mark in template.controls:
        out = F.replace(out, F.lit(f"{mark[0]}\\{mark[1:]}"), F.lit(mark))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def _segment(text: Column, loss: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(loss).alias("loss"))


def turn_segments(role: Column, text: Column, template: Template = TEMPLATE) -> Column:
    """The segments of one turn."""
    head, name_end, tail = template.other
    body = escape(text, template)
    out = F.array(_segment(F.concat(F.lit(head), escape(role, template), F.lit(name_end)), False), _segment(body, False), _segment(F.lit(tail), False))
    for name, turn in template.turns.items():
        own = F.array(_segment(F.lit(turn.open), False), _segment(body, turn.loss), _segment(F.lit(turn.close), False))
        out = F.when(role == name, own).otherwise(out)
    return out


def format_conversations(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, valid (the state machine accepts the order of roles), segments (text, loss)."""
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    allowed = F.array(*[F.lit(f"{state}>{role}") for state, role in template.moves])
    state = F.aggregate(
        "turns", F.lit(""),
        lambda at, t: F.when(F.array_contains(allowed, F.concat(at, F.lit(">"), t["role"])), t["role"]).otherwise(F.lit("invalid")),
    )
    segments = F.concat(
        F.array(_segment(F.lit(template.begin), False)),
        F.flatten(F.transform("turns", lambda t: turn_segments(t["role"], t["text"], template))),
    )
    return turns.select("conv_id", state.isin(*template.final).alias("valid"), segments.alias("segments"))


def training_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns (role, text) of a formatted conversation, as they were before formatting."""
    head, name_end, tail = map(re.escape, template.other)
    opens = "|".join([*(re.escape(t.open) for t in template.turns.values()), f"{head}.*?{name_end}"])
    closes = "|".join([*(re.escape(t.close) for t in template.turns.values()), tail])
    pattern = F.lit(f"(?s)({opens})(.*?)({closes})")

    def role(mark: Column) -> Column:
        first, last = len(template.other[0]), len(template.other[1])
        out = unescape(F.substring(mark, F.lit(first + 1), F.length(mark) - first - last), template)
        for name, turn in template.turns.items():
            out = F.when(mark == turn.open, F.lit(name)).otherwise(out)
        return out

    return F.arrays_zip(
        F.transform(F.regexp_extract_all(formatted, pattern, 1), role).alias("role"),
        F.transform(F.regexp_extract_all(formatted, pattern, 2), lambda t: unescape(t, template)).alias("text"),
    )


def loss_text(segments: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
