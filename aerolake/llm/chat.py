"""Chat formatting with a finite-state machine over roles and a declarative template.

Everything is an expression on the array of a conversation's turns: the machine is a fold over roles,
segments are a transform, and the text is read back by a split at the closing marks. Control strings
inside texts are escaped reversibly: a backslash is doubled, and one is put after the first character
of anything that reads as a mark, so that no mark can come from a text.

Defined results: a null text or role is an empty one; turns are ordered by (turn, role, text), nulls
first, so that ties and repeated rows have one order; a null conv_id is a conversation of its own; an
empty table gives an empty table; other columns are not read. Turn order breaks are told, not repaired:
``c_first_break`` is the number of the first turn the machine refuses (null if none) and ``c_valid``
says that there is none and that the conversation ends in an accepting state.

A conversation is one text, so its turns meet in one task; nothing else does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marks:
    """What stands before and after a role's text; ``loss``: the text is learnt."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of the known roles; a role without marks is written out between ``named`` marks."""

    roles: dict[str, Marks]
    named: tuple[str, str, str]
    controls: tuple[str, ...]
    moves: dict[str, tuple[str, ...]]
    accepting: tuple[str, ...]
    start: str = field(default="")


#: Marks of instruction dialogues, and which role may follow which.
INSTRUCT = Template(
    roles={"system": Marks("[SYS] ", " [/SYS]"), "user": Marks("[INST] ", " [/INST]"), "assistant": Marks("<s>", "</s>", loss=True)},
    named=("[ROLE]", "[:]", "[/ROLE]"),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[:]", "[/ROLE]"),
    moves={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")},
    accepting=("assistant",),
)


def escape(text: Column, template: Template = INSTRUCT) -> Column:
    marks = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in template.controls)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), marks, "\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _pieces(turn: Column, template: Template) -> tuple[Column, Column, Column, Column]:
    """(before, text, after, loss) of a turn."""
    opened, named, closed = template.named
    before = F.concat(F.lit(opened), escape(turn["role"], template), F.lit(named))
    after, loss = F.lit(closed), F.lit(False)
    for role, marks in template.roles.items():
        same = turn["role"] == role
        before, after, loss = (F.when(same, F.lit(a)).otherwise(b) for a, b in ((marks.before, before), (marks.after, after), (marks.loss, loss)))
    return before, escape(turn["text"], template), after, loss


def segments(turns: Column, template: Template = INSTRUCT) -> Column:
    def of(turn: Column) -> Column:
        before, text, after, loss = _pieces(turn, template)
        return F.array(F.struct(before.alias("text"), F.lit(False).alias("loss")), F.struct(text.alias("text"), loss.alias("loss")),
                       F.struct(after.alias("text"), F.lit(False).alias("loss")))

    return F.flatten(F.transform(turns, of))


def machine(turns: Column, template: Template = INSTRUCT) -> Column:
    """struct(state, seen, first_break) after all turns; a refused turn still sets the state to its role."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, row in template.moves.items() for b in row])
    start = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("first_break"))

    def step(acc: Column, turn: Column) -> Column:
        good = F.array_contains(allowed, F.concat(acc["state"], F.lit(">"), turn["role"]))
        broken = F.coalesce(acc["first_break"], F.when(~good, acc["seen"]))
        return F.struct(turn["role"].alias("state"), (acc["seen"] + 1).alias("seen"), broken.alias("first_break"))

    return F.aggregate(turns, start, step)


def format_chats(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, c_segments, c_text, c_valid, c_first_break), a row per conversation."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    made = turns.select("conv_id", segments(F.col("turns"), template).alias("c_segments"), machine(F.col("turns"), template).alias("m"))
    text = F.array_join(F.transform("c_segments", lambda s: s["text"]), "")
    valid = F.col("m.first_break").isNull() & F.col("m.state").isin(list(template.accepting))
    return made.select("conv_id", "c_segments", text.alias("c_text"), valid.alias("c_valid"), F.col("m.first_break").alias("c_first_break"))


def parse_chat(text: Column, template: Template = INSTRUCT) -> Column:
    """The turns of a formatted text as array<struct<role, text>>."""
    ends = [m.after for m in template.roles.values()] + [template.named[2]]
    pieces = F.split(text, "|".join(map(re.escape, ends)), -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    opened, named, _ = template.named

    def of(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(opened) + 1), F.length(piece))
        role = F.substring_index(inner, named, 1)
        said = F.substring(inner, F.length(role) + F.lit(len(named) + 1), F.length(inner))
        for name, marks in template.roles.items():
            same = F.startswith(piece, F.lit(marks.before))
            role = F.when(same, F.lit(name)).otherwise(role)
            said = F.when(same, F.substring(piece, F.lit(len(marks.before) + 1), F.length(piece))).otherwise(said)
        return F.struct(unescape(role).alias("role"), unescape(said).alias("text"))

    return F.transform(pieces, of)


def learnt_text(made: Column) -> Column:
    """All texts under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(made, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
