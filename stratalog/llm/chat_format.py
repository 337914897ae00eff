"""Chat formatting from a declarative template: a finite-state machine over roles, text segments, loss flags.

The machine's states are `start`, the roles that the template names, and OTHER for all other roles.  Each turn moves it to
the state of its role; the state decides whether the turn's text is under the loss mask, and a move that the template does
not list makes the conversation invalid from that turn on.  DataFrame functions only.  Texts and roles are escaped so that none of the template's control strings occurs in them;
unescape() gives them back, and parse() reads the turns from the formatted text alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


START, OTHER = "start", "other role"


@dataclass(frozen=True)
class Template:
    """Marks around role and text of a turn, states under the loss mask, the states that may follow each state, and those
    in which a conversation may end."""

    begin: str = "<|im_start|>"
    between: str = "<|im_sep|>"
    end: str = "<|im_end|>\n"
    loss: tuple[str, ...] = ("assistant",)
    #: Further strings that tokenizers take for control tokens; none may occur in a formatted text.
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    follow: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    @property
    def states(self) -> list[str]:
        """The roles that the machine knows."""
        return sorted(
            {*self.loss, *self.final, *self.follow, *(r for to in self.follow.values() for r in to)} - {START}
        )

    @property
    def controls(self) -> list[str]:
        return list(dict.fromkeys(c.strip() for c in (self.begin, self.between, self.end, *self.reserved)))


def escape(text: Column, template: Template) -> Column:
    r"""Puts a backslash behind each backslash and behind the first character of each control string."""
    marks = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)
    return F.regexp_replace(text, rf"\\|{marks}", "$0\\\\")


def unescape(text: Column, template: Template) -> Column:
    heads = "".join(sorted({re.escape(c[0]) for c in template.controls}))
    return F.regexp_replace(text, rf"([\\{heads}])\\", "$1")


def moves(turns: Column, template: Template) -> Column:
    """The machine's run over turns (an array of structs with a role): for each turn the state it comes from, the state it
    goes to, whether the template allows that move, and whether the text is under the loss mask."""
    t = template
    state = lambda role: F.when(role.isin(*t.states), role).otherwise(F.lit(OTHER))

    def move(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(START)).otherwise(state(F.get(turns, i - 1)["role"]))
        after = state(x["role"])
        allowed = F.lit(False)
        for name, roles in t.follow.items():
            if roles:
                allowed |= (before == name) & after.isin(*roles)
        return F.struct(
            before.alias("before"), after.alias("after"), allowed.alias("allowed"), after.isin(*t.loss).alias("loss"),
        )

    return F.transform(turns, move)


def format_turns(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation: conv_id, segments (array of text, loss), text (all segments joined), n_turns, valid, first_bad.

    Rows are taken by turn (null turns first; equal turns by role, then text).  Null roles and texts are empty.  `valid`
    says whether the machine accepts every move and the end; `first_bad` is the number (from 0) of the first turn that it
    doesn't accept, n_turns if only the end is wrong, null if valid.  Invalid conversations are formatted alike, so that
    nothing is lost.  Rows with a null conv_id are one conversation; repeated rows are turns of their own; further columns
    are left out; an empty table has no conversations.  A conversation's turns come together in one row, as its text is
    one value: its length bounds the memory, as any row's does.
    """
    t = template or Template()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rows = rows.withColumn("run", moves(F.col("turns"), t)).withColumn("n_turns", F.size("turns").cast("long"))
    mark = lambda s: F.struct(F.lit(s).alias("text"), F.lit(False).alias("loss"))

    def emit(x: Column, move: Column) -> Column:
        """The segments that a move puts out; the state it goes to decides the loss flag."""
        return F.array(
            mark(t.begin), F.struct(escape(x["role"], t).alias("text"), F.lit(False).alias("loss")), mark(t.between),
            F.struct(escape(x["text"], t).alias("text"), move["loss"].alias("loss")), mark(t.end),
        )

    wrong = F.array_position(F.col("run.allowed"), False)
    ended = F.element_at("run", -1)["after"].isin(*t.final)
    first_bad = F.when(wrong > 0, wrong - 1).when(~ended, F.col("n_turns"))
    rows = rows.select(
        "conv_id", F.flatten(F.zip_with("turns", "run", emit)).alias("segments"), "n_turns",
        first_bad.isNull().alias("valid"), first_bad.cast("long").alias("first_bad"),
    )
    return rows.withColumn("text", F.array_join(F.col("segments.text"), ""))


def parse(text: Column, template: Template | None = None) -> Column:
    """The turns (array of role, text) that a formatted text holds."""
    t = template or Template()
    pieces = F.filter(F.split(text, re.escape(t.end), -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        at = F.locate(t.between, x)
        return F.struct(
            unescape(F.substring(x, F.lit(len(t.begin) + 1), at - len(t.begin) - 1), t).alias("role"),
            unescape(F.substring(x, at + len(t.between), F.length(x)), t).alias("text"),
        )

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template or Template())), "",
    )
