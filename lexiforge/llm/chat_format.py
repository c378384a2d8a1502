"""Chat formatting with DataFrame functions only.

A declarative :class:`Template` turns the rows of a conversation into text segments,
each with a loss flag; a finite-state machine over the roles checks the order of
turns.  Control strings inside texts are escaped by what the template says: a backslash
becomes two, and the first two characters of a start or end mark get a backslash between
them, so no text can forge a mark and :func:`parse` restores every text exactly.  In a
role, what ends a role is escaped too.  A template whose marks cannot be told apart that
way is refused.

Defined cases.  Null text: empty.  Null role: an empty role, which no state accepts.
Rows of a conversation are ordered by turn, then role, then text (null turns first);
repeated rows are repeated turns; rows that tie in all three are alike.  A row with a null
conv_id is a conversation by itself.  Texts are kept whole, whatever their length.  An
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    after_turn: str = "\n"
    #: Roles whose texts are learnt.
    learnt: tuple[str, ...] = ("assistant",)
    #: From a state and a role to the next state; other turns are out of order.
    moves: dict = field(default_factory=lambda: {("begin", "system"): "system", ("begin", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    #: States in which a conversation may end.
    final: tuple[str, ...] = ("assistant", "user")

    def __post_init__(self):
        closed = self.end + self.after_turn
        for mark in (self.start, self.end):
            if len(mark) < 2 or "\\" in mark:
                raise ValueError("a start or end mark needs two characters, none of them a backslash")
        if not self.after_role or "\\" in self.after_role + self.after_turn:
            raise ValueError("what ends a role must not be empty, and no backslash may follow a mark")
        # A text's end and the beginning of an end mark must not look like one; likewise for roles.
        for mark in (closed, self.after_role):
            if any(mark[:k] == mark[-k:] for k in range(1, len(mark))):
                raise ValueError("a mark must not end as it begins")
        # Nor must what stands before a role or a text complete one with it.
        for before in (self.start, self.after_role):
            if any(before[-k:] == closed[:k] for k in range(1, len(before) + 1)) or before.startswith(closed[1 : 1 + len(before)]):
                raise ValueError("a mark must not begin as the end mark goes on")

    @property
    def openers(self) -> list[str]:
        """The first two characters of each mark."""
        return sorted({self.start[:2], self.end[:2]})

    @property
    def role_code(self) -> str:
        """The letter that stands, after a backslash, for what ends a role."""
        taken = {o[1] for o in self.openers} | set(self.after_role)
        return next(c for c in string.ascii_lowercase[13:] + string.ascii_uppercase if c not in taken)


def escape(text: Column, template: Template = Template()) -> Column:
    """Doubled backslashes, and one between the first two characters of a mark."""
    inside = "|".join(f"(?<={re.escape(a)})(?={re.escape(b)})" for a, b in template.openers)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), inside, "\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column, template: Template = Template()) -> Column:
    return F.replace(escape(role, template), F.lit(template.after_role), F.lit("\\" + template.role_code))


def unescape_role(role: Column, template: Template = Template()) -> Column:
    # Between doubled backslashes, a backslash and the code's letter can only be the code.
    code = F.lit("\\" + template.role_code)
    part = lambda x: unescape(F.replace(x, code, F.lit(template.after_role)))
    return F.array_join(F.transform(F.split(role, r"\\\\"), part), "\\")


def _state(roles: Column, t: Template) -> Column:
    """The machine's state after all roles ("error" once a move is missing)."""

    def step(state, role):
        out = F.lit("error")
        for (was, said), then in t.moves.items():
            out = F.when((state == was) & (role == said), F.lit(then)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit("begin"), step)


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>, n_turns, valid.

    ``formatted`` is the segments' texts one after the other.
    """
    t = template
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row"))
    # One conversation is one output row by nature; its turns meet in that row only.
    chats = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    chats = chats.union(rows.filter("conv_id IS NULL").select("conv_id", F.array("row").alias("rows")))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = lambda r: F.array(
        segment(F.concat(F.lit(t.start), escape_role(r["role"], t), F.lit(t.after_role)), F.lit(False)),
        segment(escape(r["text"], t), r["role"].isin(*t.learnt)),
        segment(F.lit(t.end + t.after_turn), F.lit(False)),
    )
    chats = chats.withColumn("segments", F.flatten(F.transform("rows", parts)))
    state = _state(F.transform("rows", lambda r: r["role"]), t)
    return chats.select("conv_id", F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"), "segments", F.size("rows").cast("long").alias("n_turns"), state.isin(*t.final).alias("valid"))


def parse(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    t = template
    closed = t.end + t.after_turn
    # Every turn ends with the end mark; escaped texts cannot hold it.
    body = F.split(formatted, _literal(closed))
    body = F.slice(body, 1, F.size(body) - 1)

    def turn(x):
        x = F.substring(x, F.lit(len(t.start) + 1), F.length(x))
        at = F.locate(t.after_role, x)
        return F.struct(unescape_role(F.substring(x, F.lit(1), at - 1), t).alias("role"), unescape(F.substring(x, at + len(t.after_role), F.length(x))).alias("text"))

    return F.transform(body, turn)


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def chat_digest(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """What formatted conversations hold, read back from their text and loss flags."""
    back = chats.withColumn("back", parse(F.col("formatted"), template))
    said = F.concat_ws("", F.transform("back", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))))
    learnt = F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])))
    back = back.select("conv_id", F.size("back").cast("long").alias("n_turns"), said.alias("said"), learnt.alias("learnt"), "valid", F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars", "valid")
