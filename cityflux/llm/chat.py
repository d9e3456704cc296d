"""Chat formatting: turns of a conversation as one text with control strings, and the way back.

Turns are sorted as structs, adjacent turns of one role become one block, and the pieces are joined;
all of it in array functions of the engine.

    [INST] role [/INST] text {[MORE] text} </s>        (without the blanks), one block after another

Control strings inside roles and texts are escaped by one backslash after their first character;
one that already has backslashes there gets one more, so that undoing it is exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityflux.llm.common import let


@dataclass(frozen=True)
class Template:
    """Control strings; the first character of any of them must not occur later in one."""

    open: str = "[INST]"
    close: str = "[/INST]"
    more: str = "[MORE]"
    end: str = "</s>"
    loss_role: str = "assistant"

    @property
    def controls(self) -> list[str]:
        return [self.open, self.close, self.more, self.end]

    def __post_init__(self):
        heads = {c[0] for c in self.controls}
        if any(h in c[1:] or "\\" in c for c in self.controls for h in heads):
            raise ValueError("a control string may not contain a backslash or the head of another")

    @property
    def _parts(self) -> tuple[str, str]:
        heads = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        return f"([{heads}])", "(" + "|".join(re.escape(c[1:]) for c in self.controls) + ")"

    def escape(self, text: Column) -> Column:
        head, tail = self._parts
        return F.regexp_replace(text, head + r"(\\*)" + tail, r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        head, tail = self._parts
        return F.regexp_replace(text, head + r"\\(\\*)" + tail, "$1$2$3")


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, formatted text, and its segments with the loss mask.

    ``segments`` is an array of struct(text, loss) that joined in order is ``formatted``.

    Nulls: a null text or role is empty; null conv_id is a conversation of its own; null turns come
    first. Ties of a turn are ordered by role, then text, and repeated rows stay, each a turn.
    Empty table: no rows. Other columns are ignored. A conversation becomes one text and must fit a
    row; the work on it is linear in its turns.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return chats.select("conv_id", let(F.col("turns"), lambda a: _segments(a, template)).alias("segments")).select(
        "conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments"
    )


def _segments(turns: Column, t: Template) -> Column:
    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def one(x: Column, i: Column) -> Column:
        # A turn opens a block unless the one before has its role, and ends it unless the next has.
        joins = F.get(turns, i - 1)["role"].eqNullSafe(x["role"])
        goes_on = F.get(turns, i + 1)["role"].eqNullSafe(x["role"])
        header = F.concat(F.lit(t.open), t.escape(x["role"]), F.lit(t.close))
        return F.array(
            piece(F.when(joins, t.more).otherwise(header), F.lit(False)),
            piece(t.escape(x["text"]), x["role"] == t.loss_role),
            piece(F.when(goes_on, "").otherwise(t.end), F.lit(False)),
        )

    return F.filter(F.flatten(F.transform(turns, one)), lambda s: s["loss"] | (s["text"] != ""))


def parse(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text: array of struct(role, text), in order."""
    t = template

    def block(b: Column) -> Column:
        at = F.instr(b, F.lit(t.close))
        role = t.unescape(F.substring(b, F.lit(len(t.open) + 1), at - 1 - len(t.open)))
        body = F.substring(b, at + len(t.close), F.length(b))
        return let(role, lambda r: F.transform(F.split(body, re.escape(t.more)), lambda x: F.struct(r.alias("role"), t.unescape(x).alias("text"))))

    blocks = F.split(formatted, re.escape(t.end))
    return F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), block))


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, in order, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")


def digest(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Counts and digests read back from formatted conversations."""
    back = formatted.select("conv_id", parse(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments"), template).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
