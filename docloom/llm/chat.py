"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

A template names the marks of a turn, the roles that carry loss, and the machine: its start state,
its transitions (state, role) -> state, and the states in which a conversation may end. Formatting
never drops a conversation; one that the machine rejects comes out with ``valid`` false.

Everything is a DataFrame expression: turns are gathered by conversation (a conversation is one
output row, so its turns meet in any case), and the machine is a fold over the ordered roles.

Defined cases: a null role or text is empty; rows of a conversation are taken by turn (null first),
ties by role, then text, and repeated rows stay; rows with a null conversation id form one
conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks must begin with ``<|``: in texts that sequence is escaped, so marks are found exactly."""

    open: str = "<|im_start|>"
    head_end: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    final: tuple[str, ...] = ("asked", "answered")


def escaped(text: Column) -> Column:
    r"""``<|`` becomes ``<\|`` and any ``<\..\|`` gets one more backslash; nothing else changes."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, n_turns, valid, segments (array of text and loss), formatted (the segments joined)."""
    t = template
    body = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    table = F.create_map(*[F.lit(x) for (state, role), to in t.transitions.items() for x in (f"{state}\x00{role}", to)])
    step = lambda state, turn: F.coalesce(F.element_at(table, F.concat(state, F.lit("\x00"), turn["role"])), F.lit("rejected"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def emitted(turn: Column) -> Column:
        return F.array(
            segment(F.concat(F.lit(t.open), _role_out(turn["role"]), F.lit(t.head_end)), no),
            segment(escaped(turn["text"]), turn["role"].isin(*t.loss_roles)),
            segment(F.lit(t.close), no),
        )

    return (
        turns.select("conv_id", body.alias("body"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("body")).alias("turns"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.aggregate("turns", F.lit(t.start), step).isin(*t.final).alias("valid"),
            F.flatten(F.transform("turns", emitted)).alias("segments"),
        )
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Adds turns (array of role and text) parsed from ``formatted`` and loss_text from the segments."""
    t = template
    quote = lambda s: "".join("\\" + c if not c.isalnum() and c not in "\n_" else c for c in s)

    def parsed(piece: Column) -> Column:
        head = F.instr(piece, t.head_end)
        return F.struct(
            _role_in(piece.substr(F.lit(1), head - 1)).alias("role"),
            unescaped(piece.substr(head + len(t.head_end), F.length(piece) - head - (len(t.head_end) - 1) - len(t.close))).alias("text"),
        )

    pieces = F.split("formatted", quote(t.open), -1)
    return formatted.withColumn("turns", F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), parsed)).withColumn(
        "loss_text", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    )
