"""Chat formatting from a declarative template, in DataFrame functions only.

A finite-state machine over roles validates the order of turns. Each turn yields three segments,
the opening mark, the text and the closing mark, each with a loss flag; a formatted conversation
is the segments put together. No mark can occur inside a text: the template's escape character
and the first characters of its marks are replaced reversibly there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, loss roles and the machine: transitions[state][role] is the next state."""

    open: str = "<turn {role}>\n"
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    #: In texts: character -> letter after the escape. The escape itself comes first.
    escape: str = "\\"
    text_escapes: tuple[tuple[str, str], ...] = (("\\", "b"), ("<", "l"))
    role_escapes: tuple[tuple[str, str], ...] = (("\\", "b"), ("<", "l"), (">", "g"), ("\n", "n"))

    def __post_init__(self) -> None:
        lead, tail = self.open.split("{role}")
        guarded = {c for c, _ in self.text_escapes}
        if self.close[:1] not in guarded or lead[:1] not in guarded or self.escape not in guarded:
            raise ValueError("marks must begin with an escaped character")
        if not tail or tail[0] not in {c for c, _ in self.role_escapes}:
            raise ValueError("the mark after a role must begin with a character escaped in roles")


def escaped(text: Column, escapes: tuple[tuple[str, str], ...], mark: str) -> Column:
    for char, letter in escapes:
        text = F.replace(text, F.lit(char), F.lit(mark + letter))
    return text


def unescaped(text: Column, escapes: tuple[tuple[str, str], ...], mark: str) -> Column:
    for char, letter in reversed(escapes):
        text = F.replace(text, F.lit(mark + letter), F.lit(char))
    return text


def segments(turns: DataFrame, template: Template = Template(), role_col: str = "role", text_col: str = "text") -> DataFrame:
    """turns with `segments` array<struct<text, loss>>. Null roles and texts count as empty."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    lead, tail = template.open.split("{role}")
    shown = escaped(role, template.role_escapes, template.escape)
    piece = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
    parts = F.array(
        piece(F.concat(F.lit(lead), shown, F.lit(tail)), F.lit(False)),
        piece(escaped(text, template.text_escapes, template.escape), role.isin(*template.loss_roles)),
        piece(F.lit(template.close), F.lit(False)),
    )
    return turns.withColumn("segments", parts)


def final_state(roles: Column, template: Template) -> Column:
    """The machine's last state over an array of roles; "error" once no transition fits."""
    moves = [x for s, to in template.transitions.items() for r, t in to.items() for x in (F.lit(f"{s}\n{r}"), F.lit(t))]
    table = F.create_map(*moves)
    return F.aggregate(roles, F.lit(template.start), lambda s, r: F.coalesce(table[F.concat(s, F.lit("\n"), r)], F.lit("error")))


def format_conversations(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, state, valid, segments: one row per conversation, none dropped; valid says whether the turn order holds.

    Rows are ordered by turn, then role, then text (null turns first); repeated rows stay. Rows
    with a null conversation id form one conversation. Other columns are ignored.
    """
    known = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    row = F.struct("turn", "role", "text", "segments")
    grouped = segments(known, template).groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    state = final_state(F.transform("rows", lambda r: r["role"]), template)
    out = grouped.select("conv_id", state.alias("state"), F.flatten(F.transform("rows", lambda r: r["segments"])).alias("segments"))
    return out.select("conv_id", "state", F.col("state").isin(*template.accepting).alias("valid"), "segments")


def formatted(col: str = "segments") -> Column:
    return F.array_join(F.transform(col, lambda s: s["text"]), "")


def loss_text(template: Template, col: str = "segments") -> Column:
    """All text under the loss mask, unescaped."""
    own = F.filter(col, lambda s: s["loss"])
    return F.array_join(F.transform(own, lambda s: unescaped(s["text"], template.text_escapes, template.escape)), "")


def parsed(text: Column, template: Template) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    lead, tail = template.open.split("{role}")
    quoted = lambda s: "\\Q" + s + "\\E"
    turns = F.filter(F.split(text, quoted(template.close)), lambda p: p != "")

    def turn(part: Column) -> Column:
        both = F.split(part, quoted(tail), 2)
        role = F.substr(both[0], F.lit(len(lead) + 1))
        return F.struct(unescaped(role, template.role_escapes, template.escape).alias("role"), unescaped(both[1], template.text_escapes, template.escape).alias("text"))

    return F.transform(turns, turn)
