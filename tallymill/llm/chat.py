r"""Chat formatting with a grammar round trip.

Grammar of the rendered text, one production a turn::

    turn := "### " ROLE ": " BODY "</turn>" NEWLINE

In ROLE and BODY a backslash before a control string (``\``, ``</turn>``,
``###`` or, in a role, ``: ``) makes it ordinary; a backslash before anything else
stands for itself. Rendering starts unescaped; a deterministic parser reads the
text back, and each turn that it doesn't return unchanged, or that holds a mark of
the template, is escaped until the whole conversation comes back identical. Most
texts hold no control string and are left as they are.

Roles are shown with a capital first letter where that is reversible.

Nulls: a null text or role is empty; rows whose ``conv_id`` is null form one
conversation; a null turn sorts first. Ties in (conv_id, turn) are ordered by role,
then text, so repeated rows give repeated turns. An empty table gives no rows;
extra columns are ignored. One conversation is one string: its turns meet in one
task, whatever their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("\\", "</turn>", "###")
_BODY = re.compile(r"\\(\\|</turn>|###)|(</turn>\n)")
_ROLE = re.compile(r"\\(\\|</turn>|###|: )|(: )")
FORMATTED = "conv_id {key}, n_turns long, formatted string, loss_spans array<struct<start: long, stop: long>>, escaped_turns long"


class GrammarError(ValueError):
    """The text isn't of the grammar."""


def escape(text: str, extra: tuple[str, ...] = ()) -> str:
    for control in (*CONTROLS, *extra):
        text = text.replace(control, "\\" + control)
    return text


def _until(pattern: re.Pattern, text: str, at: int) -> tuple[str, int, int]:
    """(unescaped content, its end, end of the closing mark) from ``at``."""
    out, begin = [], at
    for found in pattern.finditer(text, at):
        out.append(text[begin : found.start()])
        if found[2]:
            return "".join(out), found.start(), found.end()
        out.append(found[1])
        begin = found.end()
    raise GrammarError(f"no closing mark after {at}")


def shown(role: str) -> str:
    return role[:1].upper() + role[1:] if "a" <= role[:1] <= "z" else "=" + role


def unshown(role: str) -> str:
    return role[1:] if role[:1] == "=" else role[:1].lower() + role[1:]


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and stop of the body in the rendered text) of each turn."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith("### ", at):
            raise GrammarError(f"no turn at {at}")
        role, _, begin = _until(_ROLE, text, at + 4)
        body, stop, at = _until(_BODY, text, begin)
        out.append((unshown(role), body, begin, stop))
    return out


def render_turn(role: str, text: str, escaped: bool) -> str:
    if escaped:
        return f"### {escape(shown(role), (': ',))}: {escape(text)}</turn>\n"
    return f"### {shown(role)}: {text}</turn>\n"


def _same(rendered: str, turns: list[tuple[str, str]]) -> bool:
    try:
        return [t[:2] for t in parse(rendered)] == turns
    except GrammarError:
        return False


def render(turns: list[tuple[str, str]]) -> tuple[str, list[bool]]:
    """(text that parses back to ``turns``, which turns had to be escaped)."""
    escaped = ["</turn>" in t[1] or "###" in t[1] or not _same(render_turn(*t, False), [t]) for t in turns]
    while True:
        out = "".join(render_turn(*t, e) for t, e in zip(turns, escaped))
        if _same(out, turns):
            return out, escaped
        if all(escaped):
            raise GrammarError("the escaped text doesn't come back")
        escaped = [True] * len(turns)


def format_conversations(rows: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, escaped_turns): one row a conversation.

    ``loss_spans`` are the bodies of the turns to learn from, as code points of
    ``formatted``. One shuffle, on ``conv_id``.
    """
    turns = rows.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("__t")
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("__t")).alias("__turns"))
    grouped = grouped.select("conv_id", F.col("__turns.role").alias("roles"), F.col("__turns.text").alias("texts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for roles, texts in zip(frame["roles"], frame["texts"]):
                text, escaped = render(list(zip(roles, texts)))
                spans = [{"start": b, "stop": e} for role, _, b, e in parse(text) if role == learn_from]
                out.append((len(roles), text, spans, sum(escaped)))
            made = pd.DataFrame(out, columns=["n_turns", "formatted", "loss_spans", "escaped_turns"])
            made.insert(0, "conv_id", frame["conv_id"].array)
            yield made

    return grouped.mapInPandas(run, FORMATTED.format(key=rows.schema["conv_id"].dataType.simpleString()))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, roles, texts, loss_text, formatted_chars) recovered from the rendered text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, spans in zip(frame["formatted"], frame["loss_spans"]):
                turns = parse(text)
                starts = {s["start"] for s in spans}
                out.append(([t[0] for t in turns], [t[1] for t in turns], "".join(t[1] for t in turns if t[2] in starts), len(text)))
            made = pd.DataFrame(out, columns=["roles", "texts", "loss_text", "formatted_chars"])
            made.insert(0, "conv_id", frame["conv_id"].array)
            yield made

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_spans").mapInPandas(
        run, f"conv_id {kind}, roles array<string>, texts array<string>, loss_text string, formatted_chars long"
    )
