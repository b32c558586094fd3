"""Chat formatting by a grammar round trip.

Every turn is rendered by one production of a small grammar, the rendered text is parsed again by
a deterministic parser, and content that does not come back equal is escaped until it does.

    conversation = turn*
    turn         = "[INST] " body " [/INST]"          user
                 | "<<SYS>> " body " <</SYS>>"        system
                 | "<s> " body " </s>"                assistant
                 | "<<ROLE>> " role "|" body " <</ROLE>>"   any other role

A body ends at the first closing mark of its production, so a body that holds that mark does not
survive. Escaping puts a backslash into every control string of a body, and one more where some
stand already; the parser always takes one away again, which makes the two inverse to each other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerpitch.llm.common import arrow_map

ASSISTANT = "assistant"
MARKS = {
    "user": ("[INST] ", " [/INST]"),
    "system": ("<<SYS>> ", " <</SYS>>"),
    ASSISTANT: ("<s> ", " </s>"),
}
OTHER = ("<<ROLE>> ", " <</ROLE>>")
_OPENERS = [(marks[0], role) for role, marks in MARKS.items()] + [(OTHER[0], None)]
#: A control string, or one that carries backslashes after its first sign.
_CONTROL = re.compile(r"([\[<])(\\*)(/?INST\]|</?(?:SYS|ROLE)>>|/?s>)")
_ESCAPED = re.compile(r"([\[<])\\(\\*)(/?INST\]|</?(?:SYS|ROLE)>>|/?s>)")


class GrammarError(ValueError):
    """The text is not a sentence of the grammar."""


@dataclass(frozen=True)
class Turn:
    role: str
    text: str


def escape(body: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", body)


def unescape(body: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", body)


def _assemble(role: str, role_part: str, body: str) -> str:
    opening, closing = MARKS.get(role, OTHER)
    return opening + (body if role in MARKS else f"{role_part}|{body}") + closing


def parse_turn(text: str, at: int) -> tuple[Turn, int, int, int] | None:
    """The turn at ``at`` with the place of its body and its end; None if it is not complete."""
    for opening, role in _OPENERS:
        if text.startswith(opening, at):
            break
    else:
        if any(opening.startswith(text[at:]) for opening, _ in _OPENERS):
            return None
        raise GrammarError(f"no turn starts at {at}")
    start = at + len(opening)
    closing = MARKS[role][1] if role else OTHER[1]
    end = text.find(closing, start)
    if end < 0:
        return None
    if role is None:
        # Bars and backslashes of a role name are escaped, so the first plain bar ends it.
        bar = re.compile(r"(?:[^|\\]|\\.)*", re.DOTALL).match(text, start, end).end()
        if bar >= end or text[bar] != "|":
            raise GrammarError(f"the role at {start} has no end")
        name = unescape(re.sub(r"\\([|\\])", r"\1", text[start:bar]))
        return Turn(name, unescape(text[bar + 1 : end])), bar + 1, end, end + len(closing)
    return Turn(role, unescape(text[start:end])), start, end, end + len(closing)


def render_turn(turn: Turn) -> tuple[str, int, int, bool]:
    """Rendered text, place of the body in it, and whether escaping was needed."""
    plain_role = re.sub(r"([|\\])", r"\\\1", turn.role)
    safe_role = re.sub(r"([|\\])", r"\\\1", escape(turn.role))
    for escaped, (role, body) in enumerate(
        ((plain_role, turn.text), (safe_role, escape(turn.text)))
    ):
        text = _assemble(turn.role, role, body)
        try:
            found = parse_turn(text, 0)
        except GrammarError:
            continue
        if found is not None and found[0] == turn and found[3] == len(text):
            return text, found[1], found[2], bool(escaped)
    raise GrammarError("escaping did not make the turn readable")


def format_turns(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per turn: (conv_id, place, formatted, loss_start, loss_end, escaped).

    The formatted conversation is its fragments joined in the order of ``place`` with nothing in
    between; the rows come back partitioned by conversation and sorted by place. ``loss_start``
    and ``loss_end`` are the code points of an assistant body within its fragment, null for other
    roles. Rows are ordered by (turn, role, text), nulls first, so ties and repeated rows have a
    fixed order and all stay. A null text or role is the empty string; rows with a null
    conversation id form one conversation of their own. Turns stream through sorted partitions, so
    a conversation of any length needs the memory of one batch. Other columns are not carried.
    """
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")]
    rows = (
        turns.select(
            F.col(conv_col).cast("long").alias("conv_id"),
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions(*order)
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last, place = object(), 0
        for batch in batches:
            convs = batch.column("conv_id").to_pylist()
            out: dict = {k: [] for k in ("place", "formatted", "loss_start", "loss_end", "escaped")}
            for conv, role, text in zip(
                convs, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                place = place + 1 if conv == last else 0
                last = conv
                fragment, start, end, escaped = render_turn(Turn(role, text))
                out["place"].append(place)
                out["formatted"].append(fragment)
                out["loss_start"].append(start if role == ASSISTANT else None)
                out["loss_end"].append(end if role == ASSISTANT else None)
                out["escaped"].append(escaped)
            yield out | {"conv_id": convs}

    return arrow_map(
        rows,
        render,
        "conv_id long, place long, formatted string, loss_start long, loss_end long, escaped boolean",
    )


class _Reader:
    """Digests of one conversation, fed with its text piece by piece."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.rest = ""
        self.done = 0
        self.turns = self.loss_chars = 0
        self.masks: list[tuple[int, int]] = []
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, mask: tuple[int, int] | None) -> None:
        if mask:
            self.masks.append((self.done + len(self.rest) + mask[0], self.done + len(self.rest) + mask[1]))
        self.rest += text
        at = 0
        while at < len(self.rest):
            found = parse_turn(self.rest, at)
            if found is None:
                break
            turn, start, end, after = found
            self.turns += 1
            self.all.update(f"{turn.role}\n{turn.text}\n".encode())
            if self.masks and self.masks[0] == (self.done + start, self.done + end):
                self.masks.pop(0)
                under = unescape(self.rest[start:end])
                self.loss.update(under.encode())
                self.loss_chars += len(under)
            at = after
        self.done += at
        self.rest = self.rest[at:]

    def row(self) -> tuple:
        if self.rest or self.masks:
            raise GrammarError(f"conversation {self.conv} ends within a turn")
        return (
            self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.done,
        )


DIGESTS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations and digest what they say, one row per conversation.

    ``formatted`` holds the columns of ``format_turns`` with each conversation in one partition in
    the order of place. The text is parsed as one stream; the fragment borders are not used. The
    loss mask selects text by its code points in the whole conversation. Null texts were formatted
    as empty ones; no conversations give no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        reader: _Reader | None = None
        for batch in batches:
            rows = []
            for conv, text, start, end in zip(
                *[batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_start", "loss_end")],
                strict=True,
            ):
                if reader is None or reader.conv != conv:
                    if reader is not None:
                        rows.append(reader.row())
                    reader = _Reader(conv)
                reader.feed(text, None if start is None else (start, end))
            if rows:
                yield dict(zip(DIGESTS, zip(*rows, strict=True), strict=True))
        if reader is not None:
            yield {name: [value] for name, value in zip(DIGESTS, reader.row(), strict=True)}

    return arrow_map(
        formatted,
        read,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )


def stored_order(formatted: DataFrame) -> DataFrame:
    """Bring formatted rows, read from files in any order, into the order ``read_back`` needs."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")
