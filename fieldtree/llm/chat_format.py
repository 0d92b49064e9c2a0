"""Chat formatting with a grammar round trip (operator 3).

Grammar of the rendered text, a plain sequence of turns::

    conversation := turn*
    turn         := open(role) text close(role)
    open(user)   := "<s>[INST] "          close(user)      := " [/INST]"
    open(system) := "<s><<SYS>>\\n"        close(system)    := "\\n<</SYS>>"
    open(assistant) := "<s>[ANS] "        close(assistant) := " </s>"
    open(other)  := "<s>[ROLE name] "     close(other)     := " [/ROLE]"

Every turn is first rendered as it is and parsed again. Where the parser does not give back the
source, or would read further than the turn, the conflicting strings get one escape mark more,
until it does. The mark is a backslash behind the first character of a control string (``<\\/s>``);
a control string that already holds marks gets another, so unescaping (one mark less) is exact.

Nulls: a null text is empty, a null role is the empty role, null turns come first and null
conversation ids are one conversation. Ties in ``turn`` are put in order by role and text, so
repeated rows stay, side by side. Empty tables give empty results, and other columns are ignored.

Long conversations: rows are sorted by conversation and turn and read as a stream. A task holds one
turn and two running digests, never a whole conversation, however many rows a conversation has. A
SHA-256 over a conversation is sequential, so one conversation is one task's stream by definition.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, slices, to_arrow

TEMPLATE = {"user": ("<s>[INST] ", " [/INST]"), "system": ("<s><<SYS>>\n", "\n<</SYS>>"), "assistant": ("<s>[ANS] ", " </s>")}
OTHER = ("<s>[ROLE ", "] ", " [/ROLE]")
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]")
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS))
_MARKED = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROLS))


def escape(text: str) -> str:
    """One mark more in every control string, marked or not."""
    return _ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """One mark less in every marked control string."""
    return _MARKED.sub(lambda m: m[0][0] + m[0][2:], text)


def _role_out(role: str) -> str:
    """A role inside ``[ROLE name]``: per cent signs, brackets and line ends by code."""
    return re.sub(r"[%\[\]<>\n\r]", lambda m: f"%{ord(m[0]):02x}", role)


def _role_in(name: str) -> str:
    return re.sub(r"%([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), name)


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    start: int  # of the text as it stands in the rendered string, and its end
    end: int


class GrammarError(ValueError):
    pass


def parse(rendered: str, at: int = 0, end: int | None = None) -> Iterator[Turn]:
    """The turns of a rendered string, read left to right without backtracking."""
    end = len(rendered) if end is None else end
    while at < end:
        for role, (lead, tail) in TEMPLATE.items():
            if rendered.startswith(lead, at):
                start = at + len(lead)
                break
        else:
            if not rendered.startswith(OTHER[0], at) or (stop := rendered.find(OTHER[1], at)) < 0:
                raise GrammarError(f"no turn begins at {at}")
            role, start, tail = _role_in(rendered[at + len(OTHER[0]) : stop]), stop + len(OTHER[1]), OTHER[2]
        if (stop := rendered.find(tail, start)) < 0:
            raise GrammarError(f"the turn at {at} does not end")
        # Inside a text no control string may stand unmarked.
        body = rendered[start:stop]
        if any(c in body for c in CONTROLS):
            raise GrammarError(f"a control string in the turn at {at}")
        yield Turn(role, unescape(body), start, stop)
        at = stop + len(tail)


def render_turn(role: str, text: str) -> tuple[str, Turn]:
    """The turn as rendered and as the parser recovers it, which is the source."""
    lead, tail = TEMPLATE.get(role) or (OTHER[0] + _role_out(role) + OTHER[1], OTHER[2])
    body = text
    for _ in range(2):
        rendered = lead + body + tail
        try:
            turns = list(parse(rendered))
        except GrammarError:
            turns = []
        if len(turns) == 1 and (turns[0].role, turns[0].text) == (role, text):
            return rendered, turns[0]
        body = escape(body)
    raise GrammarError(f"a turn of {len(text)} characters does not survive the round trip")


def ordered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of each conversation in one partition, in order; the only shuffle."""
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chats(conversations: DataFrame, part_chars: int = 1 << 20, **columns: str) -> DataFrame:
    """Rendered conversations: conv_id, part (from 0), formatted, loss_starts, loss_ends.

    A conversation longer than ``part_chars`` goes on in further parts, cut between turns. The
    loss mask is given as spans of code points of ``formatted``, one for each assistant text.
    Parts of a conversation lie in one partition, in order.
    """
    df = ordered(conversations, **columns)
    schema = f"conv_id {df.schema['conv_id'].dataType.simpleString()}, part int, formatted string, loss_starts array<int>, loss_ends array<int>"
    arrow = to_arrow(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, now = [], 0, None  # now: [conv_id, part, pieces, chars, starts, ends]
        for batch in batches:
            for chunk in slices(batch):
                for conv, role, text in zip(*(chunk.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                    rendered, turn = render_turn(role, text)
                    if now is None or now[0] != conv or now[3] + len(rendered) > part_chars:
                        if now is not None:
                            out.append((now[0], now[1], "".join(now[2]), now[4], now[5]))
                            held += now[3]
                        now = [conv, now[1] + 1 if now is not None and now[0] == conv else 0, [], 0, [], []]
                    if role == "assistant":
                        now[4].append(now[3] + turn.start)
                        now[5].append(now[3] + turn.end)
                    now[2].append(rendered)
                    now[3] += len(rendered)
                    if held > BATCH_BYTES // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                        out, held = [], 0
        if now is not None:
            out.append((now[0], now[1], "".join(now[2]), now[4], now[5]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.select("conv_id", "role", "text").mapInArrow(run, schema)


def digest_chats(formatted: DataFrame) -> DataFrame:
    """Read rendered conversations (``format_chats``) back: counts and digests of turns and loss text.

    ``formatted`` has the parts of a conversation side by side in one partition.
    """
    schema = f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    arrow = to_arrow(formatted, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = [], None

        def close() -> None:
            out.append((now["conv"], now["turns"], now["all"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"]))

        for batch in batches:
            for chunk in slices(batch):
                for conv, text, starts, ends in zip(*(chunk.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_starts", "loss_ends"))):
                    if now is None or now["conv"] != conv:
                        if now is not None:
                            close()
                        now = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                    now["chars"] += len(text)
                    for turn in parse(text):
                        now["turns"] += 1
                        now["all"].update(f"{turn.role}\n{turn.text}\n".encode())
                    for start, end in zip(starts, ends):
                        under = unescape(text[start:end])
                        now["loss_chars"] += len(under)
                        now["loss"].update(under.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out.clear()
        if now is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(run, schema)
