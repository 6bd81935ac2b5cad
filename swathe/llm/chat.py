"""Chat formatting from event logs.

Conversations are rebuilt from events: partitioned by conversation, sorted by sequence, and folded
into final messages, which are then rendered with a template and a loss mask. Events are rows
(conv_id, seq, kind, message, role, text):

``message``     a whole message appears, named ``message`` in its conversation
``delta``       text is appended to a message, which it starts if need be
``edit``        the message's text is replaced
``regenerate``  the message's text is dropped; deltas may follow
``delete``      the message disappears

The fold streams over sorted partitions; a worker holds the messages of one conversation.

Template: ``### Role: text</turn>\\n`` for each message. In roles and texts ``\\``, ``#`` and ``<``
are escaped by ``\\``, so no text can hold a control string and the output is read back exactly. The
loss mask covers each assistant text, escapes included, without its marks.

Edge cases: null texts and roles count as empty; a null seq comes first; events of equal seq are
ordered by kind, message, role and text; repeated rows of kind ``message`` with a null ``message``
name are messages of their own; events with a null conv_id are one conversation; a conversation
whose messages are all deleted gives no row. Unknown kinds raise an error.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = ("conv_id", "seq", "kind", "message", "role", "text")
OPEN, NAMED, CLOSE = "### ", ": ", "</turn>\n"
#: How the template names roles; a role that is itself one of these names is escaped.
TITLES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in TITLES.items()}
_ESCAPE = re.compile(r"[\\#<]")
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def role_mark(role: str) -> str:
    mark = escape(role).replace(":", "\\:")
    return "\\" + mark if mark in ROLES else mark


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans under the loss mask."""
    parts, mask, at = [], [], 0
    for role, text in messages:
        head = OPEN + (TITLES.get(role) or role_mark(role)) + NAMED
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
        parts += [head, body, CLOSE]
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((ROLES.get(m[1], unescape(m[1])), unescape(m[2])))
        at = m.end()
    return out


class Fold:
    """The messages of one conversation while its events arrive."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.messages: list[list | None] = []

    def apply(self, kind: str, message: str | None, role: str, text: str) -> None:
        i = self.at.get(message) if message is not None else None
        if kind in ("message", "delta") and i is None:
            if message is not None:
                self.at[message] = len(self.messages)
            self.messages.append([role, [text]])
        elif kind == "delta":
            self.messages[i][1].append(text)
        elif kind in ("message", "edit"):
            if i is not None:
                self.messages[i][1] = [text]
        elif kind == "regenerate":
            if i is not None:
                self.messages[i][1] = []
        elif kind == "delete":
            if i is not None:
                self.messages[i] = None
                del self.at[message]
        else:
            raise ValueError(f"unknown kind of event: {kind}")

    def final(self) -> list[tuple[str, str]]:
        return [(m[0], "".join(m[1])) for m in self.messages if m is not None]


def format_conversations(events: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of start, end)."""

    def fold(batches):
        now, state = None, None
        rows: tuple[list, list, list] = ([], [], [])
        held = 0

        def close():
            nonlocal held
            messages = state.final() if state else []
            if messages:
                text, mask = render(messages)
                for c, v in zip(rows, (now[0], text, [{"start": a, "end": b} for a, b in mask]), strict=True):
                    c.append(v)
                held += len(text)

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], mask_type)], ["conv_id", "formatted", "loss_mask"])
            for c in rows:
                c.clear()
            return out

        mask_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for conv, _, kind, message, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv,):
                    close()
                    now, state = (conv,), Fold()
                    if held > 1 << 22:
                        yield batch_of()
                        held = 0
                state.apply(kind, message, role, text)
        close()
        if rows[0]:
            yield batch_of()

    rows = events.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("seq").cast("long").alias("seq"),
        "kind",
        F.col("message").cast("string").alias("message"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind", "message", "role", "text").mapInArrow(fold, "conv_id long, formatted string, loss_mask array<struct<start: long, end: long>>")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from the formatted conversations."""

    def read(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, mask in zip(batch.column("formatted"), batch.column("loss_mask"), strict=True):
                text = text.as_py()
                turns = hashlib.sha256()
                found = parse(text)
                for role, body in found:
                    turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask.as_py())
                for c, v in zip(out, (len(found), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            )

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as events: each is a whole message at its turn."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("message"), "role", "text")
