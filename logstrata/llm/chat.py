"""Chat formatting with a finite-state machine over roles.

A declarative ``Template`` names the control strings, the roles whose text counts
for the loss, and the legal successions of roles. Turns of a conversation are
sorted by (turn, role, text), the machine walks over them, and every turn becomes
three text segments (header, body, trailer), each with a loss flag. Control
strings inside roles and texts are escaped reversibly, so the formatted text can
be split back into exactly the turns that went in.

A conversation is one ordered document; its turns stream through one task in
constant memory (only digests and the current turn are held), however long it is.

Defined results: a null text is empty; a null role is the empty role (an illegal
succession, formatted all the same); a null conv_id is a conversation of its own;
null turns come last; repeated rows are separate turns; an illegal succession is
reported in ``error`` and the machine goes on from that role; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> roles that may follow; "" is the state before the first turn.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def escape(self, text: str) -> str:
        """Backslashes double and the bar of a control opener is set off, so no control string remains."""
        return text.replace("\\", "\\\\").replace("<|", "<\\|") if "\\" in text or "<|" in text else text

    def unescape(self, text: str) -> str:
        if "\\" not in text:
            return text
        out, at = [], 0
        while (hit := text.find("\\", at)) >= 0:
            out.append(text[at:hit])
            out.append(text[hit + 1 : hit + 2])
            at = hit + 2
        return "".join([*out, text[at:]])

    def escape_role(self, role: str) -> str:
        return self.escape(role).replace("\n", "\\n")

    def unescape_role(self, role: str) -> str:
        out, at = [], 0
        while (hit := role.find("\\", at)) >= 0:
            out.append(role[at:hit])
            follower = role[hit + 1 : hit + 2]
            out.append("\n" if follower == "n" else follower)
            at = hit + 2
        return "".join([*out, role[at:]])


class Machine:
    """The state is the last role; ``step`` returns what is wrong with the next one, or None."""

    def __init__(self, template: Template):
        self.template, self.state = template, ""

    def step(self, role: str) -> str | None:
        allowed = self.template.follows.get(self.state, tuple(r for r in self.template.follows if r))
        error = None if role in allowed else f"{role or '(none)'} after {self.state or 'start'}"
        self.state = role
        return error


SEGMENTS = "conv_id long, turn_no long, part int, text string, loss boolean, error string"


def segments(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Three segments per turn, in order within a partition; a conversation lies in one partition."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), "role", "text")

    def emit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, machine, number = object(), Machine(template), 0
        for batch in frames:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != current or number == 0:
                    current, machine, number = conv, Machine(template), 0
                error, scored = machine.step(role), role in template.loss_roles
                out.append((conv, number, 0, template.start + template.escape_role(role) + template.after_role, False, error))
                out.append((conv, number, 1, template.escape(text), scored, None))
                out.append((conv, number, 2, template.end + template.after_turn, False, None))
                number += 1
            if out:
                names = ("conv_id", "turn_no", "part", "text", "loss", "error")
                types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return placed.mapInArrow(emit, SEGMENTS)


class Reader:
    """Reads formatted text back, as it arrives, into turns and their digests."""

    def __init__(self, template: Template):
        self.template, self.held = template, ""
        self.turns, self.chars, self.loss_chars, self.errors, self.last = 0, 0, 0, 0, ""
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: bool, error: str | None) -> None:
        self.chars += len(text)
        self.errors += error is not None
        if loss:
            plain = self.template.unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.held += text
        stop = self.template.end + self.template.after_turn
        while (at := self.held.find(stop)) >= 0:
            turn, self.held = self.held[:at], self.held[at + len(stop) :]
            if not turn.startswith(self.template.start):
                raise ValueError("formatted text does not begin with a turn")
            role, _, body = turn[len(self.template.start) :].partition(self.template.after_role)
            self.last = self.template.unescape_role(role)
            self.all.update(f"{self.last}\n{self.template.unescape(body)}\n".encode())
            self.turns += 1

    def row(self, conv: int | None) -> tuple:
        valid = not self.errors and not self.held and self.last in self.template.final
        return (conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read from its segments (in the order ``segments`` gives them)."""

    def digest(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        current, reader = None, None

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in frames:
            done: list[tuple] = []
            for conv, turn, part, text, loss, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or (turn == 0 and part == 0):
                    if reader is not None:
                        done.append(reader.row(current))
                    current, reader = conv, Reader(template)
                reader.add(text, loss, error)
            if done:
                yield pack(done)
        if reader is not None:
            yield pack([reader.row(current)])

    return formatted.mapInArrow(digest, DIGEST)
