"""Conversations as training text: a finite-state machine over roles, a declarative template, and a loss flag for each segment.

A template says, role by role, which strings open and close a turn and whether its text is learned, how other roles are written, and which role may follow
which. Strings of the template that stand inside a text are escaped by a backslash, as are backslashes, so the turns can be read back from
the output exactly, whatever they say.

The machine's state is the role seen last. A turn that its state does not allow is counted (`bad_turns`) and written all the same; a conversation is `valid` if it has
none and ends in an accepting state.

How it runs: one shuffle by conversation, sorted by turn (Spark's sort spills); the machine then runs over the sorted stream. It holds at most one part of
a conversation (PART_CHARS and one turn), so neither a conversation with a third of all rows nor one in which every role is the same needs more memory. read_back() takes the parts in the order in which
format_conversations() made them, so it shuffles nothing. A digest over all turns of a conversation is a chain by its definition, so one task follows each conversation.

Odd rows: a null text counts as empty, a null role as the empty role (written as other roles are), a null conv_id is a conversation of its own. A null turn
comes first; equal turns go by role, then text; repeated rows are turns like others. Very long texts are one segment. An empty table has no
conversations. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_CHARS = 1 << 20
SEGMENT = "struct<text:string,loss:boolean>"
FORMATTED = f"part int, segments array<{SEGMENT}>, last boolean, bad_turns long, valid boolean"


@dataclass(frozen=True)
class Turn:
    """How a role is written: what opens and closes its text, and whether the text is learned."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles by name; other: (open, between, close) of any other role, whose name stands between open and between; follows: the roles that may come after each role (None: at the start); accepting: roles that may come last."""

    roles: dict[str, Turn] = field(default_factory=lambda: {"system": Turn("[SYS]", "[/SYS]"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("<s>", "</s>", True)})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    follows: dict[str | None, tuple[str, ...]] = field(default_factory=lambda: {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepting: tuple[str, ...] = ("user", "assistant")
    escape: str = "\\"

    def controls(self) -> list[str]:
        """The template's strings without the spaces round them, longest first."""
        found = {s.strip() for t in self.roles.values() for s in (t.open, t.close)} | {s.strip() for s in self.other}
        return sorted(found, key=lambda s: (-len(s), s))


class Writer:
    """Writes turns as segments."""

    def __init__(self, template: Template):
        self.t = template
        self._special = re.compile("|".join(map(re.escape, [template.escape, *template.controls()])))

    def escaped(self, text: str) -> str:
        return self._special.sub(lambda m: self.t.escape + m[0], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's segments with their loss flags: what opens it, its text, what closes it."""
        turn = self.t.roles.get(role)
        if turn:
            return [(turn.open, False), (self.escaped(text), turn.loss), (turn.close, False)]
        first, between, last = self.t.other
        return [(first + self.escaped(role) + between, False), (self.escaped(text), False), (last, False)]


class Reader:
    """Reads turns back from formatted text."""

    def __init__(self, template: Template):
        self.t = template
        self._token = re.compile(f"{re.escape(template.escape)}.|" + "|".join(map(re.escape, template.controls())), re.S)
        self._escaped = re.compile(f"{re.escape(template.escape)}(.)", re.S)
        self._open = {turn.open.strip(): (role, turn) for role, turn in template.roles.items()}

    def unescaped(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def _control(self, text: str, at: int) -> re.Match:
        """The next string of the template from `at` on that is not escaped."""
        for m in self._token.finditer(text, at):
            if not m[0].startswith(self.t.escape):
                return m
        raise ValueError("a turn has no end")

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn."""
        at, (first, between, last) = 0, self.t.other
        while at < len(text):
            if text.startswith(first, at):
                middle = self._control(text, at + len(first))
                end = self._control(text, middle.start() + len(between))
                yield self.unescaped(text[at + len(first) : middle.start()]), self.unescaped(text[middle.start() + len(between) : end.start()])
                at = end.start() + len(last)
                continue
            role, turn = next(((r, t) for r, t in self._open.values() if text.startswith(t.open, at)), (None, None))
            if turn is None:
                raise ValueError(f"no turn opens at {at}")
            end = self._control(text, at + len(turn.open))
            start = end.start() - (len(turn.close) - len(turn.close.lstrip()))
            yield role, self.unescaped(text[at + len(turn.open) : start])
            at = start + len(turn.close)


class Machine:
    """The state of one conversation: the last role and the turns that were not allowed."""

    def __init__(self, template: Template):
        self.t, self.last, self.bad = template, None, 0

    def step(self, role: str) -> None:
        self.bad += role not in self.t.follows.get(self.last, ())
        self.last = role

    @property
    def valid(self) -> bool:
        return not self.bad and self.last in self.t.accepting


def format_conversations(rows: DataFrame, template: Template | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, segments (text and loss flag, in order), last (the conversation's last part), bad_turns and valid (so far; final where last).

    The parts of a conversation follow each other in one partition; nearly every conversation is one part.
    """
    template = template or Template()
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = rows.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    stream = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, none = Writer(template), object()
        at, machine, part, held, chars = none, Machine(template), 0, [], 0
        ready: list[tuple] = []

        def close(last: bool) -> None:
            ready.append((at, part, held, last, machine.bad, machine.valid))

        def batch_of(kind: pa.DataType) -> pa.RecordBatch:
            ids, parts, segments, lasts, bads, valids = zip(*ready, strict=True)
            made = [[{"text": t, "loss": f} for t, f in s] for s in segments]
            out = [pa.array(ids, kind), pa.array(parts, pa.int32()), pa.array(made, pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), pa.array(lasts), pa.array(bads, pa.int64()), pa.array(valids)]
            ready.clear()
            return pa.RecordBatch.from_arrays(out, ["conv_id", "part", "segments", "last", "bad_turns", "valid"])

        id_kind, size = None, 0
        for batch in batches:
            id_kind = batch.column(0).type
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if at is none or conv != at:
                    if at is not none:
                        close(True)
                    at, machine, part, held, chars = conv, Machine(template), 0, [], 0
                elif chars >= part_chars:
                    close(False)
                    part, held, chars = part + 1, [], 0
                if size >= part_chars and ready:
                    yield batch_of(id_kind)
                    size = 0
                role = role.as_py()
                machine.step(role)
                new = writer.segments(role, text.as_py())
                n = sum(len(t) for t, _ in new)
                held.extend(new)
                chars, size = chars + n, size + n
        if at is not none:
            close(True)
            yield batch_of(id_kind)

    return stream.mapInArrow(run, f"conv_id {kind.simpleString()}, {FORMATTED}")


class _Digests:
    """What read_back() says of one conversation."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, reader: Reader, segments: list[dict[str, Any]]) -> None:
        text = "".join(s["text"] for s in segments)
        self.chars += len(text)
        for role, said in reader.turns(text):
            self.turns += 1
            self.all.update(f"{role}\n{said}\n".encode())
        for s in segments:
            if s["loss"]:
                said = reader.unescaped(s["text"])
                self.loss_chars += len(said)
                self.loss.update(said.encode())


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation, read from its formatted parts alone: conv_id, n_turns, turns_sha256 (of role, newline, text, newline of each turn), loss_chars and loss_sha256
    (of the unescaped text under the loss flag), formatted_chars, bad_turns and valid.

    The parts of a conversation must follow each other in one partition, as format_conversations() leaves them; parts from elsewhere need
    repartition("conv_id").sortWithinPartitions("conv_id", "part") first.
    """
    template = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "bad_turns", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now = Reader(template), _Digests()
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                now.take(reader, batch.column("segments")[i].as_py())
                if batch.column("last")[i].as_py():
                    out.append((batch.column("conv_id")[i].as_py(), now.turns, now.all.hexdigest(), now.loss_chars, now.loss.hexdigest(), now.chars, batch.column("bad_turns")[i].as_py(), batch.column("valid")[i].as_py()))
                    now = _Digests()
            if out:
                kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, bad_turns long, valid boolean")


#: A conversation whose texts are nothing but strings of the template.
ADVERSE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def chats(rows: DataFrame) -> DataFrame:
    """The conversations and the adverse one, formatted and read back."""
    more = rows.sparkSession.createDataFrame(ADVERSE, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.select("conv_id", "turn", "role", "text").unionByName(more)))
