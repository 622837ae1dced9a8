"""Chat formatting: a state machine over roles, a declarative template, loss flags.

One conversation is one ordered text, so its turns pass through one task in order; a turn
at a time is held, whatever the conversation's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from libsight.session import ship


@dataclass(frozen=True)
class Turn:
    """How one role is written: control strings around the text, and whether it is learned."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Declarative chat template.

    ``turns`` gives each role's marks.  Any other role is written with its name between
    ``other`` marks.  ``order`` is the state machine: (state, role) -> state; a pair it lacks
    is an error, and a conversation must end in one of ``final``.  Control strings may not
    hold the escape character; marks that open turns must differ from one another.
    """

    turns: dict[str, Turn]
    order: dict[tuple[str, str], str]
    start: str = "start"
    final: tuple[str, ...] = ()
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    escape: str = "\\"
    control: tuple[str, ...] = field(default=())

    def __post_init__(self):
        marks = {m for t in self.turns.values() for m in (t.before, t.after)} | set(self.other)
        marks |= set(self.control)
        if any(not m or self.escape in m for m in marks):
            raise ValueError("control strings must be non-empty and free of the escape character")
        openers = [t.before for t in self.turns.values()] + [self.other[0]]
        if any(a != b and a.startswith(b) for a in openers for b in openers) or (
                len(set(openers)) < len(openers)):
            raise ValueError("opening marks must tell roles apart")
        firsts = sorted({m[0] for m in marks})
        object.__setattr__(self, "_code", {c: chr(ord("a") + i) for i, c in enumerate(firsts)})
        object.__setattr__(self, "_back", {v: k for k, v in self._code.items()}
                           | {self.escape: self.escape})
        listed = "|".join(map(re.escape, sorted(marks, key=len, reverse=True)))
        object.__setattr__(self, "_find", f"{re.escape(self.escape)}|(?=(?:{listed}))[\\s\\S]")
        object.__setattr__(self, "_undo", f"{re.escape(self.escape)}([\\s\\S])")

    def hide(self, text: str) -> str:
        """Text in which no control string occurs; ``show`` gives the text back.

        The first character of every control string becomes the escape character and a letter.
        """
        return re.sub(self._find, lambda m: self.escape + self._code.get(m[0], self.escape), text)

    def show(self, text: str) -> str:
        return re.sub(self._undo, lambda m: self._back[m[1]], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        turn = self.turns.get(role)
        if turn:
            return [(turn.before, False), (self.hide(text), turn.loss), (turn.after, False)]
        begin, middle, end = self.other
        return [(begin + self.hide(role) + middle, False), (self.hide(text), False), (end, False)]

    def read_turn(self, text: str, at: int) -> tuple[str, str, int] | None:
        """The turn that starts at ``at``: role, text, end; None if it isn't whole yet."""
        for role, turn in self.turns.items():
            if text.startswith(turn.before, at):
                begin = at + len(turn.before)
                end = text.find(turn.after, begin)
                return None if end < 0 else (role, self.show(text[begin:end]), end + len(turn.after))
        begin, middle, end = self.other
        if not text.startswith(begin, at):
            return None
        cut = text.find(middle, at)
        stop = text.find(end, cut) if cut >= 0 else -1
        if stop < 0:
            return None
        return (self.show(text[at + len(begin):cut]), self.show(text[cut + len(middle):stop]),
                stop + len(end))


#: A system turn may open; then user and assistant alternate; it ends on either.
INSTRUCT = Template(
    turns={"system": Turn("<<SYS>>", "<</SYS>>\n"), "user": Turn("[INST]", "[/INST]"),
           "assistant": Turn("<s>", "</s>\n", loss=True)},
    order={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
           ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    final=("user", "assistant"), control=("</s>", "<</SYS>>"))

_TURNS = ("conv_id bigint, position bigint, role string, "
          "segments array<struct<text:string,loss:boolean>>, state string, valid boolean")
_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_chat(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per turn, in order within each conversation: its text segments and loss flags.

    Input columns ``conv_id, turn, role, text``; others are ignored.  Output ``conv_id,
    position`` (from 0), ``role, segments, state`` (after the turn; ``error`` once the order
    is broken, and from then on), ``valid``.  The formatted text is all segments joined.
    Null text or role: empty.  Null conv_id: a conversation of its own.  Equal turn numbers
    are ordered by role, then text; repeated rows are repeated turns.  Null turn numbers come
    first.  Badly ordered conversations are formatted all the same.  Empty input: no rows.
    """
    ship(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, position = object(), template.start, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            ids, _, roles, texts = (c.to_pylist() for c in batch.columns)
            for conv, role, text in zip(ids, roles, texts):
                if conv != current:
                    current, state, position = conv, template.start, 0
                state = template.order.get((state, role), "error")
                parts = [{"text": t, "loss": f} for t, f in template.segments(role, text)]
                for column, value in zip(out, (conv, position, role, parts, state, state != "error")):
                    column.append(value)
                position += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.string()), pa.array(out[3], _SEGMENTS),
                 pa.array(out[4], pa.string()), pa.array(out[5], pa.bool_())],
                names=["conv_id", "position", "role", "segments", "state", "valid"])

    return ordered.mapInArrow(run, _TURNS)


class _Reader:
    """Reads one conversation back from its formatted text, piece by piece."""

    def __init__(self, template: Template):
        self.template, self.text, self.turns = template, "", 0
        self.digest, self.loss = hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.chars = 0
        self.state, self.valid = template.start, True

    def feed(self, segments: list[dict]) -> None:
        for part in segments:
            self.text += part["text"]
            self.chars += len(part["text"])
            if part["loss"]:
                shown = self.template.show(part["text"])
                self.loss_chars += len(shown)
                self.loss.update(shown.encode("utf-8", "surrogatepass"))
        at = 0
        while at < len(self.text) and (got := self.template.read_turn(self.text, at)):
            role, text, at = got
            self.digest.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.state = self.template.order.get((self.state, role), "error")
            self.turns += 1
        self.text = self.text[at:]

    def row(self, conv: int | None) -> tuple:
        if self.text:
            raise ValueError(f"conversation {conv}: the formatted text does not read back")
        return (conv, self.turns, self.digest.hexdigest(), self.loss_chars,
                self.loss.hexdigest(), self.chars, self.state in self.template.final)


def read_back(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation, what its formatted text says when it is parsed again.

    ``turns`` must come straight from ``format_chat`` (whose partitions hold whole
    conversations in order).  ``valid``: the state machine accepts the turns read.
    """
    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
              "loss_sha256 string, formatted_chars bigint, valid boolean")
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        current, reader, done = None, None, []
        for batch in batches:
            for conv, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if reader is None or conv != current:
                    if reader is not None:
                        done.append(reader.row(current))
                    current, reader = conv, _Reader(template)
                reader.feed(segments)
            if done:
                yield pack(done)
                done = []
        if reader is not None:
            yield pack([*done, reader.row(current)])

    return turns.select("conv_id", "segments").mapInArrow(run, schema)
