r"""Chat formatting: a finite-state machine over roles walks each conversation's turns and emits text
segments with a loss flag, from a declarative template.

Control strings all begin with `<|`. Inside roles and texts each `<`, any backslashes and `|` gets
one backslash more before the `|`, so no control string can occur there and reading back is exact;
texts without that sequence stay as they are.

Turns of a conversation are sorted by the shuffle and streamed: a task holds one turn and the
machine's state, so one conversation of any length needs no memory. (Its digests are sequential by
definition, so one task reads it.)

Defined results: a null text or role is empty; rows of one turn number are ordered by role and text;
null turns come first; null conversation ids are one conversation; repeated rows are turns of their
own; empty tables give empty results; texts are held whole, one at a time; columns besides conv_id, turn,
role and text aren't read. Turns in a wrong order are formatted like others, with order_ok false from the first on.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands before a role, between role and text, and after a text; whose texts are learnt;
    and for each state, the roles that may come next. The state after a turn is its role. Control strings
    that don't begin with <| are refused: texts could hold them unescaped."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>\n"
    loss: frozenset = frozenset({"assistant"})
    first: str = ""
    follows: dict = field(
        default_factory=lambda: {
            "": {"system", "user"},
            "system": {"user"},
            "user": {"assistant"},
            "assistant": {"user", "tool"},
            "tool": {"assistant", "tool"},
        }
    )

    def __post_init__(self):
        for control in (self.turn, self.text, self.end):
            if not control.startswith("<|") or len({self.turn, self.text, self.end}) < 3:
                raise ValueError("control strings begin with <| and differ")


TEMPLATE = Template()
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<(\\*)\\\|")


def escaped(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text) if "|" in text else text


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "|" in text else text


def segments(role: str, text: str, template: Template = TEMPLATE) -> list[tuple[str, bool]]:
    """Of one turn: pieces of formatted text, each with whether it's under the loss mask."""
    head = f"{template.turn}{escaped(role)}{template.text}"
    if role in template.loss:
        return [(head, False), (escaped(text), True), (template.end, False)]
    return [(f"{head}{escaped(text)}{template.end}", False)]


SEGMENTS = "conv_id long, turn long, segment int, text string, loss boolean, order_ok boolean"


def format_chats(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """SEGMENTS rows; those of a conversation follow one another in one partition."""

    def run(batches):
        last, state, ok, begun = None, template.first, True, False
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                role, text = role or "", text or ""
                if not begun or conv != last:
                    last, state, ok, begun = conv, template.first, True, True
                ok = ok and role in template.follows.get(state, ())
                state = role
                rows += [(conv, turn, i, s, loss, ok) for i, (s, loss) in enumerate(segments(role, text, template))]
            yield _batch(rows, [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()], SEGMENTS)

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, SEGMENTS)


def _batch(rows: list[tuple], types: list, ddl: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


class Reader:
    """Reads the segments of one conversation back, in order, and digests what they say."""

    def __init__(self, template: Template):
        self.template = template
        self.turns, self.learnt = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.ok = True
        self.control = re.compile("(" + "|".join(re.escape(c) for c in (template.turn, template.text, template.end)) + ")")

    def read(self, segment: str, loss: bool, ok: bool) -> None:
        self.chars += len(segment)
        self.ok = self.ok and ok
        if loss:
            text = unescaped(segment)
            self.loss_chars += len(text)
            self.learnt.update(text.encode("utf-8"))
        for part in self.control.split(segment):
            if part == self.template.turn:
                self.n_turns += 1
            elif part in (self.template.text, self.template.end):
                self.turns.update(b"\n")
            elif part:
                self.turns.update(unescaped(part).encode("utf-8"))

    def row(self, conv) -> tuple:
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.learnt.hexdigest(), self.chars, self.ok


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, order_ok boolean"


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """A READ row for each conversation of format_chats' output, from its segments alone."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches):
        reader, last = None, None
        for batch in batches:
            rows = []
            for conv, text, loss, ok in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "order_ok"))):
                if reader is None or conv != last:
                    if reader is not None:
                        rows.append(reader.row(last))
                    reader, last = Reader(template), conv
                reader.read(text, loss, ok)
            yield _batch(rows, types, READ)
        yield _batch([reader.row(last)] if reader is not None else [], types, READ)

    return formatted.select("conv_id", "text", "loss", "order_ok").mapInArrow(run, READ)
