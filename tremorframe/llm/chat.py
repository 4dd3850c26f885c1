"""Formats conversations with a chat template and finds each turn in the output.

A template is a black box: ``render(turns) -> str`` for (role, text) turns.  Its
successive prefixes are rendered and consecutive outputs compared: what the
output of k turns has after that of k - 1 is turn k.  Rendering turn k twice
more, with its text replaced by either of two probes, shows where in there the
text stands.  Where an output does not begin with the one before, the template
has rewritten history: the conversation gets its text and the number of that
turn, and no spans.

So that a conversation of n turns does not take n renderings of n turns, the
prefixes begin ``WINDOW`` turns back; if the pieces so found, joined, are not
the rendering of the whole conversation, all prefixes are rendered from its
first turn on.

``Instruct`` is the template of the query: control strings in texts and role
names get a backslash more than they have after their first character, so an
output has unescaped control strings where the template put them alone.

Nulls: a null text or role is the empty one; turns are ordered by turn (null
first), role, text, so rows that tie come in a defined order, and repeated rows
are turns of their own.  Rows without a conv_id are one conversation.  An empty
table has none.  A conversation is one value: rows travel in order of their
turns, and one task holds one conversation and what it has been formatted to.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_arrow

#: Turns before a turn that its prefixes begin with.
WINDOW = 8
#: Roles whose texts are trained on.
TRAINED = ("assistant",)

Turn = tuple[str, str]


class Template(Protocol):
    """What format_chats and read_back need."""

    def render(self, turns: list[Turn]) -> str: ...

    def parse(self, text: str) -> list[Turn]:
        """The turns of an output."""

    def unescape(self, text: str) -> str:
        """A text as it was before it was put into an output."""


#: Control strings begin with < or [; an escaped one has backslashes after that.
CONTROL = r"<(\\*)(/?s>)|\[(\\*)(/?(?:INST|ROLE|TEXT)\])"
_CONTROL = re.compile(CONTROL)


class Instruct:
    """<s>, then ``[INST] text [/INST]`` for a user, `` text</s>`` for an assistant, ``[ROLE]name[TEXT]text[/ROLE]`` for others."""

    def escape(self, text: str) -> str:
        if "<" not in text and "[" not in text:
            return text
        return _CONTROL.sub(lambda m: f"<\\{m[1]}{m[2]}" if m[2] else f"[\\{m[3]}{m[4]}", text)

    def unescape(self, text: str) -> str:
        return _CONTROL.sub(lambda m: f"<{m[1][1:]}{m[2]}" if m[2] else f"[{m[3][1:]}{m[4]}", text)

    def render(self, turns: list[Turn]) -> str:
        e = self.escape
        return "<s>" + "".join(f"[INST] {e(t)} [/INST]" if r == "user" else f" {e(t)}</s>" if r == "assistant" else f"[ROLE]{e(r)}[TEXT]{e(t)}[/ROLE]" for r, t in turns)

    def parse(self, text: str) -> list[Turn]:
        out, at = [], len("<s>")
        while at < len(text):
            if text.startswith("[INST] ", at):
                end = text.index(" [/INST]", at)
                turn, at = ("user", text[at + 7 : end]), end + 8
            elif text.startswith("[ROLE]", at):
                mid, end = text.index("[TEXT]", at), text.index("[/ROLE]", at)
                turn, at = (self.unescape(text[at + 6 : mid]), text[mid + 6 : end]), end + 7
            else:
                end = text.index("</s>", at)
                turn, at = ("assistant", text[at + 1 : end]), end + 4
            out.append((turn[0], self.unescape(turn[1])))
        return out


def _common(a: str, b: str) -> int:
    """The length of what both begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


class Rewritten(Exception):
    """The output of one more turn does not begin with that of the turns before."""

    def __init__(self, turn: int) -> None:
        super().__init__(turn)
        self.turn = turn


def _piece(template: Template, turns: list[Turn], k: int, first: int) -> tuple[str, int, int]:
    """What turn k adds to the turns from first on, and how much of it stands before and after the text."""
    before, role = turns[first:k], turns[k][0]
    old, new = template.render(before), template.render([*before, turns[k]])
    if not new.startswith(old):
        raise Rewritten(k)
    one, two = (template.render([*before, (role, probe)]) for probe in "01")
    head = _common(one, two)
    return new[len(old) :], head - len(old), len(one) - head - 1


def spans(template: Template, turns: list[Turn], window: int = WINDOW) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The output and for each turn start, stop, and start and stop of its text; raises Rewritten."""
    whole = template.render(turns)
    for back in dict.fromkeys((min(window, len(turns)), len(turns))):
        try:
            pieces = [_piece(template, turns, k, max(0, k - back)) for k in range(len(turns))]
        except Rewritten:
            if back < len(turns):
                continue
            raise
        start = len(template.render([]))
        if template.render([]) + "".join(p for p, _, _ in pieces) == whole:
            out = []
            for piece, head, tail in pieces:
                out.append((start, start + len(piece), start + head, start + len(piece) - tail))
                start += len(piece)
            return whole, out
    raise Rewritten(len(turns) - 1)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Turn]]]:
    """Rows in order of conv_id as one list of turns for each."""
    key, turns, any_row = None, [], False
    for batch in batches:
        for c, r, t in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if any_row and c != key:
                yield key, turns
                turns = []
            key, any_row = c, True
            turns.append((r, t))
    if any_row:
        yield key, turns


SPANS = "text string, turns array<struct<role: string, start: bigint, stop: bigint, text_start: bigint, text_stop: bigint, loss: boolean>>, rewrites int"


def format_chats(rows: DataFrame, template: Template | None = None, trained: tuple[str, ...] = TRAINED, window: int = WINDOW) -> DataFrame:
    """conv_id, text, turns, rewrites for rows (conv_id, turn, role, text).

    turns has each turn's span, its text's span and whether that is trained on;
    rewrites is the first turn (from 0) whose output changes what stood before.
    """
    template = template or Instruct()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = rows.select("conv_id", "turn", text("role"), text("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(SPANS).fields])
    arrow = pa.list_(pa.struct([("role", pa.string()), *((c, pa.int64()) for c in ("start", "stop", "text_start", "text_stop")), ("loss", pa.bool_())]))

    def run(batches):
        kind, held, size = None, [], 0

        def batch_of(rows):
            ids, texts, turns, rewrites = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(texts, pa.string()), pa.array(turns, arrow), pa.array(rewrites, pa.int32())], names=["conv_id", "text", "turns", "rewrites"])

        def seen():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        for key, turns in _conversations(seen()):
            try:
                out, found = spans(template, turns, window)
                found, rewrites = [dict(zip(("role", "start", "stop", "text_start", "text_stop", "loss"), (r, *s, r in trained), strict=True)) for (r, _), s in zip(turns, found, strict=True)], None
            except Rewritten as e:
                out, found, rewrites = template.render(turns), None, e.turn
            held.append((key, out, found, rewrites))
            size += len(out)
            if size > 1 << 20:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    return map_arrow(rows, run, schema)


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id and digests of what the formatted texts say: all turns as parsed, and all text under the loss mask."""
    template = template or Instruct()
    schema = T.StructType([chats.schema["conv_id"], *T.StructType.fromDDL(DIGESTS).fields])
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches):
        for batch in batches:
            out = []
            for text, turns in zip(batch["text"].to_pylist(), batch["turns"].to_pylist(), strict=True):
                parsed = template.parse(text)
                loss = "".join(template.unescape(text[t["text_start"] : t["text_stop"]]) for t in turns or () if t["loss"])
                out.append((len(parsed), digest("".join(f"{r}\n{t}\n" for r, t in parsed)), len(loss), digest(loss), len(text)))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["conv_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return map_arrow(chats.select("conv_id", "text", "turns"), run, schema)
