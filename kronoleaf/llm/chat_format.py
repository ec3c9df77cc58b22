"""Chat formatting with a template that is only ever called, never looked into.

A template turns a list of (role, text) turns into one string. For each turn the
string of the turns up to it is compared with that of the turns before: where the
former merely goes on, the turn's span is what was added; where it does not, the
template has rewritten history. The place of the text inside the span is found by
rendering the same turn with a probe in place of its text.

Rows are dealt by conversation and sorted by turn, and a task goes through them as a
stream. A conversation of any length needs little memory: once the rendered prefix
is long, the turns before the last `context` are let go, after a check that the template
gives the same span without them. A conversation is one stream, since the digests over its
turns are sequential; nothing of it but a few turns is ever held.

Cases: null text is empty, null role is the empty role; rows of one conversation go by
turn (null first), then role, then text; equal rows are turns of their own; a null conv_id is a
conversation like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Turn = tuple[str, str]
PROBE = "\ue000\ue001\ue000"
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>|: ")
#: Characters of a rendered prefix beyond which turns before the last `context` are let go.
WINDOW_CHARS = 1 << 15
BATCH_CHARS = 1 << 20


def escape(text: str, role: bool = False) -> str:
    """The text with a backslash before each control string; in a role, the string after roles is one too."""
    return _CONTROL.sub(lambda m: m[0] if m[0] == BETWEEN and not role else "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|: )", r"\1", text)


@dataclass(frozen=True)
class Template:
    """`render` may depend on the turns it gets, a turn's part on `context` turns before it at most; `trailer` ends each rendering."""

    render: Callable[[Sequence[Turn]], str]
    context: int = 1
    trailer: str = ""


def _marked(turns: Sequence[Turn]) -> str:
    return "".join(f"{OPEN}{escape(role, True)}{BETWEEN}{escape(text)}{CLOSE}" for role, text in turns)


MARKED = Template(_marked)


def _first(buffer: str, mark: str, at: int) -> int:
    """Where the first `mark` without a backslash before it begins; -1 if there is none."""
    for m in re.finditer(r"\\.|" + re.escape(mark), buffer[at:] if at else buffer, re.S):
        if m[0] == mark:
            return at + m.start()
    return -1


def read_turns(buffer: str) -> tuple[list[Turn], str]:
    """The whole turns at the start of text formatted by `MARKED`, unescaped, and what is left of it."""
    turns, at = [], 0
    while buffer.startswith(OPEN, at) and (end := _first(buffer, CLOSE, at)) >= 0:
        body = buffer[at + len(OPEN) : end]
        cut = _first(body, BETWEEN, 0)
        turns.append((unescape(body[:cut]), unescape(body[cut + len(BETWEEN) :])))
        at = end + len(CLOSE)
    return turns, buffer[at:]


class Prefixes:
    """Successive prefixes of one conversation."""

    def __init__(self, template: Template):
        self.template, self.turns, self.length = template, [], 0
        self.out = self._rendered([])

    def _rendered(self, turns: Sequence[Turn]) -> str:
        return self.template.render(turns).removesuffix(self.template.trailer)

    def add(self, role: str, text: str) -> tuple[str | None, int, int, int | None, int | None, bool]:
        """What the turn adds, its start and end in the whole output, those of its text, and whether history was rewritten.

        Without an addition (null) if the output so far has changed; without a place of the
        text if the template gives texts another surrounding than the probe.
        """
        longer = self._rendered([*self.turns, (role, text)])
        kept, start = longer.startswith(self.out), self.length
        piece = longer[len(self.out) :] if kept else None
        self.length += len(longer) - len(self.out)
        begin = end = None
        if kept:
            probe = self._rendered([*self.turns, (role, PROBE)])
            head, found, foot = probe[len(self.out) :].partition(PROBE)
            if probe.startswith(self.out) and found and PROBE not in foot and len(piece) >= len(head) + len(foot) and piece.startswith(head) and piece.endswith(foot):
                begin, end = start + len(head), self.length - len(foot)
        self.turns.append((role, text))
        self.out = longer
        few = self.template.context
        if len(longer) > WINDOW_CHARS and len(self.turns) > few + 1 and kept:
            before = self._rendered(self.turns[-few - 1 : -1])
            if self._rendered(self.turns[-few - 1 :]) != before + piece:
                raise ValueError(f"the template reads more than {few} turns back; give it a larger context")
            self.turns = self.turns[-few:] if few else []
            self.out = self._rendered(self.turns)
        return piece, start, self.length, begin, end, not kept


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, chars: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + chars(row)
        if size > BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def format_turns(conversations: DataFrame, template: Template = MARKED, loss_role: str = "assistant") -> DataFrame:
    """A row a turn: conv_id, position (from 0), role, text as formatted (`piece`), its span, its text's span, loss, rewritten.

    Spans count code points of the whole output, which is the pieces of a conversation in
    order. `loss`: the text's span is under the loss mask. `rewritten`: the turn changed what
    was rendered before it, and has no piece. Rows of a conversation are in one partition, in order.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, position long, role string, piece string, start long, end long, text_start long, text_end long, loss boolean, rewritten boolean"
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        own = first.schema.field("conv_id").type
        fields = [("conv_id", own), ("position", pa.int64()), ("role", pa.string()), ("piece", pa.string()), *((x, pa.int64()) for x in ("start", "end", "text_start", "text_end")), ("loss", pa.bool_()), ("rewritten", pa.bool_())]

        def turns() -> Iterator[tuple]:
            last, prefixes, position = object(), None, 0
            for conv, role, text in _rows(chain([first], batches)):
                if conv != last:
                    last, prefixes, position = conv, Prefixes(template), 0
                piece, start, end, begin, stop, rewritten = prefixes.add(role, text)
                yield conv, position, role, piece, start, end, begin, stop, role == loss_role and begin is not None, rewritten
                position += 1

        yield from _batched(turns(), pa.schema(fields), lambda r: len(r[3] or ""))

    return rows.mapInArrow(run, schema)


def digests(pieces: DataFrame) -> DataFrame:
    """A row a conversation, read back from the pieces of `format_turns` with `MARKED`, in their order.

    Turns are parsed out of the formatted text, the loss out of the spans under the mask.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        own = first.schema.field("conv_id").type
        fields = [("conv_id", own), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

        def conversations() -> Iterator[tuple]:
            conv = state = None
            for now, piece, start, begin, stop, loss in _rows(chain([first], batches)):
                if state is None or now != conv:
                    if state is not None:
                        yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                    conv, state, rest = now, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], ""
                found, rest = read_turns(rest + (piece or ""))
                state[0] += len(found)
                state[4] += len(piece or "")
                for role, text in found:
                    state[1].update(f"{role}\n{text}\n".encode())
                if loss:
                    text = unescape(piece[begin - start : stop - start])
                    state[2] += len(text)
                    state[3].update(text.encode())
            if state is not None:
                yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        yield from _batched(conversations(), pa.schema(fields), lambda r: 128)

    return pieces.select("conv_id", "piece", "start", "text_start", "text_end", "loss").mapInArrow(run, schema)
