"""Chat formatting by grammar round trip.

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. The grammar is regular and each
turn is complete in itself, so a conversation is the concatenation of its turns and no group is ever
gathered: turns are rendered row by row, and parsed again from a stream sorted by conversation that
keeps only running digests in memory.

A field is first rendered as it is and the rendering parsed again. Where the result differs from the
source, the field is escaped and the check repeated. Escaping adds one backslash inside ``<|`` of a
control string and of everything that looks escaped already (``<\\|`` becomes ``<\\\\|``); parsing
removes one, so it is reversible for every text.

Null roles and texts are empty strings; a null turn comes first in its conversation, a null conv_id
is a conversation of its own; equal turns are ordered by role and text; repeated rows are kept; an
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# A line break in a role; a role that holds this string is escaped like one that holds a control string.
BREAK = "<|lf|>"
_CONFLICT = re.compile(r"<(\\+)\||<()\|(?=im_start\|>|im_end\|>)")
_BREAK = re.compile(r"<\|(?=lf\|>)")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_DIGESTS = (
    "conv_id BIGINT, n_turns BIGINT, turns_sha256 STRING, loss_chars BIGINT, loss_sha256 STRING, formatted_chars BIGINT"
)
SORT = ["conv_id", "turn", "role", "text"]


def escape(text: str) -> str:
    return _CONFLICT.sub(lambda m: f"<\\{m[1] or ''}|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|", text)


def escape_role(role: str) -> str:
    return _BREAK.sub(r"<\\|", escape(role)).replace("\n", BREAK)


def render(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def parse(rendered: str) -> list[tuple[str, str]]:
    """Turns of a rendered text; ValueError where it is not in the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        line = rendered.find("\n", at)
        stop = rendered.find(END, line + 1)
        head = rendered[at + len(START) : line]
        body = rendered[line + 1 : stop]
        if not rendered.startswith(START, at) or line < 0 or stop < 0 or rendered[stop + len(END) : stop + len(END) + 1] != "\n":
            raise ValueError(f"no turn at {at}")
        if START in head or END in head or START in body:
            raise ValueError(f"control string inside the turn at {at}")
        turns.append((unescape(head.replace(BREAK, "\n")), unescape(body)))
        at = stop + len(END) + 1
    return turns


def _parses_as(rendered: str, role: str, text: str) -> bool:
    try:
        return parse(rendered) == [(role, text)]
    except ValueError:
        return False


def render_turn(role: str, text: str) -> tuple[str, int, int, bool]:
    """Rendering, span of the text inside it, whether it had to be escaped.

    The first of: as it is, text escaped, role and text escaped, that parses back to the source.
    """
    for head, body in ((role, text), (role, escape(text)), (escape_role(role), escape(text))):
        out = render(head, body)
        if _parses_as(out, role, text):
            begin = len(START) + len(head) + 1
            return out, begin, begin + len(body), out != render(role, text)
    raise AssertionError(f"escaping failed for {role!r}, {text!r}")


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: its rendering and the span in it that the loss covers (null: none).

    The text of a conversation is the concatenation of ``formatted`` in the order of ``SORT``.
    """
    plain = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                out, begin, end, changed = render_turn(role, text)
                loss = role in loss_roles
                rows.append((out, begin if loss else None, end if loss else None, changed))
            out, begin, end, changed = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(out, pa.string()),
                    pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(changed, pa.bool_()),
                ],
                names=["conv_id", "turn", "role", "text", "formatted", "mask_start", "mask_end", "escaped"],
            )

    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, formatted STRING, mask_start INT, mask_end INT, escaped BOOLEAN"
    return plain.mapInArrow(run, schema)


class _Digest:
    """What is read back of one conversation, turn after turn."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, begin: int | None, end: int | None) -> None:
        for role, text in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if begin is not None:
            masked = unescape(formatted[begin:end])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(formatted: DataFrame) -> DataFrame:
    """Parse the formatted turns again: one row of counts and digests per conversation.

    One shuffle by conversation; each task walks its sorted rows once. However long a conversation
    is, only its running digests are held.
    """
    by_conversation = formatted.repartition("conv_id").sortWithinPartitions(*SORT).select("conv_id", "formatted", "mask_start", "mask_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Digest | None = None
        schema = pa.schema(
            [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
             ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        )

        def packed(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in done], schema=schema)

        for batch in batches:
            done = []
            for conv_id, *turn in zip(*[c.to_pylist() for c in batch.columns]):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = _Digest(conv_id)
                current.add(*turn)
            yield packed(done)
        if current is not None:
            yield packed([current.row()])

    return by_conversation.mapInArrow(run, _DIGESTS)
