"""Chat formatting by a finite-state machine over roles.

A declarative `Template` names the states, the roles each lets through, and the control strings around each role's text.
Rows of a conversation arrive sorted by turn and leave as segments: text, whether the loss counts it, and the state
reached. Control strings inside texts and roles are escaped reversibly, so the segments' texts, put together, can be
parsed back (`read_back`). Rows stream through, so memory holds one turn at a time however long a conversation is.

Defined results: null texts and roles count as empty; a turn out of order (also an unknown or empty role) is formatted
all the same, leaves the state as it is and makes the conversation invalid; rows that repeat a turn stay, ordered by
role and then text; null turns come first; null conv_ids form one conversation; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import partitions

BATCH_ROWS = 2_000


@dataclass(frozen=True)
class Template:
    """around: the control strings before and after a role's text. other: the same for any other role, with a string
    between role and text. moves: state, then role to next state. final: states in which a conversation may end."""

    around: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("<s>[INST]", "[/INST]"), "assistant": ("<<ANS>>", "</s>")}
    )
    other: tuple[str, str, str] = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>")
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)
    extra_controls: tuple[str, ...] = ("<s>", "[INST]")

    @property
    def controls(self) -> list[str]:
        strings = {*self.extra_controls, *self.other, *(s for pair in self.around.values() for s in pair)}
        return sorted(strings, key=lambda s: (-len(s), s))


class Codec:
    """Escapes a template's control strings: each becomes a backslash and a letter, a backslash becomes two."""

    def __init__(self, template: Template) -> None:
        strings = template.controls
        if len(strings) > 26 or any("\\" in s for s in strings):
            raise ValueError("at most 26 control strings, none with a backslash")
        self.code = {s: "\\" + chr(ord("a") + i) for i, s in enumerate(strings)} | {"\\": "\\\\"}
        self.text = {v: k for k, v in self.code.items()}
        self.find = re.compile("|".join(re.escape(s) for s in [*strings, "\\"]))
        self.found = re.compile(r"\\[a-z\\]")

    def escape(self, text: str) -> str:
        return self.find.sub(lambda m: self.code[m[0]], text)

    def restore(self, text: str) -> str:
        return self.found.sub(lambda m: self.text[m[0]], text)


SEGMENTS = "conv_id bigint, segment string, loss boolean, state string, valid boolean"
_SEGMENTS = pa.schema(
    [("conv_id", pa.int64()), ("segment", pa.string()), ("loss", pa.bool_()), ("state", pa.string()), ("valid", pa.bool_())]
)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _sent(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == BATCH_ROWS:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
            some = []
    if some:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _format(rows: Iterator[tuple], template: Template) -> Iterator[tuple]:
    codec = Codec(template)
    current: object = rows  # no conv_id
    state, valid = template.start, True
    for conv_id, role, text in rows:
        if conv_id != current:
            current, state, valid = conv_id, template.start, True
        step = template.moves.get(state, {}).get(role)
        state, valid = step or state, valid and step is not None
        if role in template.around:
            before, after = template.around[role]
        else:
            before, after = template.other[0] + codec.escape(role) + template.other[1], template.other[2]
        yield conv_id, before, False, state, valid
        yield conv_id, codec.escape(text), role in template.trained, state, valid
        yield conv_id, after, False, state, valid


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """The segments of every conversation, a conversation's in order within one partition.

    segment: formatted text; loss: whether the loss counts it; state: the machine's state after the turn; valid: whether
    all turns so far came in an order that the template knows.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(_format(_rows(batches), template), _SEGMENTS)

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("turn").cast("long").alias("turn"),
    )
    dealt = turns.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


_READ = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())]
    + [("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("final", pa.bool_())]
)


def _read(rows: Iterator[tuple], template: Template) -> Iterator[tuple]:
    codec = Codec(template)
    token = re.compile("|".join(re.escape(s) for s in sorted({*template.other, *(s for p in template.around.values() for s in p)}, key=len, reverse=True)))
    opened = {before: role for role, (before, _) in template.around.items()}
    closed = {template.other[2], *(after for _, after in template.around.values())}
    current: object = rows  # no conv_id
    row: list = []
    turns = loss = None

    def done() -> tuple:
        return row[0], row[1], turns.hexdigest(), row[2], loss.hexdigest(), row[3], row[4], row[5] in template.final

    role, named, held = None, False, ""
    for conv_id, segment, counted, state, valid in rows:
        if conv_id != current:
            if turns is not None:
                yield done()
            current, row, turns, loss = conv_id, [conv_id, 0, 0, 0, True, ""], hashlib.sha256(), hashlib.sha256()
            role, named, held = None, False, ""
        row[3] += len(segment)
        row[4:] = [valid, state]
        if counted:
            own = codec.restore(segment)
            row[2] += len(own)
            loss.update(own.encode("utf-8", "surrogatepass"))
        at = 0
        for m in token.finditer(segment):
            held += segment[at : m.start()]
            at = m.end()
            if m[0] in opened and role is None and not named:
                role, held = opened[m[0]], ""
            elif m[0] == template.other[0]:
                named, held = True, ""
            elif m[0] == template.other[1] and named:
                role, named, held = codec.restore(held), False, ""
            elif m[0] in closed:
                turns.update(f"{role}\n{codec.restore(held)}\n".encode("utf-8", "surrogatepass"))
                row[1] += 1
                role, held = None, ""
        held += segment[at:]
    if turns is not None:
        yield done()


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, parsed from the formatted text: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, valid (turn order), final (it may end there). `segments` as `format_conversations` gives them."""
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(_read(_rows(batches), template), _READ)

    kinds = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean, final boolean"
    return segments.mapInArrow(run, kinds)
