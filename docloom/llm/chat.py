"""Chat formatting by a finite-state machine and a declarative template.

The template gives each role its opening and closing marks and whether its text bears loss. Turns of a conversation are read in order
by a machine whose transitions say which role may follow; a turn out of order is formatted too, and its segments say so. Marks inside texts
are escaped, so that the formatted text can be read back exactly: a backslash is doubled, and one is put after the first character of a mark.

Conversations are dealt by id and sorted by turn; a task streams through them and holds one turn at a time, however long a
conversation is. Null texts and roles count as empty. Turns with equal numbers stand in order of role and text. A role that the template lacks is
written with its name. Repeated rows are turns of their own, and a very long text is one segment. A conversation that is added to a table which holds its id
already becomes one with it. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import shuffle_partitions, text_slices


@dataclass(frozen=True)
class Part:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    parts: dict[str, Part]
    #: Which roles may follow which; "" is the beginning.
    follows: dict[str, tuple[str, ...]]
    #: For other roles; the role's name stands between the first two.
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    more_marks: tuple[str, ...] = ()
    marks: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = {m for p in self.parts.values() for m in (p.opening, p.closing)} | set(self.other) | set(self.more_marks)
        if any(len(m) < 2 or m[1] == "\\" for m in marks):
            raise ValueError("a mark needs two characters, the second no backslash")
        object.__setattr__(self, "marks", tuple(sorted(marks, key=lambda m: (-len(m), m))))

    def pattern(self) -> re.Pattern[str]:
        return re.compile("|".join(map(re.escape, self.marks)))


INSTRUCT = Template(
    parts={"system": Part("<<SYS>>", "<</SYS>>"), "user": Part("[INST]", "[/INST]"), "assistant": Part("<s>", "</s>", loss=True)},
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)


def escape(text: str, template: Template) -> str:
    text = text.replace("\\", "\\\\")
    for m in template.marks:
        text = text.replace(m, f"{m[0]}\\{m[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def segments(role: str, text: str, template: Template) -> list[tuple[str, bool]]:
    """(text, loss) of one turn."""
    if part := template.parts.get(role):
        return [(part.opening, False), (escape(text, template), part.loss), (part.closing, False)]
    a, b, c = template.other
    return [(a + escape(role, template) + b, False), (escape(text, template), False), (c, False)]


def format_turns(turns: DataFrame, template: Template = INSTRUCT, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments in order: (key, turn, segment, text, loss, in_order). Partitions hold whole conversations, sorted."""
    schema = T.StructType([turns.schema[key], turns.schema[turn], T.StructField("segment", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType()), T.StructField("in_order", T.BooleanType())])
    own = turns.select(key, turn, F.coalesce(role, F.lit("")).alias(role), F.coalesce(text, F.lit("")).alias(text))
    own = own.repartition(shuffle_partitions(turns.sparkSession), key).sortWithinPartitions(key, turn, role, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), ""
        for b in text_slices(batches, text):
            rows, owner = [], []
            for i, (conv, who, said) in enumerate(zip(b.column(key).to_pylist(), b.column(role).to_pylist(), b.column(text).to_pylist(), strict=True)):
                if conv != last:
                    last, state = conv, ""
                fits = who in template.follows.get(state, ())
                state = who
                for n, (s, loss) in enumerate(segments(who, said, template)):
                    owner.append(i)
                    rows.append((n, s, loss, fits))
            at = pa.array(owner)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.bool_(), pa.bool_()), strict=True)]
            yield pa.record_batch([b.column(key).take(at), b.column(turn).take(at), *columns], schema.names)

    return own.mapInArrow(run, schema)


class Reader:
    """Reads a conversation back from its formatted text, segment after segment."""

    def __init__(self, template: Template):
        self.template, self.pattern = template, template.pattern()
        self.roles = {p.opening: (r, p.closing) for r, p in template.parts.items()}
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.odd = 0
        self.pending = ""

    def add(self, text: str, loss: bool, in_order: bool) -> None:
        self.chars += len(text)
        if loss:
            said = unescape(text)
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        self.pending += text
        found = list(self.pattern.finditer(text))
        if found and found[-1].end() == len(text):
            self._turn(in_order)

    def _turn(self, in_order: bool) -> None:
        marks = list(self.pattern.finditer(self.pending))
        opening, closing = marks[0], marks[-1]
        if opening[0] in self.roles:
            role, wanted = self.roles[opening[0]]
            begin = opening.end()
        else:
            middle, wanted = marks[1] if len(marks) > 1 else None, self.template.other[2]
            if middle is None or middle[0] != self.template.other[1]:
                return
            role, begin = unescape(self.pending[opening.end() : middle.start()]), middle.end()
        if closing[0] != wanted or opening.start() or closing.start() < begin:
            return
        self.turns.update(f"{role}\n{unescape(self.pending[begin : closing.start()])}\n".encode())
        self.n_turns += 1
        self.odd += not in_order
        self.pending = ""

    def row(self) -> tuple:
        if self.pending:
            raise ValueError(f"text without an end: {self.pending[:80]!r}")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.odd


def read_back(formatted: DataFrame, template: Template = INSTRUCT, key: str = "conv_id") -> DataFrame:
    """Per conversation what its formatted text and loss mask say: turns, digests, lengths, and turns out of order."""
    numbers = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()), ("turns_out_of_order", T.LongType())]
    schema = T.StructType([formatted.schema[key], *(T.StructField(n, t) for n, t in numbers)])
    kinds = [pa.string() if isinstance(t, T.StringType) else pa.int64() for _, t in numbers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reader, kind = None, None, None

        def done(rows: list[tuple]) -> pa.RecordBatch:
            ids, *rest = zip(*rows, strict=True)
            return pa.record_batch([pa.array(ids, kind), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], schema.names)

        for b in batches:
            kind, out = b.column(key).type, []
            for conv, text, loss, fits in zip(*(b.column(c).to_pylist() for c in (key, "text", "loss", "in_order")), strict=True):
                if reader is None or conv != last:
                    if reader:
                        out.append((last, *reader.row()))
                    last, reader = conv, Reader(template)
                reader.add(text, loss, fits)
            if out:
                yield done(out)
        if reader:
            yield done([(last, *reader.row())])

    return formatted.mapInArrow(run, schema)
