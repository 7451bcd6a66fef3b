"""Chat formatting by a finite-state machine over roles.

A template declares marks around each role's text, which roles' texts carry loss, and which role may follow which. A
conversation's turns are walked in order; the machine checks each step and emits text segments, each with a loss flag.
Marks inside texts are escaped reversibly, and no mark's end is another one's beginning, so the formatted text can be read
back exactly.

Turns are dealt by conversation and sorted (spilling sort), then streamed: memory holds one turn, however long the
conversation. A digest over a whole conversation is sequential by nature, so that part runs in one task a conversation.

Edge cases: null text is empty; null role is the empty role; roles that the template does not name are written with their
name; a turn that breaks the order is formatted all the same, and the conversation's `error` says which was the first; null
conversation ids form one conversation; turns that tie are ordered by role, then text; repeated rows are turns of their own.
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

from terraloom.llm.common import materialize


@dataclass(frozen=True)
class Template:
    """Marks and rules. roles: role -> (open, close, has loss); other: marks before a role's name, after it, and at the end."""

    roles: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    escape: str = "␛"
    #: state -> roles that may come next; the state after a turn is its role
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: states in which a conversation may end
    ends: tuple[str, ...] = ("user", "assistant")

    @property
    def marks(self) -> list[str]:
        return sorted({m for r in self.roles.values() for m in r[:2]} | set(self.other), key=lambda m: (-len(m), m))

    def check(self) -> None:
        """Marks must be readable: none within another, none beginning as another ends."""
        for a in self.marks:
            if not a or self.escape in a:
                raise ValueError(f"mark {a!r} is empty or has the escape character")
            for b in self.marks:
                if a != b and a in b or any(a[k:] == b[: len(a) - k] for k in range(1, len(a))):
                    raise ValueError(f"marks {a!r} and {b!r} can't be told apart")

    def quote(self, text: str) -> str:
        codes = {m: self.escape + chr(ord("A") + k) for k, m in enumerate([self.escape, *self.marks])}
        return re.sub("|".join(map(re.escape, codes)), lambda m: codes[m[0]], text)

    def plain(self, text: str) -> str:
        marks = [self.escape, *self.marks]
        return re.sub(re.escape(self.escape) + "(.)", lambda m: marks[ord(m[1]) - ord("A")], text, flags=re.S)


def emit(t: Template, role: str, text: str) -> list[tuple[str, bool]]:
    """Segments (text, loss) of one turn."""
    if role in t.roles:
        begin, end, loss = t.roles[role]
        return [(begin, False), (t.quote(text), loss), (end, False)]
    begin, middle, end = t.other
    return [(begin + t.quote(role) + middle, False), (t.quote(text), False), (end, False)]


def format_turns(turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments in order: conversation id, `seg` (from 0), `text`, `loss`, and `error` (of the last segment, null if all is well)."""
    t = template or Template()
    t.check()
    kind = turns.schema[conv_col].dataType
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("n"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv, state, seg, error = False, None, "", 0, None

        def last() -> tuple:
            wrong = error or (None if state in t.ends else f"ends after {state or 'nothing'}")
            return (conv, seg, "", False, wrong)

        for b in batches:
            out = []
            for c, role, text in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                if not started or c != conv:
                    if started:
                        out.append(last())
                    started, conv, state, seg, error = True, c, "", 0, None
                if error is None and role not in t.follows.get(state, ()):
                    error = f"{role or 'no role'} after {state or 'the start'}"
                state = role
                for s, loss in emit(t, role, text):
                    out.append((conv, seg, s, loss, None))
                    seg += 1
            if out:
                yield _batch(out, b.column(0).type)
            kind_ = b.column(0).type
        if started:
            yield _batch([last()], kind_)

    def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.string())], names=["c", "seg", "text", "loss", "error"])

    schema = T.StructType([T.StructField("c", kind)]).add("seg", "long").add("text", "string").add("loss", "boolean").add("error", "string")
    dealt = rows.repartition("c").sortWithinPartitions("c", "n", "role", "text").select("c", "role", "text")
    return dealt.mapInArrow(run, schema).withColumnRenamed("c", conv_col)


class _Reader:
    """Reads one formatted conversation piece by piece."""

    def __init__(self, t: Template):
        self.t, self.held, self.inside = t, [], None
        self.turns, self.n, self.chars = hashlib.sha256(), 0, 0
        self.loss, self.loss_chars = hashlib.sha256(), 0
        self.opens = {o: r for r, (o, _, _) in t.roles.items()}

    def feed(self, text: str, loss: bool) -> None:
        t = self.t
        self.chars += len(text)
        if loss:
            own = t.plain(text)
            self.loss.update(own.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(own)
        self.held.append(text)
        if not text.endswith(tuple(t.marks)):
            return
        whole = "".join(self.held)
        for begin, role in [*self.opens.items(), (t.other[0], None)]:
            if whole.startswith(begin):
                end = t.roles[role][1] if role is not None else t.other[2]
                if whole.endswith(end):
                    body = whole[len(begin) : len(whole) - len(end)]
                    if role is None:
                        role, _, body = body.partition(t.other[1])
                        role = t.plain(role)
                    self.turns.update(f"{role}\n{t.plain(body)}\n".encode("utf-8", "surrogatepass"))
                    self.n += 1
                    self.held = []
                return
        raise ValueError("formatted text does not begin with a mark")


def read_back(segments: DataFrame, template: Template | None = None, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation, from the formatted segments alone: turns, digests, lengths, and the machine's verdict."""
    t = template or Template()
    kind = segments.schema[conv_col].dataType
    names = ["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv, r, error = False, None, None, None
        types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

        def done() -> tuple:
            return (conv, r.n, r.turns.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.chars, error)

        for b in batches:
            types[0] = b.column(0).type
            out = []
            for c, text, loss, wrong in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if not started or c != conv:
                    if started:
                        out.append(done())
                    started, conv, r, error = True, c, _Reader(t), None
                r.feed(text, loss)
                error = wrong or error
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(done(), types, strict=True)], names=names)

    schema = T.StructType([T.StructField("c", kind)]).add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long").add("error", "string")
    dealt = segments.select(F.col(conv_col).alias("c"), "seg", "text", "loss", "error").repartition("c").sortWithinPartitions("c", "seg")
    return dealt.select("c", "text", "loss", "error").mapInArrow(run, schema).withColumnRenamed("c", conv_col)


def digests(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Format all conversations, write the segments, and read them back."""
    return read_back(materialize(format_turns(turns, template), "chat-segments"), template)
