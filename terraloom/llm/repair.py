"""Repair of conversation structure: the cheapest edits after which roles run `(s?(ua)+)?`, as a dynamic program over turns.

A row may be kept (0), given the role user or assistant (2), or deleted (3; blank and repeated rows must be), and empty user or
assistant turns may be put in anywhere (2). A truncated row that stays adds 1. Of equally cheap edit lists that with the least
initials in ASCII wins.

Four states say how the roles so far end: nothing, system, user, assistant. Each keeps its least cost and its rank among the
states' edit lists in ASCII order. Lists of two states have used the same rows and end in an edit of the last one, so neither begins
with the other: ranks order all that can follow, and no list has to be kept. A row leaves one byte per state: where the best list came
from. Conversations are dealt by id, sorted by turn, and streamed; the state is carried across Arrow batches. One that fits
`most_rows` and `most_bytes` is traced back in memory. A longer one is only named in that pass; then its rows get places from ranges
(no task needs all of them), the bytes are spilled as rows of `chunk` places to the shared folder, read backwards, and the edits found
meet the rows again in order.

Edge cases: null roles and texts are single spaces; null turns come first, and null ids are one conversation; rows that tie are
ordered by role, then text; a role's first character counts, whatever follows, and a row with another or none can't be
kept; a conversation without rows needs no edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import materialize
from terraloom.operators.ranks import running

SPACE = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {REROLE: 2, DELETE: 3, INSERT: 2, "truncated": 1}
#: state -> the state after a turn with that initial; 0 nothing, 1 system, 2 user, 3 assistant
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
#: state -> the turn that may be put in after it
NEXT = {0: "user", 1: "user", 2: "assistant", 3: "user"}
_FAR = 1 << 60
_OPS = (KEEP, REROLE, DELETE)
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _moves(initial: str, must_go: bool) -> list[tuple[int, int, int, int, int, str, bool]]:
    """All (state, insertions, edit, state after, cost, initials, stays) for a row; a cycle of insertions never pays."""
    out = []
    for s in range(4):
        at = s
        for k in range(3 if s < 2 else 2):
            for op in (2,) if must_go else (0, 1, 2):
                t = at if op == 2 else STEP[at].get(initial if op == 0 else NEXT[at][0])
                if t is not None:
                    out.append((s, k, op, t, COST[INSERT] * k + COST.get(_OPS[op], 0), INSERT * k + _OPS[op], op != 2))
            at = STEP[at][NEXT[at][0]]
    return out


MOVES = {(i, gone): _moves(i, gone) for i in ("s", "u", "a", "") for gone in (False, True)}


class Walk:
    """The states before any row; `row` takes one more and tells where each state came from."""

    def __init__(self):
        self.cost = [0, _FAR, _FAR, _FAR]
        self.rank = [0, 0, 0, 0]

    def row(self, initial: str, must_go: bool, truncated: bool) -> bytes:
        best: list = [None] * 4
        cost, rank = self.cost, self.rank
        for s, k, op, t, paid, text, stays in MOVES[initial if initial in ("s", "u", "a") else "", must_go]:
            if cost[s] < _FAR:
                found = (cost[s] + paid + (COST["truncated"] if truncated and stays else 0), rank[s], text, s | k << 2 | op << 4)
                if best[t] is None or found < best[t]:
                    best[t] = found
        order = sorted((b[1:3], t) for t, b in enumerate(best) if b)
        for place, (_, t) in enumerate(order):
            self.rank[t] = place
        self.cost = [b[0] if b else _FAR for b in best]
        return bytes(b[3] if b else 255 for b in best)

    def end(self) -> tuple[int, int, int]:
        """Cost, state of the last row and insertions after it, for the best way to an allowed end."""
        ends = ((0, 0), (3, 0), (2, 1), (1, 2))
        cost, _, k, s = min((self.cost[s] + COST[INSERT] * k, self.rank[s], k, s) for s, k in ends if self.cost[s] < _FAR)
        return cost, s, k


def trace(codes: bytes, state: int) -> tuple[bytes, int]:
    """The code of each row on the way to `state`, in order, and the state before the first row."""
    n = len(codes) // 4
    out = bytearray(n)
    for i in range(n - 1, -1, -1):
        out[i] = code = codes[4 * i + state]
        state = code & 3
    return bytes(out), state


class Faults:
    """What is wrong with the rows of one conversation, in order."""

    def __init__(self):
        self.count = dict.fromkeys(_COUNTS, 0)
        self.last: str | None = None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def row(self, turn: int | None, role: str, text: str, repeated: bool) -> tuple[str, bool, bool]:
        """Initial, whether the row must go, whether it is truncated."""
        if turn is not None:
            if self.turns == 0:
                self.first_turn = turn
            if self.turns == 0 or turn != self.last_turn:
                self.turns += 1
            self.last_turn = turn
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        self.last = initial
        body = text.rstrip(SPACE)
        fault = "blank" if not body else "duplicate" if repeated else "truncated" if body[-1] not in ".!?" else None
        if fault:
            self.count[fault] += 1
        return initial, fault in ("blank", "duplicate"), fault == "truncated"

    def totals(self, cost: int) -> list[int]:
        if self.turns:
            self.count["gaps"] = self.last_turn - self.first_turn + 1 - self.turns
        return [*[self.count[c] for c in _COUNTS[:-1]], cost]


def edits_of(code: int, role: str, text: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the insertions before a row and of the row itself."""
    state, op = code & 3, code >> 4
    for _ in range(code >> 2 & 3):
        yield INSERT, NEXT[state], ""
        state = STEP[state][NEXT[state][0]]
    yield _OPS[op], NEXT[state] if op == 1 else role, text


def _tail(state: int, k: int) -> Iterator[tuple[str, str, str]]:
    yield from list(edits_of(state | k << 2 | 2 << 4, "", ""))[:-1]


_EDITS = "k string, step long, edit string, role string, text string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", long boolean"


class _Out:
    """Edits on their way out, in frames of a bounded size."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, k, step, edit, role, text, counts=(None,) * 6, long=False):
        self.rows.append((k, step, edit, role, text, *counts, long))
        self.size += 100 + len(text or "")

    def full(self) -> bool:
        return self.size > 4 << 20

    def frame(self) -> pd.DataFrame:
        names = [f.split()[0] for f in _EDITS.split(", ")]
        made = pd.DataFrame.from_records(self.rows, columns=names).astype(dict.fromkeys(_COUNTS, "Int64"))
        self.rows, self.size = [], 0
        return made


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for f in frames:
        yield from zip(*[f[c].tolist() for c in f.columns], strict=True)


def _whole(most_rows: int, most_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _Out()
        now, held, seen, size, long = None, [], set(), 0, False
        walk, faults, codes = Walk(), Faults(), bytearray()

        def close():
            if long:
                out.add(now, 0, None, None, None, long=True)
                return
            cost, state, k = walk.end()
            path, _ = trace(bytes(codes), state)
            step = 0
            for code, (role, text) in zip(path, held, strict=True):
                for e in edits_of(code, role, text):
                    out.add(now, step, *e)
                    step += 1
            for e in _tail(state, k):
                out.add(now, step, *e)
                step += 1
            out.add(now, step, None, None, None, faults.totals(cost))

        for key, dropped, has_turn, turn, role, text in _rows(frames):
            if key != now:
                if now is not None:
                    close()
                    if out.full():
                        yield out.frame()
                now, held, seen, size, long = key, [], set(), 0, False
                walk, faults, codes = Walk(), Faults(), bytearray()
            if dropped or long:
                continue
            size += len(role) + len(text)
            if len(held) >= most_rows or size > most_bytes:
                long, held, seen, codes = True, [], set(), bytearray()
                continue
            codes += walk.row(*faults.row(turn if has_turn else None, role, text, (role, text) in seen))
            seen.add((role, text))
            held.append((role, text))
        if now is not None:
            close()
        if out.rows:
            yield out.frame()

    return run


def _spill(chunk: int):
    """Rows of long conversations in order -> the codes of `chunk` rows at a time, then a row with state, end and counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, walk, faults, codes, n = None, None, None, bytearray(), 0

        def piece(part, counts=(None,) * 6, state=None, k=None):
            made = pd.DataFrame.from_records([(now, part, bytes(codes), state, k, *counts)], columns=["k", "part", "codes", "state", "extra", *_COUNTS])
            return made.astype(dict.fromkeys(("state", "extra", *_COUNTS), "Int64"))

        def close():
            cost, state, k = walk.end()
            return piece((n + chunk - 1) // chunk, faults.totals(cost), state, k)

        for key, pos, repeated, has_turn, turn, role, text in _rows(frames):
            if key != now:
                if now is not None:
                    if codes:
                        yield piece((n - 1) // chunk)
                        codes = bytearray()
                    yield close()
                now, walk, faults, codes, n = key, Walk(), Faults(), bytearray(), 0
            codes += walk.row(*faults.row(turn if has_turn else None, role, text, repeated))
            n += 1
            if n % chunk == 0:
                yield piece(n // chunk - 1)
                codes = bytearray()
        if now is not None:
            if codes:
                yield piece((n - 1) // chunk)
                codes = bytearray()
            yield close()

    return run


def _backwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spilled codes, last part first -> the codes on the best way, part by part."""
    state = 0
    for key, part, codes, last in _rows(frames):
        if last == last and last is not None:
            state = int(last)
        path, state = trace(bytes(codes), state)
        yield pd.DataFrame({"k": [key], "part": [part], "path": [path]})


def _apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A part's codes, then its rows, part by part; at last the end of the conversation."""
    out = _Out()
    now, path, at, step = None, b"", 0, 0
    for key, kind, codes, role, text, state, extra, *counts in _rows(frames):
        if key != now:
            now, step = key, 0
        if kind == 0:
            path, at = bytes(codes), 0
        elif kind == 1:
            for e in edits_of(path[at], role, text):
                out.add(now, step, *e)
                step += 1
            at += 1
        else:
            for e in _tail(int(state), int(extra)):
                out.add(now, step, *e)
                step += 1
            out.add(now, step, None, None, None, [int(c) for c in counts])
        if out.full():
            yield out.frame()
    if out.rows:
        yield out.frame()


def _long(rows: DataFrame, chunk: int) -> DataFrame:
    """Edits of conversations that no task holds."""
    placed = running(rows, ["k"], ["turn_or_null", "role", "text"], place="pos")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    placed = materialize(placed.withColumn("digest", digest), "repair-long")
    first = placed.groupBy("k", "digest").agg(F.min("pos").alias("first"))
    marked = placed.join(first, ["k", "digest"]).withColumn("repeated", F.col("pos") > F.col("first"))
    ordered = marked.repartition("k").sortWithinPartitions("k", "pos").select("k", "pos", "repeated", "has_turn", "turn", "role", "text")
    spilled = materialize(ordered.mapInPandas(_spill(chunk), "k string, part long, codes binary, state long, extra long, " + ", ".join(f"{c} long" for c in _COUNTS)), "repair-codes")
    back = spilled.repartition("k").sortWithinPartitions("k", F.desc("part")).select("k", "part", "codes", F.col("state").cast("double").alias("state"))
    paths = back.mapInPandas(_backwards, "k string, part long, path binary")

    none = [F.lit(None).cast("long").alias(c) for c in ("state", "extra", *_COUNTS)]
    text = F.lit(None).cast("string")
    parts = paths.select("k", "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), F.col("path").alias("codes"), text.alias("role"), text.alias("text"), *none)
    data = placed.select("k", F.floor((F.col("pos") - 1) / chunk).alias("part"), F.lit(1).alias("kind"), "pos", F.lit(None).cast("binary").alias("codes"), "role", "text", *none)
    ends = spilled.where("state is not null").select("k", "part", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("pos"), "codes", text.alias("role"), text.alias("text"), "state", "extra", *_COUNTS)
    stream = parts.unionByName(data).unionByName(ends).repartition("k").sortWithinPartitions("k", "part", "kind", "pos").select("k", "kind", "codes", "role", "text", "state", "extra", *_COUNTS)
    return stream.mapInPandas(_apply, _EDITS)


def repair(rows: DataFrame, dropped: Column | None = None, most_rows: int = 20_000, most_bytes: int = 16 << 20, chunk: int = 1 << 16) -> DataFrame:
    """Edits in order: conv_id, `step`, `edit` (K, R, D, I), `role` and `text` after it; a last row a conversation, without edit, has

    gaps, blank, duplicate, truncated, illegal and cost. rows: conv_id, turn, role, text. `dropped` rows count for nothing but that
    their conversation is there.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    space = F.lit(" ")
    taken = rows.select(
        key.alias("k"), F.coalesce(dropped if dropped is not None else F.lit(False), F.lit(False)).alias("dropped"), F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.col("turn").alias("turn_or_null"),
    )
    ordered = taken.repartition("k").sortWithinPartitions("k", "has_turn", "turn", "role", "text").drop("turn_or_null")
    found = materialize(ordered.mapInPandas(_whole(most_rows, most_bytes), _EDITS), "repair-edits")
    long = materialize(found.where("long").select("k"), "repair-names")
    edits = found.where("not long")
    if long.take(1):
        edits = edits.unionByName(_long(taken.where("not dropped").drop("dropped").join(long, "k", "left_semi"), chunk))
    kind = rows.schema["conv_id"].dataType
    return edits.select(F.when(F.col("k") != "", F.expr("substring(k, 2)")).cast(kind).alias("conv_id"), "step", "edit", "role", "text", *_COUNTS)


def report(edits: DataFrame) -> DataFrame:
    """One row per conversation: its counts, `audit` (initials of the edits), and the SHA-256 of the repaired turns."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    kind = edits.schema["conv_id"].dataType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, audit, digest, first = None, [], hashlib.sha256(), True
        for f in frames:
            out = []
            for k, edit, role, text, *counts in _rows([f]):
                if k != now:
                    now, audit, digest, first = k, [], hashlib.sha256(), True
                if edit is None:
                    out.append((k, *[int(c) for c in counts], "".join(audit), digest.hexdigest()))
                    continue
                audit.append(edit)
                if edit != DELETE:
                    digest.update(((b"" if first else b"\n") + f"{role}:{text}".encode("utf-8", "surrogatepass")))
                    first = False
            if out:
                yield pd.DataFrame.from_records(out, columns=["k", *_COUNTS, "audit", "repaired_sha256"])

    dealt = edits.select(key.alias("k"), "step", "edit", "role", "text", *_COUNTS).repartition("k").sortWithinPartitions("k", "step").drop("step")
    made = dealt.mapInPandas(run, "k string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string")
    return made.select(F.when(F.col("k") != "", F.expr("substring(k, 2)")).cast(kind).alias("conv_id"), *_COUNTS, "audit", "repaired_sha256")


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults put in by crc32("conv_id:turn") mod 20, and which rows are dropped.

    0 drops a row, 1 empties its text, 2 takes its sentence ends out, 3 repeats it, 4 gives it the role user. Nulls are single spaces.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    made = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("fault"))
    fault = F.col("fault")
    made = made.select(
        "conv_id", "turn", "fault", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return made.drop("copy"), fault == 0
