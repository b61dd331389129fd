"""Repairing the structure of conversations: the cheapest edits after which turns alternate.

A conversation is well formed if its roles' initials read ``(s?(ua)+)?``.  Rows are dealt out
by conversation and sorted by turn, and a task goes through them once: for each of the four
states in which a prefix may end it has the cost of the cheapest edits, their order among
each other, and the hash of the text repaired so far.  How a state was reached is three
bytes a row, which go to a scratch file when there are many; the edits are read back from
them at the conversation's end.  So a task's memory does not grow with the conversation.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import partitions
from palimpsest.session import Workspace

#: What edits cost: to keep a row, to change its role, to delete it, to insert one; an undeleted truncated row adds 3.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Bytes of a conversation's back pointers held in memory (a third of so many rows); beyond that they go to a file.
HELD = 1 << 20

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a.  Conversations end in 0 or 3.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
# What a state asks for when a row is inserted or gets a new role.
_WANTED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
_ROLES = {s: role for s, (role, _) in _WANTED.items()}
# From a state by 0, 1 or 2 insertions: more come back to a state at a higher cost.
_INSERTED: dict[int, list[tuple[int, list[str]]]] = {}
for _s in range(4):
    _steps, _at = [(_s, [])], _s
    for _ in range(2):
        _role, _to = _WANTED[_at]
        if all(_to != seen for seen, _ in _steps):
            _steps.append((_to, [*_steps[-1][1], _role]))
        _at = _to
    _INSERTED[_s] = _steps
_OPS = "DKR"


def _moves(initial: str, must_go: bool, truncated: bool) -> list[tuple[str, int, int, int, int]]:
    """(edits, from, insertions, to, cost) of a row: some insertions, then one edit of it."""
    found = []
    more = 0 if not truncated else TRUNCATED
    for s in range(4):
        for k, (at, _) in enumerate(_INSERTED[s]):
            head, cost = "I" * k, INSERT * k
            found.append((head + "D", s, k, at, cost + DELETE))
            if must_go:
                continue
            if (at, initial) in _NEXT:
                found.append((head + "K", s, k, _NEXT[at, initial], cost + KEEP + more))
            found.append((head + "R", s, k, _WANTED[at][1], cost + REROLE + more))
    return found


class _Repair:
    """One conversation on its way through a task."""

    def __init__(self, conv: str | None):
        self.conv = conv
        self.states = {0: (0, 0, hashlib.sha256(), False)}  # cost, place in the order of edits, hash, whether it has a row
        self.pointers, self.file, self.rows = bytearray(), None, 0
        self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None

    def add(self, turn: int | None, role: str, text: str, fault: str, moves: dict) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        key = (initial if initial in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated")
        if key not in moves:
            moves[key] = _moves(*key)
        best: dict[int, tuple] = {}
        for edits, s, k, to, cost in moves[key]:
            if s in self.states:
                total, order, _, _ = self.states[s]
                # Edits that end with a row each: none begins another, so the order is settled at the first difference.
                candidate = (total + cost, order, edits, s, k)
                if to not in best or candidate < best[to]:
                    best[to] = candidate
        ranks = {c[1:3]: i for i, c in enumerate(sorted(best.values(), key=lambda c: c[1:3]))}
        after, pointer = {}, 0
        for to, (total, order, edits, s, k) in best.items():
            done, begun = self.states[s][2].copy(), self.states[s][3]
            own = [f"{r}:" for r in _INSERTED[s][k][1]]
            if edits[-1] != "D":
                own.append(f"{role if edits[-1] == 'K' else _ROLES[_INSERTED[s][k][0]]}:{text}")
            if own:
                done.update((("\n" if begun else "") + "\n".join(own)).encode())
            after[to] = (total, ranks[order, edits], done, begun or bool(own))
            pointer |= (s | k << 2 | _OPS.index(edits[-1]) << 4) << 6 * to
        self.states = after
        self.pointers += pointer.to_bytes(3, "little")
        self.rows += 1
        if len(self.pointers) >= HELD:
            # Private to this attempt of the task: another attempt reads its rows again.
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.pointers)
            self.pointers = bytearray()

    def _backwards(self) -> Iterator[int]:
        blocks = 0 if self.file is None else self.file.tell()
        held = self.pointers
        while True:
            for at in range(len(held) - 3, -1, -3):
                yield int.from_bytes(held[at : at + 3], "little")
            if not blocks:
                return
            size = min(blocks, HELD // 3 * 3)
            blocks -= size
            self.file.seek(blocks)
            held = self.file.read(size)

    def result(self) -> tuple:
        ends = []
        for s, (total, order, _, _) in self.states.items():
            ends += [(total + INSERT * k, order, "I" * k, s, k) for k, (at, _) in enumerate(_INSERTED[s]) if at in (0, 3)]
        cost, _, tail, state, k = min(ends)
        done, begun = self.states[state][2:]
        added = [f"{r}:" for r in _INSERTED[state][k][1]]
        if added:
            done.update((("\n" if begun else "") + "\n".join(added)).encode())
        edits = bytearray(tail.encode())
        for pointer in self._backwards():
            move = pointer >> 6 * state & 63
            edits += _OPS[move >> 4].encode() + b"I" * (move >> 2 & 3)
            state = move & 3
        if self.file is not None:
            self.file.close()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        counts = (min(gaps, (1 << 63) - 1), self.blank, self.duplicate, self.truncated, self.illegal, cost)
        return (self.conv, *counts, edits[::-1].decode(), done.hexdigest())


_RESULT = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _repairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of whole conversations to one row a conversation; what is open goes on in the next batch."""
    moves: dict = {}
    current: _Repair | None = None
    before = None
    for batch in batches:
        finished = []
        columns = (batch[c] for c in ("conv", "has_turn", "turn", "role", "text", "fault"))
        for conv, has_turn, turn, role, text, fault in zip(*columns):
            if current is None or conv != current.conv:
                if current is not None:
                    finished.append(current.result())
                current, before = _Repair(conv), None
            if role is not None:
                # Rows equal in all stand beside each other.
                own = (has_turn, turn, role, text)
                current.add(int(turn) if has_turn else None, role, text, "duplicate" if own == before and fault != "blank" else fault, moves)
                before = own
        if finished:
            yield pd.DataFrame(finished, columns=_RESULT)
    if current is not None:
        yield pd.DataFrame([current.result()], columns=_RESULT)


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of whole conversations, each after its row with the edits, to the rows that the edits leave."""
    conv, edits, at, state, place = None, "", 0, 0, 0
    for batch in batches:
        out: list[tuple] = []

        def insert() -> None:
            nonlocal at, state, place
            while at < len(edits) and edits[at] == "I":
                role, state = _WANTED[state]
                out.append((conv, place, "I", role, ""))
                at, place = at + 1, place + 1

        for own, audit, role, text in zip(batch["conv"], batch["audit"], batch["role"], batch["text"]):
            if audit is not None:
                conv, edits, at, state, place = own, audit, 0, 0, 0
            else:
                edit, at = edits[at], at + 1
                if edit == "K":
                    state = _NEXT[state, role[:1]]
                elif edit == "R":
                    role, state = _WANTED[state]
                if edit != "D":
                    out.append((conv, place, edit, role, text))
                    place += 1
            insert()
        yield pd.DataFrame(out, columns=["conv", "place", "edit", "role", "text"])


def _sorted(rows: DataFrame, *keys: str | Column) -> DataFrame:
    return rows.repartition(partitions(rows), "conv").sortWithinPartitions("conv", *keys)


_ORDER = ("has_turn", "turn", "role", "text")


def _with_faults(
    turns: DataFrame, conv_column: str, turn_column: str, role_column: str, text_column: str, gone: Column, copies: Column,
    space: Workspace,
) -> DataFrame:
    """Rows with their first fault; a conversation of which all rows are gone keeps one without a role."""
    rows = turns.select(
        F.col(conv_column).cast("string").alias("conv"),
        F.col(turn_column).isNotNull().alias("has_turn"),
        F.coalesce(F.col(turn_column).cast("bigint"), F.lit(0).cast("bigint")).alias("turn"),
        F.when(~gone, F.coalesce(F.col(role_column), F.lit(" "))).alias("role"),
        F.when(~gone, F.coalesce(F.col(text_column), F.lit(" "))).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = space.written(rows.withColumn("last", last).withColumn("said", F.sha2(F.concat_ws(":", "role", "text"), 256)))
    # Turns combine before the exchange; only what a conversation says in two turns is joined, and a
    # message that fills one can be split, since its other side is one row of a written table.
    at = F.struct("has_turn", "turn")
    first = space.written(
        rows.filter("last != ''").groupBy("conv", "said").agg(F.min(at).alias("first"), F.max(at).alias("final"))
        .filter("first != final").select(F.col("conv").alias("of"), F.col("said").alias("once"), "first")
    )
    both = rows.join(first, F.col("conv").eqNullSafe(F.col("of")) & (F.col("said") == F.col("once")), "left")
    fault = (
        F.when(F.col("last") == "", "blank")
        .when(F.col("first").isNotNull() & (at != F.col("first")), "duplicate")
        .when(~F.col("last").isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    return both.select("conv", *_ORDER, fault.alias("fault"))


def repair_conversations(
    turns: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    gone: Column | None = None,
    copies: Column | None = None,
    space: Workspace | None = None,
) -> DataFrame:
    """The cheapest edits of every conversation, what they cost, and the hash of what they leave.

    Rows are taken by turn, nulls first.  A row's first fault counts: blank (no character but
    white space), duplicate (role and text seen earlier in the conversation), truncated (the last
    such character is not one of ``.!?``).  Edits: K keeps a row, R gives it the role user or
    assistant, D deletes it, which blank and duplicate rows need, I inserts an empty row of
    either role.  Of edits that cost the same the first in ASCII order is taken.

    ``gone`` marks rows to be left out (their conversation stays), ``copies`` says how often a
    row stands there.  Null roles and texts are one space; rows with one turn are taken by role
    and text; rows equal in all are duplicates of each other; a null conversation is one
    of its own; a conversation without rows has zeros, no edits and the hash of nothing; an
    empty table gives an empty one.  Other columns are not looked at.

    A task goes through a conversation as a stream.  It holds four hashes and, of the edits,
    a character for each row, which is its result; back pointers of more than ``HELD`` bytes
    go to a file of the task's own.  Returns conv_id, gaps, blank, duplicate, truncated, illegal
    (neighbouring roles other than su, ua, au), cost, audit (the edits) and repaired_sha256 (of
    the lines ``role:text``).
    """
    space = space or Workspace(turns.sparkSession)
    gone, copies = F.lit(False) if gone is None else gone, F.lit(1) if copies is None else copies
    kind = turns.select(F.col(conv_column).alias("conv_id")).schema["conv_id"].dataType
    rows = _with_faults(turns, conv_column, turn_column, role_column, text_column, gone, copies, space)
    counts = ", ".join(f"{c} bigint" for c in _RESULT[1:-2])
    found = _sorted(rows, *_ORDER).mapInPandas(_repairs, f"conv string, {counts}, audit string, repaired_sha256 string")
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *_RESULT[1:])


def repaired_turns(
    turns: DataFrame, repairs: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """The rows that :func:`repair_conversations` leaves: conv_id, place (from 0), edit, role and text.

    The edits come before the conversation's rows in the same sorted stream, so nothing but they is held.
    """
    kind = turns.select(F.col(conv_column).alias("conv_id")).schema["conv_id"].dataType
    rows = turns.select(
        F.col(conv_column).cast("string").alias("conv"),
        F.lit(None).cast("string").alias("audit"),
        F.col(turn_column).isNotNull().alias("has_turn"),
        F.coalesce(F.col(turn_column).cast("bigint"), F.lit(0).cast("bigint")).alias("turn"),
        F.coalesce(F.col(role_column), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_column), F.lit(" ")).alias("text"),
    )
    edits = repairs.select(
        F.col("conv_id").cast("string").alias("conv"), "audit", F.lit(False).alias("has_turn"), F.lit(0).cast("bigint").alias("turn"),
        F.lit("").alias("role"), F.lit("").alias("text"),
    )
    both = _sorted(rows.unionByName(edits), F.desc_nulls_last("audit"), "has_turn", "turn", "role", "text")
    left = both.select("conv", "audit", "role", "text").mapInPandas(_edited, "conv string, place bigint, edit string, role string, text string")
    return left.select(F.col("conv").cast(kind).alias("conv_id"), "place", "edit", "role", "text")


def damage(turns: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Rows of conversations with faults put in by the checksum of ``conv_id:turn``; which of them are gone, and how often they stand there."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text, role = space("text"), space("role")
    rows = turns.select(
        "conv_id", "turn", kind.alias("damage"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
    )
    return rows, F.col("damage") == 0, F.when(F.col("damage") == 3, 2).otherwise(1)
