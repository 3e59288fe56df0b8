"""Repair of conversation structure by secondary-sorted streaming.

Rows are dealt by conversation once and sorted by turn in the tasks, so that every pass is a stream of sorted rows:

1. a window over equal (role, text) of a conversation tells duplicates;
2. :func:`backpointers` reads each conversation from its last row to its first and carries the dynamic programme's four
   costs across Arrow batches. What a row adds to the plan is one byte, the best edit in each of four states; the bytes
   stay with their rows, which Spark's sort spills, so a conversation of any length takes constant memory in the task;
3. the same rows sorted forward meet their bytes again: :func:`repaired_rows` and :func:`repair_report` follow the
   choices from the first row on.

States are the roles so far: none, system, user last, assistant last; roles must end in none or assistant. In each
state only one role can follow (a system row may also begin), so every edit has one outcome, a plan is told by its edits'
initials, and taking the least letter among the best edits of every step gives the ASCII-least plan.

Defined results: null fields count as one space (a null conv_id is a conversation, a null turn comes first and does not
count for gaps); rows of equal turn come by role, then text; a role is told by its first letter; an empty table gives an empty table; other
columns are dropped. A conversation is one stream in one task, however long: rows of a giant one spill in Spark's sort, and
of the results only ``audit``, a letter an edit, grows with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Edits in the order of their initials, as two bits.
LETTERS = "DIKR"
#: The role that follows in each state, and the state after it; a kept system row leads from none to system.
NEXT_ROLE, NEXT_STATE = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
FAULTS = {"blank": 1, "duplicate": 2, "truncated": 3}
INITIALS = {"s": 1, "u": 2, "a": 3}
FAR = 1 << 60

#: Numbers go to Python without nulls, which would turn them into floating ones.
MARKED = "conv_id long, no_id boolean, turn long, no_turn boolean, role string, text string, n int, there boolean, fault int"
PLANNED = f"{MARKED}, plan int"
REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def marked_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, there) with ``n``, the number among equal ones, and ``fault``, the first of blank (1),
    duplicate (2) and truncated (3) that holds, else 0. Rows that are not ``there`` only name their conversation."""
    equal = Window.partitionBy("conv_id", "there", "role", "text").orderBy("turn")
    dealt = rows.repartition("conv_id").withColumn("n", F.row_number().over(equal))
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(~F.col("there"), 0).when(last == "", 1).when(F.col("n") > 1, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    number = lambda c, no: (F.coalesce(c, F.lit(0)).alias(c), F.col(c).isNull().alias(no))
    return dealt.select(*number("conv_id", "no_id"), *number("turn", "no_turn"), "role", "text", "n", "there", fault.alias("fault"))


def costs_before(after: tuple[int, int, int, int], initial: int, fault: int) -> tuple[tuple[int, int, int, int], int]:
    """From the least costs of what follows a row, by state: the least costs with the row, and the best edits of the four
    states, two bits each."""
    if fault in (1, 2):
        base = [DELETE + c for c in after]
        edits = [0, 0, 0, 0]
    else:
        more = TRUNCATED if fault == 3 else 0
        base, edits = [], []
        for state in range(4):
            follow, role = after[NEXT_STATE[state]], NEXT_STATE[state]
            kept = follow if initial == role else after[1] if initial == 1 and state == 0 else FAR
            options = ((DELETE + after[state], 0), (KEEP + more + kept, 2), (REROLE + more + follow, 3))
            cost, edit = min(options)
            base.append(cost)
            edits.append(edit)
    b2, b3 = base[2], base[3]
    costs = [0, 0, min(b2, INSERT + b3), min(b3, INSERT + b2)]
    costs[0], costs[1] = min(base[0], INSERT + costs[2]), min(base[1], INSERT + costs[2])
    plan = 0
    for state in range(4):
        inserted = INSERT + costs[NEXT_STATE[state]]
        edit = edits[state] if base[state] == costs[state] and not (inserted == costs[state] and edits[state] > 1) else 1
        plan |= edit << 2 * state
    return tuple(costs), plan


#: Least costs by state when no row is left: roles may end after none or an assistant.
AT_END = (0, 2 * INSERT, INSERT, 0)


def backpointers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of conversations from last to first, with ``plan``: the best edits before and at each row."""
    conv, costs = object(), AT_END
    for frame in frames:
        plans = np.zeros(len(frame), dtype=np.int32)
        convs, initials = _numbers(frame, "conv_id", "no_id"), [INITIALS.get(r[:1], 0) for r in frame["role"]]
        for i, (c, initial, fault, there) in enumerate(zip(convs, initials, frame["fault"].tolist(), frame["there"].tolist(), strict=True)):
            if c != conv:
                conv, costs = c, AT_END
            if there:
                costs, plans[i] = costs_before(costs, initial, fault)
        frame["plan"] = plans
        yield frame


def _numbers(frame: pd.DataFrame, column: str, missing: str) -> list[int | None]:
    return [None if no else v for v, no in zip(frame[column].tolist(), frame[missing].tolist(), strict=True)]


def _table(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as a frame whose whole numbers may be null and stay exact."""
    kinds = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pd.DataFrame({name: pd.array(list(c), dtype="Int64") if kind == "long" else pd.Series(list(c), dtype=object) for (name, kind), c in zip(kinds, columns, strict=True)})


def _followed(frame: pd.DataFrame, conv: object, state: int) -> Iterator[tuple]:
    """Edits of rows in order, from a state on: for each row (conv, whether the conversation is a new one, index, edits), an
    edit being (letter, role, whether it is the row's own). The rest of a conversation's edits comes from :func:`_closing`."""
    for i, (c, there, role, plan) in enumerate(zip(_numbers(frame, "conv_id", "no_id"), frame["there"].tolist(), frame["role"].tolist(), frame["plan"].tolist(), strict=True)):
        new, conv = c != conv, c
        state = 0 if new else state
        edits = []
        while there:
            letter = LETTERS[plan >> 2 * state & 3]
            if letter == "D":
                edits.append(("D", None, True))
                break
            system = letter == "K" and role[:1] == "s"
            edits.append((letter, role if letter == "K" else NEXT_ROLE[state], letter != "I"))
            state = 1 if system else NEXT_STATE[state]
            if letter != "I":
                break
        yield c, new, i, state, edits


def _closing(state: int) -> list[str]:
    """Roles that are inserted after the last row."""
    return {0: [], 1: ["user", "assistant"], 2: ["assistant"], 3: []}[state]


def repaired_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The repaired rows and the deleted ones, from planned rows in order."""
    conv, state, place = None, 0, 0

    def row(edit: str, turn: int | None, role: str | None, text: str | None) -> tuple:
        nonlocal place
        place += edit != "D"
        return conv, None if edit == "D" else place - 1, edit, turn, role, text

    def table(rows: list[tuple]) -> pd.DataFrame:
        return _table(rows, REPAIRED)

    first = True
    for frame in frames:
        rows, turns, texts, roles = [], _numbers(frame, "turn", "no_turn"), frame["text"].tolist(), frame["role"].tolist()
        for c, new, i, after, edits in _followed(frame, object() if first else conv, state):
            if new:
                rows += [row("I", None, r, "") for r in (_closing(state) if not first else [])]
                conv, place = c, 0
            first, state = False, after
            rows += [row(e, turns[i] if own else None, roles[i] if e == "D" else r, texts[i] if own else "") for e, r, own in edits]
        yield table(rows)
    if not first:
        yield table([row("I", None, r, "") for r in _closing(state)])


class _Report:
    """Counts, cost, edits and digest of one conversation, as its rows pass."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.state, self.cost = conv, 0, 0
        self.counts = [0, 0, 0, 0]
        self.turns, self.least, self.last = 0, None, None
        self.illegal, self.initial = 0, None
        self.audit: list[str] = []
        self.digest, self.empty = hashlib.sha256(), True

    def put(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "replace"))
        self.empty = False

    def row(self, turn: int | None, role: str, text: str, fault: int, edits: list[tuple]) -> None:
        self.counts[fault] += 1
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        for edit, given, own in edits:
            self.audit.append(edit)
            self.cost += {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}[edit] + (TRUNCATED if own and edit != "D" and fault == 3 else 0)
            if edit != "D":
                self.put(given, text if own else "")

    def ended(self) -> tuple:
        for role in _closing(self.state):
            self.audit.append("I")
            self.cost += INSERT
            self.put(role, "")
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.counts[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def report_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each conversation, from planned rows in order."""
    now: _Report | None = None
    for frame in frames:
        out, turns = [], _numbers(frame, "turn", "no_turn")
        roles, texts, faults, there = (frame[c].tolist() for c in ("role", "text", "fault", "there"))
        for c, new, i, after, edits in _followed(frame, object() if now is None else now.conv, 0 if now is None else now.state):
            if new:
                out += [now.ended()] if now is not None else []
                now = _Report(c)
            now.state = after
            if there[i]:
                now.row(turns[i], roles[i], texts[i], faults[i], edits)
        yield _table(out, REPORT)
    if now is not None:
        yield _table([now.ended()], REPORT)


def planned_rows(rows: DataFrame) -> DataFrame:
    """Marked rows with their plans, each conversation in one partition, its rows in order."""
    order = ("turn", "role", "text", "n")
    backward = marked_rows(rows).sortWithinPartitions("no_id", "conv_id", "no_turn", *[F.desc(c) for c in order])
    return backward.mapInPandas(backpointers, PLANNED).sortWithinPartitions("no_id", "conv_id", F.desc("no_turn"), *order)


def plain_rows(conversations: DataFrame) -> DataFrame:
    """The four columns of conversations, without null roles and texts."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *filled, F.lit(True).alias("there"))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit, turn, role and text of the repaired conversations; deleted rows have no place.

    ``rows`` are those of :func:`plain_rows`."""
    return planned_rows(rows).mapInPandas(repaired_frames, REPAIRED)


def repair_report(rows: DataFrame) -> DataFrame:
    """A row for each conversation: faults, cost, the edits' initials and the digest of the repaired rows."""
    return planned_rows(rows).mapInPandas(report_frames, REPORT)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults that a checksum of conversation and turn draws: of twenty, one is dropped (it stays as not
    ``there``), one emptied, one loses its stops, one comes twice and one is given to the user."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(F.col("d").isin(0, 1), "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 0, "").when(F.col("d") == 4, "user").otherwise(F.col("role"))
    twice: Column = F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("d", drawn).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("d") != 0).alias("there"), F.explode(twice).alias("_c")).drop("_c")


def conversation_digest(conversations: DataFrame) -> DataFrame:
    """The query's columns: the report of the damaged conversations."""
    return repair_report(damaged(plain_rows(conversations)))
