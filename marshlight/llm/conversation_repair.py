"""Repair of conversations to the turn order system?, (user, assistant)+ at the least cost.

Edits are Keep, Rerole to user or assistant, Delete and Insert of an empty turn. The cheapest sequence of edits, and
among equally cheap ones the one whose initials are ASCII-least, is found for each conversation by depth-first
branch and bound: an explicit stack of nodes (turns done, place in the order, cost), a lower bound for the
suffix of turns from each place in the order, the incumbent (cost, audit) that cuts whatever cannot beat it, and
for each node a dominance table of the best prefix that reached it, which cuts worse ones. The search ends when the
stack is empty: then the incumbent is proved best.

Planning sees 16 bytes a turn, not the texts; these are shuffled once, to be written with the edits applied. Both
steps stream through a conversation's turns in order, so that a task holds no conversation's texts.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Places in the order: before all, behind the system turn, behind a user turn, behind an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn of this initial leads; others, and these from other places, break the order.
LEGAL = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Where a rerolled or inserted turn leads; a user turn, but behind one an assistant turn.
NEXT = (USER, USER, ASSISTANT, USER)
#: What each turn may undergo.
SOUND, CUT_SHORT, VOID = range(3)
_FAR = 1 << 60


def suffix_bounds(turns: list[tuple[str, int]]) -> list[tuple[int, int, int, int]]:
    """For 0 to n turns done, the least cost of the rest from each place; ``turns`` are (initial, state)."""
    bounds = [(0, 2 * INSERT, INSERT, 0)]
    for initial, state in reversed(turns):
        ahead = bounds[-1]
        least = [ahead[p] + DELETE for p in range(4)]
        if state != VOID:
            extra = TRUNCATED if state == CUT_SHORT else 0
            for p in range(4):
                least[p] = min(least[p], ahead[NEXT[p]] + REROLE + extra)
            for p, q in LEGAL.get(initial, {}).items():
                least[p] = min(least[p], ahead[q] + KEEP + extra)
        user, assistant = min(least[USER], least[ASSISTANT] + INSERT), min(least[ASSISTANT], least[USER] + INSERT)
        bounds.append((min(least[START], user + INSERT), min(least[SYSTEM], user + INSERT), user, assistant))
    return bounds[::-1]


def cheapest_edits(turns: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit): the initials of the cheapest edits in order, ASCII-least among equals."""
    bounds, n = suffix_bounds(turns), len(turns)
    best, incumbent = _FAR, ""
    reached: dict[tuple[int, int], int] = {}  # cost of the best prefix; earlier ones are ASCII-less
    audit: list[str] = []
    stack = [(0, START, 0, 0, "")]  # turns done, place, cost, length of the audit before, its next letter
    while stack:
        done, place, cost, before, letter = stack.pop()
        if cost + bounds[done][place] > best or (cost + bounds[done][place] == best and letter > incumbent[before : before + 1]):
            continue
        if reached.get((done, place), _FAR) <= cost:
            continue
        reached[done, place] = cost
        audit[before:] = letter
        if done == n and place in (START, ASSISTANT):
            best, incumbent = cost, "".join(audit)
            continue
        at = len(audit)
        moves = [(done, NEXT[place], cost + INSERT, at, "I")]
        if done < n:
            initial, state = turns[done]
            moves.append((done + 1, place, cost + DELETE, at, "D"))
            if state != VOID:
                extra = TRUNCATED if state == CUT_SHORT else 0
                moves.append((done + 1, NEXT[place], cost + REROLE + extra, at, "R"))
                if place in LEGAL.get(initial, ()):
                    moves.append((done + 1, LEGAL[initial][place], cost + KEEP + extra, at, "K"))
        moves.sort(key=lambda m: (m[2] + bounds[m[0]][m[1]], m[4]), reverse=True)
        stack += moves
    return best, incumbent


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))


def _turns(df: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    turns = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return turns.withColumn("digest", _digest(F.col("role"), F.col("text")))


_PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plan_repairs(conversations: DataFrame) -> DataFrame:
    """Per conversation its faults and cheapest edits: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``conversations`` has conv_id, turn, role and text; other columns are ignored. A null role or text is one space; a null
    turn comes first and is no gap; turns of one number come by the digest of role and text; rows without
    conv_id are one conversation. A blank turn, else one whose role and text occurred before, has to be
    deleted; else one whose last character, white space apart, is none of ``.!?`` is truncated. An empty table gives no rows.
    """
    last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), -1, 1)
    seen = _turns(conversations).select(
        "conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"),
        (last == "").alias("blank"), last.isin(".", "!", "?").alias("closed"),
    )
    return seen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest").mapInArrow(_planner, _PLAN)


class _Faults:
    """One conversation's turns as they stream by."""

    def __init__(self, conv):
        self.conv, self.turns, self.seen = conv, [], set()
        self.low = self.high = None
        self.numbers = self.illegal = 0
        self.counts = [0, 0, 0]  # blank, duplicate, truncated

    def add(self, turn: int | None, digest: bytes, initial: str, blank: bool, closed: bool) -> None:
        if turn is not None and turn != self.high:  # turns are in order
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.numbers += 1
        if self.turns and self.turns[-1][0] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        fault = 0 if blank else 1 if digest in self.seen else 2 if not closed else None
        if fault is not None:
            self.counts[fault] += 1
        self.seen.add(digest)
        self.turns.append((sys.intern(initial), SOUND if fault is None else CUT_SHORT if fault == 2 else VOID))

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.numbers if self.numbers else 0
        return (self.conv, gaps, *self.counts, self.illegal, *cheapest_edits(self.turns))


def _batch(rows: list[tuple], names: list[str], text: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.string() if c in text else pa.int64()) for c, v in zip(names, zip(*rows))], names=names)


_PLAN_NAMES = [c.split()[0] for c in _PLAN.split(", ")]


def _planner(batches) -> Iterator[pa.RecordBatch]:
    held, out = None, []
    for batch in batches:
        for conv, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "digest", "initial", "blank", "closed"))):
            if held is None or conv != held.conv:
                if held is not None:
                    out.append(held.row())
                held = _Faults(conv)
            held.add(*turn)
        if len(out) >= 2000:
            yield _batch(out, _PLAN_NAMES, ("audit",))
            out = []
    if held is not None:
        yield _batch([*out, held.row()], _PLAN_NAMES, ("audit",))


def repaired_turns(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns that ``plans`` of the same conversations leave, change and insert, numbered from 0.

    Rows of one conversation lie together and in order.
    """
    nothing = F.lit(None)
    audits = plans.select("conv_id", F.lit(0).alias("kind"), nothing.cast("long").alias("turn"), nothing.cast("binary").alias("digest"), nothing.cast("string").alias("role"), F.col("audit").alias("text"))
    turns = _turns(conversations).select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text")
    met = audits.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest")
    return met.select("conv_id", "kind", "role", "text").mapInArrow(_editor, "conv_id long, place long, role string, text string")


_ROLES = {USER: "user", ASSISTANT: "assistant"}


class _Edits:
    """One conversation's audit as it is applied."""

    def __init__(self, conv, audit: str):
        self.conv, self.audit, self.at, self.place, self.made = conv, audit, 0, START, 0

    def _made(self, role: str, text: str, place: int) -> tuple:
        self.place, self.made = place, self.made + 1
        return self.conv, self.made - 1, role, text

    def inserts(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            place = NEXT[self.place]
            yield self._made(_ROLES[place], "", place)

    def apply(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            yield self._made(role, text, LEGAL[role[0]][self.place])
        elif letter == "R":
            place = NEXT[self.place]
            yield self._made(_ROLES[place], text, place)


def _editor(batches) -> Iterator[pa.RecordBatch]:
    names, text = ["conv_id", "place", "role", "text"], ("role", "text")
    edits = None
    for batch in batches:
        out: list[tuple] = []
        for conv, kind, role, body in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
            if kind == 0:
                if edits is not None:
                    out += edits.inserts()
                edits = _Edits(conv, body)
            else:
                out += edits.apply(role, body)
        if out:
            yield _batch(out, names, text)
    if edits is not None and (out := list(edits.inserts())):
        yield _batch(out, names, text)


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the ``role:text`` of all turns, newline-joined, for rows as ``repaired_turns`` returns them."""
    return repaired.mapInArrow(_joiner, "conv_id long, sha256 string")


def _joiner(batches) -> Iterator[pa.RecordBatch]:
    digest, conv, names = None, None, ["conv_id", "sha256"]
    for batch in batches:
        out = []
        for now, role, body in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            line = f"{role}:{body}".encode()
            if digest is not None and now == conv:
                digest.update(b"\n" + line)
            else:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                digest, conv = hashlib.sha256(line), now
        if out:
            yield _batch(out, names, ("sha256",))
    if digest is not None:
        yield _batch([(conv, digest.hexdigest())], names, ("sha256",))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20: dropped (0), emptied (1), without ``.!?`` (2), repeated (3), as user (4). Nulls are one space."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    rows = conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(as_text("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy")
    )
    return rows.drop("copy")
