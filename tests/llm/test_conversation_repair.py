"""Repair against all edit sequences, against a plain loop over whole conversations, and on awkward rows."""

import hashlib
import random
import re
import sys
import time
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))

from marshlight.llm import conversation_repair as repair  # noqa: E402
from marshlight.llm import queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
ORDER = re.compile("(s?(ua)+)?")


def every_edit(turns):
    """(cost, audit) of the best of all sequences with at most two inserts before each turn and at the end."""
    found = []

    def go(i, roles, cost, audit, inserts):
        if i == len(turns) and ORDER.fullmatch(roles):
            found.append((cost, audit))
        if inserts < 2:
            for role in "ua":
                go(i, roles + role, cost + 5, audit + "I", inserts + 1)
        if i < len(turns):
            initial, state = turns[i]
            go(i + 1, roles, cost + 2, audit + "D", 0)
            if state != repair.VOID:
                extra = 5 * (state == repair.CUT_SHORT)
                go(i + 1, roles + (initial or "?"), cost + extra, audit + "K", 0)
                for role in "ua":
                    go(i + 1, roles + role, cost + 1 + extra, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from([0, 0, 0, 1, 2])), max_size=3))
def test_every_sequence_of_edits(turns):
    assert repair.cheapest_edits(turns) == every_edit(turns)


def forward(turns):
    """Best (cost, audit) by place after each turn: a table without bounds or search."""
    now = {0: (0, "")}

    def relaxed(held):
        for _ in range(2):
            for p, (cost, audit) in list(held.items()):
                q = 3 if p == 2 else 2
                held[q] = min(held.get(q, (1 << 60, "")), (cost + 5, audit + "I"))
        return held

    for initial, state in turns:
        after = {}
        for p, (cost, audit) in relaxed(now).items():
            moves = [(p, 2, "D")]
            if state != 2:
                q = 3 if p == 2 else 2
                moves.append((q, 1 + 5 * state, "R"))
                legal = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(initial, {})
                if p in legal:
                    moves.append((legal[p], 5 * state, "K"))
            for q, more, letter in moves:
                after[q] = min(after.get(q, (1 << 60, "")), (cost + more, audit + letter))
        now = after
    return min(v for p, v in relaxed(now).items() if p in (0, 3))


def test_longer_conversations():
    rng = random.Random(6)
    for _ in range(400):
        turns = [(rng.choice("suuaaat"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(0, 40))]
        assert repair.cheapest_edits(turns) == forward(turns)


def test_a_very_long_conversation():
    rng = random.Random(9)
    turns = [(rng.choice("ua"), rng.choice([0, 0, 1, 2])) for _ in range(100_000)]
    began = time.process_time()
    cost, audit = repair.cheapest_edits(turns)
    assert len(audit) >= 100_000 and cost > 0 and time.process_time() - began < 8


def plain(rows):
    """Result rows of [(conv_id, turn, role, text)] by loops."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            held[conv] += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    out = []
    for conv, turns in held.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest()))
        counts, seen, marked = [0, 0, 0], set(), []
        for _, role, text in turns:
            body = text.rstrip("\x20\t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            seen.add((role, text))
            marked.append((role[:1], {None: 0, 0: 2, 1: 2, 2: 1}[fault]))
        numbers = {t for t, _, _ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit = forward(marked)
        lines, i, last = [], 0, ""
        for letter in audit:
            made = "assistant" if last == "u" else "user"
            role, text = (made, "") if letter == "I" else turns[i][1:]
            role = made if letter == "R" else role
            i += letter != "I"
            if letter != "D":
                lines.append(f"{role}:{text}")
                last = role[0]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def run(spark, rows, tmp_path, extra=""):
    filled = [(*r, *["?"] * extra.count("string")) for r in rows]
    spark.createDataFrame(filled, SCHEMA + extra).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return result(queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path)))


def test_given_tables(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    assert result(queries.QUERIES["op13_conversation_repair"](spark, SMALL)) == plain(rows)


def test_random_conversations(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(["Yes.", "No!", "why? ", "cut", "", " \n", None, f"{turn}.", "é。"])))
    assert run(spark, rows, tmp_path) == plain(rows)


def test_awkward_rows(spark, tmp_path):
    """Ids, numbers, roles and texts that are null, empty, repeated or very long; names that the operator uses itself; no rows at all."""
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 1 << 40, "assistant", "b."), (-5, 0, "\U0001f44d", "x" * 200_000), (-5, 1, "assistant", "x" * 200_000 + ".\x0b"), (-5, 1, "assistant", "other.\xa0")]
    rows += [(7, i, "user", "same.") for i in range(500)]
    names = ", digest string, initial string, blank string, closed string, kind string, place string, audit string, copy string, cost string, sha256 string"
    assert run(spark, rows, tmp_path / "a", names) == plain(rows)
    assert run(spark, [], tmp_path / "b", names) == []


@pytest.mark.parametrize("audit,want", [("", []), ("KIRDI", [("system", "1"), ("user", ""), ("assistant", "2"), ("user", "")])])
def test_edits_applied(audit, want):
    edits, out = repair._Edits(1, audit), []
    for row in [("system", "1"), ("tool", "2"), ("user", "3")] if audit else []:
        out += edits.apply(*row)
    out += edits.inserts()
    assert [r[2:] for r in out] == want and [r[1] for r in out] == list(range(len(want)))
