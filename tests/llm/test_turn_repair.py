"""Repair of conversations against a search of all edits by the shortest path, and against the SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from corpusloom.llm import queries, turn_repair

SCHEMA = "turn long, note string, role string, conv_id long, text string, place int, k string"


def damage(rows):
    """(turn, role, text) by conversation, after damage."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    return out


def cheapest(turns):
    """(cost, audit, lines) by a shortest path over (turns read, last initial said): every edit at every place."""
    seen, heap = set(), [(0, "", (), 0, "")]
    while heap:
        cost, audit, lines, i, last = heapq.heappop(heap)
        if i == len(turns) and last in ("", "a"):
            return cost, audit, lines
        if (i, last) in seen:
            continue
        seen.add((i, last))
        may = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        steps = [(2, "I", f"{r}:", i, r[0]) for r in ("user", "assistant") if r[0] in may]
        if i < len(turns):
            role, text, gone, open_end = turns[i]
            steps.append((3, "D", None, i + 1, last))
            if not gone:
                if role[:1] and role[:1] in may:
                    steps.append((open_end, "K", f"{role}:{text}", i + 1, role[0]))
                steps += [(2 + open_end, "R", f"{r}:{text}", i + 1, r[0]) for r in ("user", "assistant") if r[0] in may]
        for c, edit, line, j, said in steps:
            heapq.heappush(heap, (cost + c, audit + edit, lines if line is None else (*lines, line), j, said))
    raise AssertionError


def brute(rows):
    out = {}
    for conv, kept in damage(rows).items():
        seen, turns, counts = set(), [], [0, 0, 0]
        for _, role, text in kept:
            said = text.strip(" \t\n\x0b\x0c\r")
            faults = [not said, (role, text) in seen, bool(said) and said[-1] not in ".!?"]
            if any(faults):
                counts[faults.index(True)] += 1
            turns.append((role, text, faults[0] or faults[1], int(faults[2] and not faults[1])))
            seen.add((role, text))
        numbers = [t for t, _, _ in kept if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        cost, audit, lines = cheapest(turns)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, rows):
    df = spark.createDataFrame([(t, "x", r, c, x, 1, "z") for c, t, r, x in rows], SCHEMA)
    got = turn_repair.repair_digests(df).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_random_conversations(spark):
    rnd = random.Random(5)
    texts = ["Yes.", "Yes.", "No!", "why", " ", "", "  \t\n", "A.B", "x. ", "y ", None, "user:\nI J", "a? b"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "uncle", "Assistant", "s"]
    rows = [(conv, rnd.choice([None, t, t, t, t + 3]), rnd.choice(roles), rnd.choice(texts)) for conv in range(150) for t in range(rnd.randrange(1, 9))]
    rows += [(None, t, r, f"{t}.") for t, r in enumerate(["user", "assistant", "user"])]
    rows += [(1000 + i, t, rnd.choice(["system", "user", "assistant"]), rnd.choice(["p.", "q", "r!", "s?"]) + "." * rnd.randrange(3)) for i in range(60) for t in range(rnd.randrange(1, 12))]
    rnd.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_conversation_of_many_blocks(spark):
    """More rows than three blocks hold, with repeats across them; one row said often; all nulls."""
    rnd = random.Random(6)
    n = 3 << turn_repair.BLOCK_BITS
    rows = [(7, t // 2, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool"]), f"{rnd.randrange(n)}" + rnd.choice([".", ""])) for t in range(n + 100)]
    rows += [(8, t, "user", "again.") for t in range(n)]
    rows += [(9, None, None, None)] * (n // 2)
    rows += [(10, t, ["user", "assistant"][t % 2], "long " * 30_000 + f"{t}.") for t in range(4)]
    assert run(spark, rows) == brute(rows)


def test_nothing_left_and_empty(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    got = run(spark, [(3, dropped, "user", "Gone.")])
    assert got == {3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert run(spark, []) == {}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    want = con.sql(queries.ORACLES["op12_turn_repair"])
    got = queries.QUERIES["op12_turn_repair"](spark, f"/root/testdata/{sf}")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
