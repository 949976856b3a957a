"""Conversation repair against an exhaustive shortest path with audit strings, and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from llm_rows import words  # noqa: F401
from rostercast.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, c string, idx long, `a b` int"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def fault(rows, i):
    _, role, text = rows[i]
    body = text.strip(R.SPACES)
    if not body:
        return "blank"
    if any(r[1:] == (role, text) for r in rows[:i]):
        return "duplicate"
    return None if body[-1] in ".!?" else "truncated"


def cheapest(rows):
    """The least (cost, audit) over the whole graph, inserts included, by a queue of partial repairs."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, q, lines = heapq.heappop(queue)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(rows) and q in ("", "a"):
            return cost, audit, "\n".join(lines)
        full = {"u": "user", "a": "assistant"}
        heapq.heappush(queue, (cost + 5, audit + "I", i, after[q], (*lines, full[after[q]] + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            f = fault(rows, i)
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, q, lines))
            if f not in ("blank", "duplicate"):
                x = 5 if f else 0
                if role[:1] == after[q] or (q == "" and role[:1] == "s"):
                    heapq.heappush(queue, (cost + x, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
                heapq.heappush(queue, (cost + x + 1, audit + "R", i + 1, after[q], (*lines, f"{full[after[q]]}:{text}")))
    raise AssertionError


def brute(rows):
    convs, out = {}, []
    for conv, *rest in rows:
        convs.setdefault(conv, []).append((conv, *rest))
    for conv, own in convs.items():
        d = damage(own)
        turns = [t for t, _, _ in d if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [fault(d, i) for i in range(len(d))]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(d, d[1:], strict=False))
        cost, audit, text = cheapest(d)
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def solve(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in R.repair(df).collect()], key=repr)


def rows_of(seed, convs, most):
    rng = random.Random(seed)
    out = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "ü"])
            text = rng.choice([words(rng.randint(1, 30), 4) + rng.choice([".", "!", " ?\n", "", " ,"]), "Yes.", "", " \x0b\t", None, "é\U0001f600。", "a.\xa0"])
            out.append((rng.choice([c, c, c, None]), rng.choice([t, t, t, t, 3, None]), role, text))
    return out


def test_odd_rows_equal_brute_force(spark):
    rows = rows_of(1, 60, 9) + [(900, None, "user", "x."), (901, 1, "user", "a" * 100_000 + "."), (901, 2, "assistant", "b.")]
    rows += rows[:40]  # repeated rows
    assert solve(spark, rows) == brute(rows)
    assert solve(spark, []) == []


def test_conversations_that_span_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    monkeypatch.setattr(R, "CHUNK", 20)
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), words(t, 3) + rng.choice([".", "", "!"])) for t in range(300)]
    rows += rows_of(2, 20, 8) + [(2, t, "user" if t % 2 else "assistant", f"t {t}.") for t in range(40)]
    assert solve(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_least_paths_of_random_graphs(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    length = rng.integers(1, 12, 200)
    first = np.cumsum(length) - length
    n = int(length.sum())
    code, banned, extra = rng.integers(0, 4, n), rng.random(n) < 0.2, np.where(rng.random(n) < 0.3, 5, 0)
    s = len(first)
    ends = np.tile(R.ACCEPT, (s, 1))
    cost, audits, _, _ = R.solved(first, length, code, banned, extra, ends, np.ones(s, bool), np.arange(s), np.zeros(s, int))
    for i in range(s):
        sl = slice(first[i], first[i] + length[i])
        role = {0: "x", 1: "system", 2: "user", 3: "assistant"}
        rows = [(j, role[c], "" if b else f"{j}" + ("" if x else ".")) for j, (c, b, x) in enumerate(zip(code[sl], banned[sl], extra[sl], strict=True))]
        assert (cost[i], audits[i]) == cheapest(rows)[:2]
