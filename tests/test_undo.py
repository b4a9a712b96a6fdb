import random

import pytest

from graphloom.operators import undo

LOG = "session string, seq bigint, op string, entry string"


def by_hand(log, cap):
    stacks, results = {}, []
    for session, seq, op, entry in sorted(log):
        stack = stacks.setdefault(session, [])
        if op == "push":
            stack.append(entry)
            del stack[: max(0, len(stack) - cap)]
            continue
        found, refused = None, False
        if op == "pop_id":
            found = entry if entry in stack else None
            if found:
                stack.remove(entry)
        elif stack and (op == "pop" or stack[-1] == entry):
            found = stack.pop()
        elif stack:
            refused = True
        results.append((session, seq, op, entry, found, refused))
    return results, {s: x[::-1] for s, x in stacks.items() if x}


def random_log(seed, sessions, n, push):
    rng, log = random.Random(seed), []
    for s in range(sessions):
        for seq in range(n if s else 4 * n):  # one session has most of the rows
            op = rng.choices(["push", "pop", "pop_id", "pop_latest"], [push, 3, 2, 2])[0]
            back = max(0, seq - rng.choice([1, 1, 2, 3, 9, 40]))
            entry = f"e{seq}" if op == "push" else None if op == "pop" else f"e{back}"
            log.append((f"s{s}", seq * 3 - 7, op, entry))
    return log


@pytest.mark.parametrize(("seed", "push", "cap", "chunk"), [(1, 8, 50, 50_000), (2, 8, 5, 40), (3, 20, 50, 60), (4, 3, 4, 7), (5, 30, 3, 25)])
def test_replay_against_a_stack(spark, monkeypatch, seed, push, cap, chunk):
    monkeypatch.setattr(undo, "CHUNK_ROWS", chunk)
    log = random_log(seed, 5, 120, push)
    results, stacks = by_hand(log, cap)
    df = spark.createDataFrame(log + [(None, 1, "push", "x"), ("s0", None, "push", "x"), ("s0", 5_000, "other", "x")], LOG).repartition(3)
    got, left = undo.replay(df, cap)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(results, key=str)
    mine = {}
    for r in sorted(left.collect(), key=lambda r: r.depth):
        mine.setdefault(r.session, []).append(r.entry)
    assert mine == stacks


def test_an_empty_log(spark):
    got, left = undo.replay(spark.createDataFrame([], LOG))
    assert got.count() == 0 and left.count() == 0
