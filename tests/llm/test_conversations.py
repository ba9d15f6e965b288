"""Conversation repair against a plain dynamic programme over whole conversations."""

import hashlib
import random
import zlib

import pytest

from toolwarden.llm import conversations as C

SPACES = " \t\n\x0b\x0c\r"


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def plain(rows):
    """Best (cost, audit, repaired rows) for each state over all rows, without windows or bounds."""
    seen, kinds = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACES)
        kinds.append(
            "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        )
        seen.add((role, text))

    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                new = (cost + 2, audit + "I", [*out, f"{names[due[state]]}:"])
                if due[state] not in best or new[:2] < best[due[state]][:2]:
                    best[due[state]] = new
        return best

    best = {"": (0, "", [])}
    for (_, role, text), kind in zip(rows, kinds):
        new = {}

        def offer(state, value):
            if state not in new or value[:2] < new[state][:2]:
                new[state] = value

        for state, (cost, audit, out) in inserted(best).items():
            offer(state, (cost + 3, audit + "D", out))
            if kind in ("blank", "duplicate"):
                continue
            extra = kind == "truncated"
            offer(due[state], (cost + 2 + extra, audit + "R", [*out, f"{names[due[state]]}:{text}"]))
            first = role[:1]
            if (first == "s" and state == "") or (first in ("u", "a") and due[state] == first):
                offer(first, (cost + extra, audit + "K", [*out, f"{role}:{text}"]))
        best = new
    final = inserted(best)
    cost, audit, out = min((final[s] for s in ("", "a") if s in final), key=lambda v: v[:2])
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def expected(rows):
    return {c: plain(after_damage([r for r in rows if r[0] == c])) for c in {r[0] for r in rows}}


def result(spark, rows, extra=()):
    table = spark.createDataFrame([(*r, *extra) for r in rows], "conv_id long, turn long, role string, text string" + "".join(f", x{i} string" for i in range(len(extra))))
    return {r[0]: tuple(r)[1:] for r in C.repair(C.damaged(table)).collect()}


def drawn(rng, conv, length):
    roles = ["user", "assistant", "system", "tool", "", None, "ai", "u"]
    texts = ["Yes.", "No", "", " \t", "Why?", "Same.", None, "é!", "a\nb.", "Long " * 30]
    turns = [None if rng.random() < 0.05 else rng.randint(0, length) for _ in range(length)]
    return [
        (conv, t, rng.choice(roles[: 8 if rng.random() < 0.3 else 2]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}.")
        for t in turns
    ]


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = [r for conv in range(150) for r in drawn(rng, conv, rng.randint(1, 14))]
    rows += [r for conv in range(200, 206) for r in drawn(rng, conv, rng.randint(100, 400))]
    rows += drawn(rng, None, 9)
    assert result(spark, rows) == expected(rows)


@pytest.mark.parametrize("length", [1, 63, 64, 65, 128, 129, 700])
def test_window_borders(spark, length):
    rng = random.Random(length)
    for style in range(3):
        if style == 0:
            rows = [(0, t, "user", f"{t}.") for t in range(length)]
        elif style == 1:
            rows = [(0, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(length)]
        else:
            rows = [(0, t, rng.choice(["user", "assistant", "system"]), f"{t}" + rng.choice([".", ""])) for t in range(length)]
        assert result(spark, rows) == expected(rows)


def test_search_equals_enumeration():
    rng = random.Random(1)
    kinds = [C.FINE, C.CUT, C.BLANK]
    for _ in range(200):
        rows = [(rng.choice("suax"), rng.choice(kinds)) for _ in range(rng.randint(0, 5))]
        found = C.search(rows, {C.NOTHING: (0, 0)}, True)
        cost, _, audit = min(found.values())
        todo, best = [(0, "", 0, C.NOTHING)], None
        while todo:  # every sequence of edits up to the cost found
            c, a, i, s = todo.pop()
            if c > cost:
                continue
            if i == len(rows) and s in (C.NOTHING, C.ASSISTANT) and (best is None or (c, a) < best):
                best = (c, a)
            todo.append((c + 2, a + "I", i, C.DUE[s]))
            if i < len(rows):
                todo.append((c + 3, a + "D", i + 1, s))
                if rows[i][1] != C.BLANK:
                    more = c + (rows[i][1] == C.CUT)
                    todo.append((more + 2, a + "R", i + 1, C.DUE[s]))
                    if (rows[i][0], s) in C.KEPT:
                        todo.append((more, a + "K", i + 1, C.KEPT[rows[i][0], s]))
        assert (cost, audit) == best


def test_edges(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (5000, None, None, None), (5000, None, None, None), (5001, 3, "user", "x" * 300_000)]
    found = result(spark, rows, extra=("a", "b"))
    assert found == expected(rows)
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, fault string, copy int, audit string")
    assert C.repair(C.damaged(empty)).count() == 0
    clash = spark.createDataFrame([(1, 0, "user", "Hi.", "f", 9, "z")], empty.schema)
    assert C.repair(C.whole(clash)).first()["audit"] == "KI"


def test_edits(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "You?"), (1, 2, "assistant", ""), (2, 0, "system", "Be good.")]
    table = C.whole(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    repaired = C.repair(table)
    audit = {r.conv_id: r.audit for r in repaired.collect()}
    steps = sorted(map(tuple, C.edits(table, repaired).collect()))
    assert {c: "".join(s[2] for s in steps if s[0] == c) for c in audit} == audit
    assert [s[4] for s in steps if s[0] == 1 and s[2] != "I"] == ["Hi.", "You?", ""]
