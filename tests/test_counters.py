"""Rates of counters against a walk over each window."""

import datetime as dt
import random

import pytest

from toolwarden.operators import counters as CT

START = dt.datetime(2024, 1, 1)
SCHEMA = "name STRING, row_id BIGINT, ts TIMESTAMP, value DOUBLE"


def plain(rows, window, step):
    out = {}
    for name in {r[0] for r in rows}:
        mine = sorted((r[2], r[1], r[3]) for r in rows if r[0] == name and r[2] is not None and r[3] is not None)
        if not mine:
            continue
        at = START - dt.timedelta(seconds=step)
        while at <= mine[-1][0] + dt.timedelta(seconds=window):
            inside = [m for m in mine if at - dt.timedelta(seconds=window) < m[0] <= at]
            if len(inside) > 1 and inside[-1][0] > inside[0][0]:
                increase = sum(b[2] - a[2] if b[2] >= a[2] else b[2] for a, b in zip(inside, inside[1:]))
                covered = (inside[-1][0] - inside[0][0]).total_seconds()
                apart = covered / (len(inside) - 1)
                head = (inside[0][0] - at).total_seconds() + window
                tail = (at - inside[-1][0]).total_seconds()
                head = head if head < 1.1 * apart else apart / 2
                tail = tail if tail < 1.1 * apart else apart / 2
                if increase > 0 and inside[0][2] >= 0:
                    head = min(head, covered * inside[0][2] / increase)
                out[name, at] = increase * (covered + head + tail) / covered / window
            at += dt.timedelta(seconds=step)
    return out


def rates(spark, rows, window=60, step=5):
    found = CT.counter_rates(spark.createDataFrame(rows, SCHEMA), ["name"], "row_id", window, step)
    return {(r["name"], r["at"]): r["rate"] for r in found.collect()}


def test_rates_with_restarts_gaps_and_ties(spark):
    rng, rows = random.Random(1), []
    for name in ("a", "b", None):
        at, value = START, 0.0
        for i in range(120):
            at += dt.timedelta(seconds=rng.choice([5, 5, 5, 4.5, 20, 150, 0]))
            value = rng.choice([0.0, 2.0]) if rng.random() < 0.08 else value + rng.choice([0, 1, 3.5])
            rows.append((name, i, at, value))
    rows += [("a", 999, None, 4.0), ("b", 999, START, None), ("alone", 1, START, 3.0)]
    rng.shuffle(rows)
    want = plain(rows, 60, 5)
    got = rates(spark, rows)
    assert got.keys() == want.keys() and len(want) > 300
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_steady_counter(spark):
    rows = [("a", i, START + dt.timedelta(seconds=5 * i), 100.0 + 10 * i) for i in range(40)]
    got = rates(spark, rows)
    assert got["a", START + dt.timedelta(seconds=120)] == pytest.approx(2.0)


def test_empty_and_wrong_step(spark):
    assert rates(spark, []) == {}
    with pytest.raises(ValueError):
        rates(spark, [], 60, 7)
