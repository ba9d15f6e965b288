"""Vector search: recall against brute force, copies, unusable vectors."""

import math

import numpy as np

from toolwarden.llm import ann


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def brute(rows, every, k):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q, a in usable.items():
        if q % every:
            continue
        scores = []
        for i, b in usable.items():
            if i != q and len(a) == len(b):
                scores.append((-float(ann.cosine(a, b[None, :])[0]), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def compare(rows, got, every, k):
    want, hits, total = brute(rows, every, k), 0, 0
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by_query) == {q for q, w in want.items() if w}
    for q, found in by_query.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(want[q]) + 1))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len({f[1] for f in found} & {i for i, _ in want[q]})
        total += len(want[q])
    return hits / max(1, total)


def test_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 700)
    monkeypatch.setattr(ann, "QUERIES", 30)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=24).astype(np.float32)]) for i in range(2500)]
    rows += [(3000 + i, rows[50][1]) for i in range(900)]  # one vector that many rows have
    got = ann.nearest(frame(spark, rows)).collect()
    assert compare(rows, got, 50, 5) >= 0.95
    first = sorted((r for r in got if r.query_id == 50), key=lambda r: r["rank"])
    assert [r.vec_id for r in first] == [3000, 3001, 3002, 3003, 3004] and all(abs(r.score - 1) < 1e-9 for r in first)


def test_small_and_unusable(spark):
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]),
        (5, [1.0, 1.0]), (6, [-1.0, 0.0]), (7, [1e-38, 1e-38]), (50, [3.0, 3.0, 3.0]), (8, [float("inf"), 0.0]), (100, []),
    ]
    got = ann.nearest(frame(spark, rows)).collect()
    assert compare(rows, got, 50, 5) == 1.0
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [5, 7, 6]
    assert ann.nearest(frame(spark, rows[2:4])).collect() == [] and ann.nearest(frame(spark, [])).collect() == []


def test_pruning_keeps_diverse_neighbours():
    points = ann._unit(np.array([[1, 0], [1, 0.1], [1, 0.11], [1, -0.3], [0, 1]], float))
    kept = ann.prune(np.array([0]), np.array([[1, 2, 3, 4]]), points, 4, 1.2)[0]
    assert kept[0] == 1 and 2 not in kept and 3 in kept
