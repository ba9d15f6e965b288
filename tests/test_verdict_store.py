"""The verdict store against a dictionary in memory."""

import random

import numpy as np
import pytest

from toolwarden.operators import verdict_store as VS

SCHEMA = "cache_key STRING, first_seen BIGINT, verdict STRING"


def put(spark, store, memory, batch_id, rows, capacity):
    store.put(spark.createDataFrame(rows, SCHEMA).repartition(2), batch_id)
    for key, seen, verdict in sorted(rows, key=lambda r: (r[1], r[0])):
        memory[key] = verdict  # a key that is there keeps its place
    while len(memory) > capacity:
        memory.pop(next(iter(memory)))


def stored(store):
    return {r.cache_key: r.verdict for r in store.rows().collect()}


@pytest.mark.parametrize("capacity", [7, 40])
def test_capacity_and_order_over_many_batches(spark, tmp_path, capacity):
    rng, memory, clock = random.Random(capacity), {}, 0
    store = VS.VerdictStore(spark, str(tmp_path / "s"), capacity)
    for batch in range(7):
        keys = rng.sample(range(60), rng.choice([1, 5, 12]))
        rows = [(f"k{k}", clock + i, f"v{batch}-{k}") for i, k in enumerate(keys)]
        clock += len(rows)
        put(spark, store, memory, batch, rows, capacity)
        assert stored(store) == memory
    version = store.manifest()["version"]
    store.put(spark.createDataFrame(rows, SCHEMA), 6)  # the batch comes again
    assert store.manifest()["version"] == version and stored(store) == memory
    fresh = VS.VerdictStore(spark, str(tmp_path / "s"), capacity)
    keys = spark.createDataFrame([(k,) for k in [*memory, "none"]], "cache_key STRING")
    assert {r.cache_key for r in fresh.lookup(keys).collect()} == set(memory)
    assert [r.cache_key for r in VS.unknown_texts(fresh, keys).collect()] == ["none"]


def test_a_batch_reads_the_segments_that_may_hold_its_keys(spark, tmp_path):
    store = VS.VerdictStore(spark, str(tmp_path), 10_000)
    for batch in range(6):
        store.put(spark.range(200).selectExpr(f"concat('b{batch}-', id) AS cache_key", "id AS first_seen", "'x' AS verdict"), batch)
        assert len(store.segments_read) <= 1  # new keys: filters are seldom wrong
    names = [s["name"] for s in store.manifest()["segments"]]
    assert len(names) == 6
    store.lookup(spark.createDataFrame([("b3-7",), ("b3-8",)], "cache_key STRING"))
    assert names[3] in store.segments_read and len(store.segments_read) <= 2
    assert store.lookup(spark.createDataFrame([], "cache_key STRING")) is None and store.segments_read == []


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    one, two = VS.VerdictStore(spark, str(tmp_path), 5), VS.VerdictStore(spark, str(tmp_path), 5)
    rows = spark.createDataFrame([("a", 1, "x")], SCHEMA)
    one.put(rows)
    stale = two.manifest() | {"version": 0}
    with pytest.raises(RuntimeError, match="another writer"):
        two._commit(stale)


def test_filters_know_their_keys(spark):
    rng = np.random.default_rng(0)
    mine, others = rng.integers(-(1 << 63), 1 << 63, 2000), rng.integers(-(1 << 63), 1 << 63, 20_000)
    bits = VS.BITS_PER_ROW * len(mine)
    field = np.zeros(bits, bool)
    field[VS.positions(mine, bits).ravel()] = True
    assert field[VS.positions(mine, bits)].all()
    assert field[VS.positions(others, bits)].all(1).mean() < 0.001
    keys = spark.createDataFrame([(f"k{i}",) for i in range(500)], "cache_key STRING")
    halves = [VS.bloom_of(keys.where(f"cache_key {op} 'k3'"), 8000) for op in ("<", ">=")]
    merged = bytes(a | b for a, b in zip(*halves))
    assert merged == VS.bloom_of(keys.repartition(3), 8000)
