"""Hilbert order and the cut into shards."""

import zlib
from itertools import product

from pyspark.sql import functions as F

from toolwarden.llm import sharding as H


def test_curve_visits_neighbours(spark):
    side = range(1 << 3)
    cells = spark.createDataFrame(list(product(side, side, side)), "x int, y int, z int")
    order = cells.select("x", "y", "z", H.hilbert([F.col("x"), F.col("y"), F.col("z")], 3).alias("h")).orderBy("h").collect()
    assert [r.h for r in order] == list(range(512))
    steps = [sum(abs(a[i] - b[i]) for i in range(3)) for a, b in zip(order, order[1:])]
    assert set(steps) == {1}


def place(spark, rows, shards=24):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return H.place(docs, shards).collect()


def check(rows, got, shards):
    assert len(got) == len(rows)
    sizes = [sum(r.shard == s for r in got) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for r in got:
        assert r.law == "rows" and r.grown_shard is None


def test_law_sizes_and_sums(spark):
    rows = [(i, f"text {i * 7919 % 311} " * (i % 50), ["en", "de", None][i % 3], f"src{i % 7}" if i % 3 else "src0") for i in range(700)]
    got = place(spark, rows)
    check(rows, got, 24)
    by_id = {r[0]: r for r in rows}
    for r in got:
        raw = by_id[r.doc_id][1].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))


def test_copies_stay_together(spark):
    rows = [(i, "the one text that many have", ["en", "de"][i % 2], f"s{i % 5}") for i in range(100)]
    rows += [(1000 + i, f"another text number {i}", "en", f"s{i % 5}") for i in range(300)]
    got = place(spark, rows, 8)
    check(rows, got, 8)
    assert len({r.shard for r in got if r.doc_id < 100}) <= 3  # 100 copies, 50 rows a shard


def test_edge_rows(spark):
    rows = [(1, None, None, None)] * 2 + [(None, "", "en", "s")] + [(1, "é", "en", "s")] * 2
    got = place(spark, rows, 3)
    check(rows, got, 3)
    assert sorted(r.size for r in got) == [8, 8, 8, 10, 10]
    assert place(spark, [], 3) == []
    docs = spark.createDataFrame([(1, "a", 5, "z")], "doc_id long, text string, size int, shard string")
    assert H.place(docs, 2).first().size == 9


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i}", "en", f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    H.write(docs, str(tmp_path / "shards"), 6)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(r[0], r[1]) for r in rows]
    assert {r["count"] for r in back.groupBy("shard").count().collect()} == {10}
