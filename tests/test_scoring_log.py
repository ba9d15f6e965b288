import collections

import pandas as pd
import pytest
from pyspark.sql import functions as F

from toolwarden.operators import scoring_log as SL
from toolwarden.streaming.messages import commit_batch


def texts(spark, n):
    rows = [(f"k{i}", f"tool{i}", f"text {i}") for i in range(n)]
    return spark.createDataFrame(rows, "cache_key string, tool_name string, description string").repartition(3)


def counting(folder, fails=()):
    """A scorer that notes each call in a file, and raises at the first call for some texts."""

    def score(batches):
        for batch in batches:
            for key in batch["cache_key"]:
                path = f"{folder}/{key}"
                with open(path, "a") as out:
                    out.write("x")
                if key in fails and len(open(path).read()) <= fails[key]:
                    raise RuntimeError("no answer")
            yield batch[["cache_key"]].assign(reply='{"malicious": false}')

    return score


def calls(folder):
    return {p.name: len(p.read_text()) for p in folder.iterdir()}


def test_ask_keeps_answers():
    seen = collections.Counter()

    def score(batches):
        for batch in batches:
            key = batch["cache_key"].iloc[0]
            seen[key] += 1
            if key == "b" and seen[key] == 1 or key == "d":
                raise ValueError(key)
            yield pd.DataFrame({"cache_key": [key], "reply": [None if key == "c" and seen[key] < 3 else key]})

    rows = pd.DataFrame({"cache_key": list("abcde"), "tool_name": "t", "description": "d"})
    got = SL.ask(rows, score, SL.TokenBucket(None), attempts=3).set_index("cache_key")
    assert got["calls"].to_dict() == {"a": 1, "b": 2, "c": 3, "d": 3, "e": 1}
    assert got["reply"].where(got["reply"].notna(), None).to_dict() == {"a": "a", "b": "b", "c": "c", "d": None, "e": "e"}


def test_ask_scorer_that_takes_nothing():
    rows = pd.DataFrame({"cache_key": ["a", "b"], "tool_name": "t", "description": "d"})
    got = SL.ask(rows, lambda batches: iter(()), SL.TokenBucket(None), attempts=2)
    assert got["reply"].isna().all() and (got["calls"] == 2).all()
    assert SL.ask(rows[:0], lambda batches: iter(()), SL.TokenBucket(None), attempts=2).empty


def test_token_bucket():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = SL.TokenBucket(4, burst=2, clock=lambda: now[0], sleep=sleep)
    for _ in range(10):
        bucket.take()
    assert now[0] == pytest.approx(2.0) and sum(slept) == pytest.approx(2.0)  # 2 at once, 8 by 4 a second
    now[0] += 100
    bucket.take()
    bucket.take()
    before = now[0]
    bucket.take()
    assert now[0] - before == pytest.approx(0.25)  # no more than the burst was saved up


def test_failures_cost_no_other_call(spark, tmp_path):
    log, folder = str(tmp_path / "log"), tmp_path / "calls"
    folder.mkdir()
    fails = {"k3": 1, "k17": 2, "k30": 99}
    got = {r.cache_key: r for r in SL.score_with_progress(texts(spark, 40), counting(folder, fails), log, tasks=2, chunk=5).collect()}
    assert len(got) == 40
    want = {f"k{i}": 1 for i in range(40)} | {"k3": 2, "k17": 3, "k30": 3}
    assert calls(folder) == want and {k: r.calls for k, r in got.items()} == want
    assert [k for k, r in got.items() if r.reply is None] == ["k30"]
    # The next run asks for what has no answer, and for what is new.
    again = SL.score_with_progress(texts(spark, 42), counting(folder), log, tasks=2, chunk=5)
    assert calls(folder) == want | {"k30": 4, "k40": 1, "k41": 1}
    assert again.where("reply IS NULL").isEmpty() and again.count() == 42


def test_restart_between_waves(spark, tmp_path):
    log, folder = str(tmp_path / "log"), tmp_path / "calls"
    folder.mkdir()
    done = []

    def stops(spark, path, number, sinks):
        if len(done) == 2:
            raise KeyboardInterrupt
        done.append(number)
        commit_batch(spark, path, number, sinks)

    with pytest.raises(KeyboardInterrupt):
        SL.score_with_progress(texts(spark, 60), counting(folder), log, tasks=2, chunk=5, commit=stops)
    left = SL.open_waves(spark, log)
    assert len(left) == 4 and 0 < len(calls(folder)) < 60
    got = SL.score_with_progress(texts(spark, 60), counting(folder), log, tasks=2, chunk=5)
    assert calls(folder) == {f"k{i}": 1 for i in range(60)}
    assert got.count() == 60 and got.agg(F.max("calls")).first()[0] == 1 and SL.open_waves(spark, log) == []


def test_wave_reads_its_own_texts_only(spark, tmp_path):
    """The files that a wave's job reads are those of its claim, dealt over all tasks (before: the claims of all waves)."""
    log, folder, read = str(tmp_path / "log"), tmp_path / "calls", []
    folder.mkdir()

    def watched(spark, path, number, sinks):
        files = sinks[SL.REPLIES].inputFiles()
        read.append((number, {f.split("/wave=")[1].split("/")[0] for f in files}, sinks[SL.REPLIES].rdd.getNumPartitions()))
        commit_batch(spark, path, number, sinks)

    SL.score_with_progress(texts(spark, 60), counting(folder), log, tasks=2, chunk=10, commit=watched)
    assert read == [(n, {str(n)}, 2) for n in range(3)]
    assert calls(folder) == {f"k{i}": 1 for i in range(60)}


def test_empty(spark, tmp_path):
    log = str(tmp_path / "log")
    assert SL.score_with_progress(texts(spark, 1).limit(0), counting(tmp_path), log).isEmpty()
    assert SL.open_waves(spark, log) == []
