"""Scoring that keeps what was answered.

A call of the scorer costs far more than anything Spark does with its answer, so no answer may be
lost to what happens to others.  The texts to score are claimed first: written once, in waves
of about ``tasks * chunk`` texts by the hash of their key, each a folder of its own that lies dealt
for its tasks.  So a wave reads its own texts only, however many waves there are, and moves none
unless Spark reads the folder as fewer parts.  It is scored by ``tasks`` tasks and committed by a
manifest of its own before the next one begins.  After an interruption the waves that were claimed
and have no manifest come first, and no text of a committed wave is sent again; a lost executor
costs the calls of one wave's task at most.

Within a task a scorer that raises, or answers with NULL, costs nobody else a call: answers that
were given stay, and texts that were handed over and not answered come again at the end, up to
``attempts`` calls each.  Texts without an answer after that have a NULL reply and are claimed
again by the next run.  A token bucket in every task bounds the calls a second of all of them.

One run at a time writes to a log.  An empty table claims nothing; keys are expected once each.
"""

from __future__ import annotations

import math
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolwarden.operators.verdicts import Scorer
from toolwarden.plans.skew import anti_join_keys
from toolwarden.plans.workspace import written
from toolwarden.streaming.messages import commit_batch, committed, committed_folders, partitions_of

CLAIMS, REPLIES = "claims", "replies"
#: Waves of a run have numbers of their own below this.
_WAVES = 10**7
_CLAIM = "cache_key STRING, tool_name STRING, description STRING"


class TokenBucket:
    """At most ``rate`` calls a second in the long run, and ``burst`` at once; None is no bound."""

    def __init__(self, rate: float | None, burst: float = 1.0, clock=time.monotonic, sleep=time.sleep) -> None:
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.since = burst, clock()

    def take(self) -> None:
        if self.rate is None:
            return
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.since) * self.rate)
        self.since = now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            now = self.clock()
            self.tokens = max(1.0, self.tokens + (now - self.since) * self.rate)
            self.since = now
        self.tokens -= 1


def ask(texts: pd.DataFrame, scorer: Scorer, bucket: TokenBucket, attempts: int, pause: float = 0.0) -> pd.DataFrame:
    """``cache_key, reply, calls``: the scorer's answer to each text and how often it was asked."""
    place = {key: i for i, key in enumerate(texts["cache_key"])}
    replies: list[str | None] = [None] * len(texts)
    calls = [0] * len(texts)
    waiting = deque(range(len(texts)))
    while waiting:
        handed: list[int] = []

        def requests() -> Iterator[pd.DataFrame]:
            while waiting:
                bucket.take()
                i = waiting.popleft()
                calls[i] += 1
                handed.append(i)
                yield texts.iloc[i : i + 1]

        try:
            for answers in scorer(requests()):
                for key, reply in zip(answers["cache_key"], answers["reply"], strict=True):
                    replies[place[key]] = None if pd.isna(reply) else reply
        except Exception:  # noqa: BLE001 - whatever a scorer raises is a call without an answer
            time.sleep(pause)
        if not handed:  # the scorer took nothing: the next text counts as asked
            i = waiting.popleft()
            calls[i] += 1
            handed.append(i)
        waiting.extend(i for i in handed if replies[i] is None and calls[i] < attempts)
    return pd.DataFrame({"cache_key": texts["cache_key"].to_numpy(), "reply": pd.Series(replies, dtype=object), "calls": calls})


def _scored(texts: DataFrame, scorer: Scorer, tasks: int, calls_per_second: float | None, attempts: int, pause: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(calls_per_second / tasks if calls_per_second else None)
        for batch in batches:
            yield ask(batch, scorer, bucket, attempts, pause)

    return texts.select("cache_key", "tool_name", "description").mapInPandas(run, "cache_key STRING, reply STRING, calls INT")


def claim(texts: DataFrame, path: str, tasks: int, chunk: int) -> int:
    """Write the texts that have no answer yet as waves of the next run; the number of them."""
    spark = texts.sparkSession
    new = texts.select("cache_key", "tool_name", "description")
    done = committed(spark, f"{path}/{REPLIES}", REPLIES)
    if done is not None:
        new = anti_join_keys(new, done.where("reply IS NOT NULL").select("cache_key").distinct(), ["cache_key"])
    new = written(new, "texts-to-score")
    n = new.count()
    if n:
        run = max(committed_folders(spark, f"{path}/{CLAIMS}", CLAIMS), default=-1) + 1
        waves = math.ceil(n / (tasks * chunk))
        wave = F.pmod(F.xxhash64("cache_key"), F.lit(waves)).cast("int")
        slot = F.pmod(F.xxhash64("cache_key", F.lit("slot")), F.lit(tasks)).cast("int")
        rows = new.select("*", wave.alias("wave"), slot.alias("slot"))
        dealt = rows.repartition(min(waves, new.rdd.getNumPartitions()), "wave")
        commit_batch(spark, f"{path}/{CLAIMS}", run, {CLAIMS: dealt}, partition_by=("wave", "slot"))
    return n


def _claimed(spark: SparkSession, path: str) -> dict[tuple[int, int], str]:
    """The folder of every run and wave that was claimed, in order."""
    runs = committed_folders(spark, f"{path}/{CLAIMS}", CLAIMS)
    waves = [(run, int(wave)) for run, folder in runs.items() for wave in partitions_of(spark, folder, "wave")]
    return {(run, wave): f"{runs[run]}/wave={wave}" for run, wave in sorted(waves)}


def _open(spark: SparkSession, path: str) -> dict[tuple[int, int], str]:
    replies_path, claimed = f"{path}/{REPLIES}", _claimed(spark, path)
    done = committed_folders(spark, replies_path, REPLIES) if claimed else {}
    return {w: folder for w, folder in claimed.items() if w[0] * _WAVES + w[1] not in done}


def open_waves(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Run and wave of all that is claimed and not committed, in order."""
    return list(_open(spark, path))


def score_with_progress(
    texts: DataFrame, scorer: Scorer, path: str, tasks: int = 8, chunk: int = 256,
    calls_per_second: float | None = None, attempts: int = 3, pause: float = 0.0, commit: Callable = commit_batch,
) -> DataFrame:
    """Replies to the texts (``cache_key, tool_name, description``, a key once) and to all before them:
    ``cache_key, reply, calls``.  What an interrupted run has claimed is finished first."""
    spark = texts.sparkSession

    def finish() -> None:
        for (run, wave), folder in _open(spark, path).items():
            rows = spark.read.schema(_CLAIM).parquet(folder)
            parts = rows.rdd.getNumPartitions()
            dealt = rows if parts == tasks else rows.coalesce(tasks) if parts > tasks else rows.repartition(tasks)
            scored = _scored(dealt, scorer, tasks, calls_per_second, attempts, pause)
            commit(spark, f"{path}/{REPLIES}", run * _WAVES + wave, {REPLIES: scored})

    finish()
    if claim(texts, path, tasks, chunk):
        finish()
    return replies(spark, path)


def replies(spark: SparkSession, path: str) -> DataFrame:
    """``cache_key, reply, calls`` of everything that was ever asked: the answer, if any, and how many calls it took."""
    told = committed(spark, f"{path}/{REPLIES}", REPLIES)
    if told is None:
        return spark.createDataFrame([], "cache_key STRING, reply STRING, calls BIGINT")
    return told.groupBy("cache_key").agg(F.max("reply").alias("reply"), F.sum("calls").alias("calls"))
