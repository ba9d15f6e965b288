"""Requests and responses as event tables: routing, correlation, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolwarden.plans.asof import latest_before

LIST_METHOD = "tools/list"
CALL_METHOD = "tools/call"
OPEN_METHOD = "initialize"
CLOSE_METHOD = "close"


def route(method: Column) -> Column:
    """Which inspection a message goes through."""
    return (
        F.when(method == LIST_METHOD, "catalog").when(method == CALL_METHOD, "response").otherwise("pass")
    )


def with_route(messages: DataFrame) -> DataFrame:
    return messages.withColumn("route", route(F.col("method")))


def correlate(
    requests: DataFrame,
    responses: DataFrame,
    client: list[str],
    bucket_seconds: int = 60,
) -> DataFrame:
    """Responses with the method of the request they answer.

    That is the latest request of the same client and id that was not answered
    yet; a response without one keeps its own method.  Ids repeat between
    clients and over time, so state is carried per time bucket, not joined on id.
    """
    kept = responses.columns
    key = [*client, "request_id"]
    asked = requests.select(
        *key, "ts", F.lit(0).alias("_answer"), F.col("method").alias("_set")
    )
    answers = responses.withColumns({"_answer": F.lit(1), "_set": F.lit("")})
    merged = answers.unionByName(asked, allowMissingColumns=True)
    state = latest_before(
        merged, key, F.struct("ts", "_answer"), F.col("_set"), "ts", bucket_seconds, "_stored"
    )
    stored = F.when(F.col("_stored") != "", F.col("_stored"))
    return state.where("_answer = 1").select(
        *[c for c in kept if c != "method"],
        F.coalesce(stored, F.col("method")).alias("method"),
        stored.isNotNull().alias("matched"),
    )


def with_session_validity(
    requests: DataFrame, session: str, row_id: str, bucket_seconds: int = 60
) -> DataFrame:
    """Add ``valid``: the request opens or closes a session, carries none, or
    its session was opened and not closed before it."""
    method = F.col("method")
    change = F.when(method == OPEN_METHOD, F.lit(True)).when(method == CLOSE_METHOD, F.lit(False))
    state = latest_before(
        requests.where(F.col(session).isNotNull()),
        [session], F.struct("ts", row_id), change, "ts", bucket_seconds, "_open",
    )
    valid = F.coalesce(method.isin(OPEN_METHOD, CLOSE_METHOD), F.lit(False)) | F.coalesce("_open", F.lit(False))
    # Any number of rows may carry no session; they take no part in the state.
    free = requests.where(F.col(session).isNull()).withColumn("valid", F.lit(True))
    return state.withColumn("valid", valid).drop("_open").unionByName(free)
