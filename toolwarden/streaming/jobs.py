"""Streaming jobs over catalogs, responses and request events.

Stateless scans are the batch transforms applied to a stream.  Where rows must
meet across batches (sessions, correlation, deduplication, rates), the state is
a table in the shared folder, so rows may come as late as they like and nothing
expires.  Sinks are file sinks or idempotent ``foreachBatch`` writes, so a
restart neither loses nor repeats rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolwarden.operators import metrics as M
from toolwarden.operators.detectors import normalise_tools
from toolwarden.operators.enforcement import enforce_catalog, kill_switch_filter
from toolwarden.operators.responses import redact_responses, scan_responses
from toolwarden.operators.scoring import scan_tools
from toolwarden.operators.sessions import correlate, with_route, with_session_validity
from toolwarden.operators.verdicts import with_key
from toolwarden.sources.audit import audit_results
from toolwarden.sources.policy_config import Policy


def run_to_files(
    stream: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet"
) -> None:
    """Process what is available into a file sink (exactly once)."""
    writer = stream.writeStream.format(fmt).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = (
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )
    query.awaitTermination()


def run_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> None:
    """Process what is available with a batch function."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def scan_catalog(tools: DataFrame, **options) -> DataFrame:
    """Scan a stream of tools."""
    return scan_tools(tools, **options)


def scan_and_redact(responses: DataFrame, **switches: bool) -> DataFrame:
    """Scan a stream of responses; critical ones leave redacted, without evidence."""
    return redact_responses(scan_responses(responses, **switches))


def routed_sinks(messages: DataFrame, path: str, checkpoint: str) -> None:
    """Split a message stream by route; each batch replaces its own folder, so
    a repeated batch leaves the same files."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        with_route(batch).write.mode("overwrite").partitionBy("route").parquet(
            f"{path}/batch_id={batch_id}"
        )

    run_batches(messages, handle, checkpoint)


def replayed(
    stream: DataFrame,
    keys: list[str],
    judge: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
) -> None:
    """Run a batch operator whose rows depend on others of their key over a stream.

    Every batch is logged below ``path/log``; then the keys that it touched are
    judged anew over all that is logged of them, below ``path/results``, so a
    row that comes late corrects what was said before, and the result does not
    depend on where batches end.  Nothing expires; state is a table, not memory.
    Batches replace their own folders, so a repeated one changes nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
        batch.write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")
        touched = (
            spark.read.schema(schema).parquet(f"{path}/log/batch_id={batch_id}").select(*keys).distinct()
        )
        if touched.isEmpty():
            return
        logged = spark.read.schema(with_batch).parquet(f"{path}/log")
        logged = logged.where(F.col("batch_id") <= batch_id).drop("batch_id")
        now = touched.select([F.col(k).alias(f"_now_{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_now_{k}"))
        judge(logged.join(now, same, "left_semi")).write.mode("overwrite").parquet(
            f"{path}/results/batch_id={batch_id}"
        )

    run_batches(stream, handle, checkpoint)


def latest_results(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What a replayed job says now: of every key the rows of the last batch that judged it."""
    results = spark.read.parquet(f"{path}/results")
    last = results.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.max("batch_id").alias("_last"))
    same = F.col("batch_id") == F.col("_last")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return results.join(last, same, "left_semi").drop("batch_id")


def correlate_stream(messages: DataFrame, client: list[str], path: str, checkpoint: str) -> None:
    """The batch correlation over a stream of requests and answers (``is_answer``): an answer
    takes the method of the latest unanswered request of its client and id.  Read the
    answers with :func:`latest_results` by client and ``request_id``."""

    def judge(rows: DataFrame) -> DataFrame:
        requests = rows.where("NOT is_answer").drop("is_answer")
        return correlate(requests, rows.where("is_answer").drop("is_answer"), client)

    replayed(messages, [*client, "request_id"], judge, path, checkpoint)


def session_validity(
    requests: DataFrame, session: str, path: str, checkpoint: str, row_id: str = "request_id"
) -> None:
    """The batch rule over a stream: a request is valid if its session was opened before it and
    not closed since, however long ago.  Requests without a session are valid at once and are
    not looked at again.  Read with :func:`latest_results` by session."""

    def judge(rows: DataFrame) -> DataFrame:
        return with_session_validity(rows, session, row_id)

    # Requests without a session are keys of their own.
    alone = F.when(F.col(session).isNull(), F.col(row_id))
    replayed(requests.withColumn("alone", alone), [session, "alone"], judge, path, checkpoint)


def pattern_counters(tools: DataFrame) -> DataFrame:
    """Running detections per detector."""
    return M.detections_by_pattern(scan_tools(tools, evidence=False))


def run_counters(counters: DataFrame, path: str, checkpoint: str) -> None:
    """Keep the latest state of running counters in a table."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}"
        )

    run_batches(counters, handle, checkpoint, mode="complete")


def rate_windows(requests: DataFrame, path: str, checkpoint: str, window: str = "1 minute", slide: str | None = None) -> None:
    """Requests per window and method: every batch adds its counts, so late rows count and the
    newest windows are there.  Read with :func:`summed_rates`."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)

    def handle(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(span.alias("_w"), "method").agg(F.count("*").alias("requests"))
        counts.select(F.col("_w.start").alias("window_start"), "method", "requests").write.mode(
            "overwrite"
        ).parquet(f"{path}/batch_id={batch_id}")

    run_batches(requests, handle, checkpoint)


def summed_rates(spark: SparkSession, path: str) -> DataFrame:
    """Requests per window and method over all batches so far."""
    return spark.read.parquet(path).groupBy("window_start", "method").agg(F.sum("requests").alias("requests"))


def new_texts_within_watermark(tools: DataFrame, ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """Each text once within the watermark delay (bounded state)."""
    return (
        with_key(normalise_tools(tools)).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["cache_key"])
    )


def new_texts(tools: DataFrame, path: str, checkpoint: str) -> None:
    """Each text once, for good.  The keys seen so far are the table that is written, not state
    in memory; texts move only if their key is new."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        keyed = with_key(normalise_tools(batch)).select("cache_key", "tool_name", "description")
        if batch_id > 0:
            seen = batch.sparkSession.read.schema("cache_key STRING, batch_id BIGINT").parquet(path)
            keyed = keyed.join(seen.where(F.col("batch_id") < batch_id), "cache_key", "left_anti")
        keyed.dropDuplicates(["cache_key"]).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_batches(tools, handle, checkpoint)


def enforced_catalog(tools: DataFrame, policy: Policy, by: list[str], path: str, checkpoint: str) -> None:
    """What each listing of a stream delivers: policy, scan, filter by blocked names of the
    same listing (``by``), and what the policy lets through again.  A listing is one message
    and so comes in one batch; ``by`` must tell messages apart if a server sends several."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        enforce_catalog(batch, policy, by=by).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_batches(tools, handle, checkpoint)


def switched_catalog(
    tools: DataFrame, read_switch: Callable[[], bool], path: str, checkpoint: str
) -> None:
    """Pass tools on while the kill switch is off; it is read for every batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        kill_switch_filter(batch, read_switch()).write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}"
        )

    run_batches(tools, handle, checkpoint)


def audit_sink(tools: DataFrame, path: str, checkpoint: str, **options) -> None:
    """Append the audit lines of a scanned stream by day, exactly once."""
    run_to_files(
        audit_results(scan_tools(tools, **options)), path, checkpoint, ("date",), fmt="json"
    )
