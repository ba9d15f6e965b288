"""One stream of messages, inspected by route, with one commit for all sinks.

Answers meet their requests in keyed state; what they answer says how they are inspected:
listings are parsed and scanned, responses are parsed, scanned and redacted, everything else
passes.  The sinks of a batch are written first, into folders that nobody reads yet; then one
small manifest names them.  A reader starts from the manifests, so it sees all sinks of a
batch or none, whatever was interrupted; a batch that runs again writes new folders, and one
whose manifest is there already does nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toolwarden.operators.responses import redact_responses, scan_responses
from toolwarden.operators.scoring import scan_tools
from toolwarden.operators.sessions import with_route
from toolwarden.sources.envelopes import parse_listings, parse_responses
from toolwarden.streaming.jobs import run_batches
from toolwarden.streaming.state import answered_within

CATALOG, RESPONSE, PASS = "catalog", "response", "pass"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _manifest(path: str, batch_id: int) -> str:
    return f"{path}/_manifests/{batch_id:012d}.json"


def is_committed(spark: SparkSession, path: str, batch_id: int) -> bool:
    system, to = _file_system(spark, path)
    return system.exists(to(_manifest(path, batch_id)))


def commit_batch(
    spark: SparkSession, path: str, batch_id: int, sinks: dict[str, DataFrame], partition_by: tuple[str, ...] = ()
) -> None:
    """Write all sinks of a batch, then its manifest, which appears whole or not at all."""
    if is_committed(spark, path, batch_id):
        return
    attempt = uuid.uuid4().hex
    folders = {}
    for name, rows in sinks.items():
        folders[name] = f"{name}/{batch_id:012d}-{attempt}"
        rows.write.partitionBy(*partition_by).parquet(f"{path}/{folders[name]}")
    system, to = _file_system(spark, path)
    waiting = to(f"{path}/_manifests/.{batch_id:012d}-{attempt}")
    out = system.create(waiting, True)
    out.write(json.dumps({"batch_id": batch_id, "folders": folders}).encode())
    out.close()
    if not system.rename(waiting, to(_manifest(path, batch_id))) and not is_committed(spark, path, batch_id):
        raise OSError(f"could not commit batch {batch_id} below {path}")


def committed_folders(spark: SparkSession, path: str, sink: str) -> dict[int, str]:
    """The folder of a sink in each committed batch."""
    system, to = _file_system(spark, path)
    if not system.exists(to(f"{path}/_manifests")):
        return {}
    manifests = spark.read.schema("batch_id BIGINT, folders MAP<STRING, STRING>").option("pathGlobFilter", "*.json").json(f"{path}/_manifests")
    named = manifests.select("batch_id", F.col("folders")[sink].alias("folder")).collect()
    return {r["batch_id"]: f"{path}/{r['folder']}" for r in named if r["folder"]}


def committed(spark: SparkSession, path: str, sink: str) -> DataFrame | None:
    """All rows of a sink in committed batches; None before the first."""
    folders = committed_folders(spark, path, sink)
    return spark.read.parquet(*folders.values()) if folders else None


def partitions_of(spark: SparkSession, folder: str, column: str) -> list[str]:
    """The values that a folder was written apart by."""
    system, to = _file_system(spark, folder)
    names = [status.getPath().getName() for status in system.listStatus(to(folder))]
    return [name.removeprefix(f"{column}=") for name in names if name.startswith(f"{column}=")]


def inspect_by_route(answers: DataFrame, **scan_options) -> dict[str, DataFrame]:
    """The sinks of a batch of answers with the ``method`` of their request and their JSON as ``value``."""
    routed = with_route(answers)
    keys = [c for c in answers.columns if c != "value"]
    listings = parse_listings(routed.where(F.col("route") == CATALOG).drop("route"))
    responses = parse_responses(routed.where(F.col("route") == RESPONSE).drop("route"))
    return {
        CATALOG: scan_tools(listings, **scan_options).select(
            *keys, "message_id", "tool_pos", "tool_name", "description", "risk_score", "risk_level", "blocked"
        ),
        RESPONSE: redact_responses(scan_responses(responses)).select(*keys, "message_id", "item_pos", "risk_level", "content"),
        PASS: routed.where(F.col("route") == PASS).drop("route"),
    }


def inspected_messages(
    requests: DataFrame, answers: DataFrame, client: list[str], path: str, checkpoint: str,
    within: str = "10 minutes", lateness: str = "10 minutes", commit: Callable = commit_batch, **scan_options,
) -> None:
    """Inspect a stream of answers (``client, request_id, ts, method, value``) by the requests they answer.

    An answer leaves when it meets its request, or when the watermark says that it has none: then
    its own method decides.  Of several requests that meet it in a batch the latest counts."""
    pairs = answered_within(requests, answers, client, within, lateness)
    latest = Window.partitionBy(*client, "request_id", "ts").orderBy(F.col("asked_ts").desc_nulls_last())

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if is_committed(spark, path, batch_id):
            return
        if batch.isEmpty():
            return
        met = batch.withColumn("method", F.coalesce("asked_method", "method")).withColumn("_n", F.row_number().over(latest))
        met = met.where("_n = 1").drop("_n", "asked_ts", "asked_method")
        # The join's rows are written once, so that three sinks do not read the batch three times.
        folder = f"{path}/_batches/{batch_id:012d}-{uuid.uuid4().hex}"
        met.write.parquet(folder)
        commit(spark, path, batch_id, inspect_by_route(spark.read.schema(met.schema).parquet(folder), **scan_options))

    run_batches(pairs, handle, checkpoint)
