"""JSON-RPC messages as tables: tool listings, tool responses, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolwarden import schemas

#: Identity key -> header (behind the prefix of the gateway).
IDENTITY_HEADERS = {
    "user": "User",
    "role": "Role",
    "request_id": "Request-Id",
    "target": "Target",
}


def parse_listings(messages: DataFrame, value: str = "value") -> DataFrame:
    """One row per listed tool, with its position.  Messages without a result
    or without tools yield no rows; other columns are kept."""
    kept = [c for c in messages.columns if c != value]
    parsed = messages.withColumn("_m", F.from_json(value, schemas.LIST_TOOLS_ENVELOPE))
    return parsed.select(
        *kept,
        F.col("_m.id").alias("message_id"),
        F.posexplode("_m.result.tools").alias("tool_pos", "_t"),
    ).select(
        *kept,
        "message_id",
        "tool_pos",
        F.col("_t.name").alias("tool_name"),
        F.col("_t.description").alias("description"),
        F.col("_t.inputSchema").alias("input_schema"),
    )


def parse_responses(messages: DataFrame, value: str = "value") -> DataFrame:
    """One row per non-empty text item of a tool response, with its position."""
    kept = [c for c in messages.columns if c != value]
    parsed = messages.withColumn("_m", F.from_json(value, schemas.CALL_TOOL_ENVELOPE))
    return (
        parsed.select(
            *kept,
            F.col("_m.id").alias("message_id"),
            F.posexplode("_m.result.content").alias("item_pos", "_c"),
        )
        .where((F.col("_c.type") == "text") & (F.col("_c.text") != ""))
        .select(*kept, "message_id", "item_pos", F.col("_c.text").alias("content"))
    )


def gateway_identity(headers: Column, prefix: str = "X-Gateway-") -> Column:
    """Identity map of the forwarded headers; absent and empty ones are left out."""
    pairs = []
    for key, header in IDENTITY_HEADERS.items():
        pairs += [F.lit(key), F.try_element_at(headers, F.lit(prefix + header))]
    return F.map_filter(
        F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != F.lit(""))
    )


def resolve_server_name(identity: Column, upstream_url: Column) -> Column:
    """The identity's target, else a name made from the upstream address."""
    return F.coalesce(
        F.try_element_at(identity, F.lit("target")), F.concat(F.lit("upstream-"), upstream_url)
    )
