"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

#: One detector outcome.
DETECTION = (
    "struct<pattern_name:string,severity:int,matched:boolean,evidence:string,description:string>"
)

#: One finding in a tool response; the raw evidence never reaches a sink.
FINDING = (
    "struct<category:string,finding_type:string,severity:int,evidence:string,"
    "redacted_evidence:string>"
)

#: List-tools message.  The input schema of a tool is kept as raw JSON.
LIST_TOOLS_ENVELOPE = (
    "jsonrpc STRING, id STRING, "
    "result STRUCT<tools: ARRAY<STRUCT<name: STRING, description: STRING, inputSchema: STRING>>>"
)

#: Call-tool message.
CALL_TOOL_ENVELOPE = (
    "jsonrpc STRING, id STRING, "
    "result STRUCT<content: ARRAY<STRUCT<type: STRING, text: STRING>>>"
)

#: Reply of a semantic scorer, every field as the text it was written in.
VERDICT_REPLY = "malicious STRING, confidence STRING, severity STRING, categories STRING, reasoning STRING"

#: Audit lines: one per scanned server, one per scanned tool.
AUDIT_REPORT = (
    "scan_id STRING, timestamp TIMESTAMP, server_name STRING, total_tools BIGINT, "
    "tools_blocked BIGINT, tools_warned BIGINT, tools_safe BIGINT, max_risk_score INT, "
    "gateway_identity MAP<STRING,STRING>, date DATE"
)
AUDIT_RESULT = (
    "scan_id STRING, timestamp TIMESTAMP, server_name STRING, tool_name STRING, risk_score INT, "
    "risk_level STRING, blocked BOOLEAN, detections ARRAY<" + DETECTION + ">, date DATE"
)
