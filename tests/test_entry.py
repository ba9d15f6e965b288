"""The registry, and a few registered queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    own = {n for n in queries if n != "pipeline" and not n.startswith("op")}
    assert own <= set(oracles)


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize(
    "name",
    [
        "scan_report", "scan_responses", "enforce_catalog", "session_validity", "stream_method_route", "verdict_dedup",
        "src_tool_catalog", "src_tool_responses", "src_policy_config", "src_gateway_identity", "sink_audit_jsonl",
        "sink_metrics_text", "det_cross_tool", "det_invisible_chars", "det_obfuscated", "evidence_samples", "filter_listings",
        "exposure_diff", "policy_decide", "policy_first_match", "kill_switch_filter", "trusted_source", "find_pii",
        "find_json_dump", "redact_responses", "verdict_parse", "verdict_score_stored", "det_semantic", "combined_verdict",
        "metrics_table", "rate_scans_per_min", "correlate_replies", "stream_correlate", "stream_session_validity",
        "stream_rate_window", "stream_verdict_dedup", "stream_enforce_catalog",
    ],
)
def test_query(spark, con, name):
    assert check.compare(spark, con, FOLDER, name).startswith("ok")


def test_flagship(spark):
    assert entry.entry(spark).count() == 20
